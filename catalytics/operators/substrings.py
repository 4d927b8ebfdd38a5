"""Exact substring matching of two tables of strings through a q-gram index.

A string contains a needle only if it contains the needle's grams (substrings of three characters; a shorter needle is
its own gram). Each needle is looked up by the one of its grams that the fewest values have, and one ``contains`` decides:
what the join gives out are the hits. Long values are indexed in overlapping pieces, so that a row of the index is short
however long a value is; every step costs time in proportion to a value's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

GRAM = 3
#: Characters of a piece of a long value, or those of the longest needle if it has more.
PIECE = 512


def grams(value: Column, n: int) -> Column:
    """The distinct substrings of ``n`` characters, by one scan (a look-ahead match at every position)."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)(?=(.{%d}))" % n), F.lit(1)))


def pieces(value: Column, length: int, overlap: int) -> Column:
    """``value`` cut every ``length`` characters, each piece continued by ``overlap`` characters of the next."""
    cut = F.regexp_extract_all(value, F.lit("(?s).{1,%d}" % length), F.lit(0))
    return F.transform(cut, lambda p, i: F.concat(p, F.coalesce(F.substring(F.get(cut, i + 1), 1, overlap), F.lit(""))))


def contains_pairs(values: DataFrame, needles: DataFrame) -> DataFrame:
    """All distinct (value, needle) with ``needle`` a substring of ``value``.

    ``values`` has a string column ``value``, ``needles`` a column ``needle``. Null values and null or empty needles match nothing.
    """
    wanted = materialise(needles.select("needle").where(F.length("needle") > 0).distinct(), "needles")
    lengths = wanted.agg(F.min(F.length("needle")), F.max(F.length("needle"))).first()
    shortest, longest = lengths[0] or GRAM, lengths[1] or GRAM
    known = materialise(values.select("value").where(F.col("value").isNotNull()).distinct(), "values").repartition("value")
    sizes = range(min(shortest, GRAM), GRAM + 1)  # of grams: shorter needles are looked up whole
    of_needle = wanted.select("needle", F.explode(F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(grams(F.col("needle"), GRAM))).alias("gram"))

    def of_value(column: str) -> Column:
        return F.explode(F.concat(*(grams(F.col(column), n) for n in sizes))).alias("gram")

    counts = (known.select(of_value("value")).join(of_needle.select("gram").distinct(), "gram", "left_semi")
              .groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    # a gram that no value has counts 0: its needle has no hits
    rarest = (of_needle.join(counts, "gram", "left").groupBy("needle")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where(F.col("r.n") > 0))
    looked_up = materialise(rarest.select("needle", "r.gram"), "rarest-grams")
    length = max(PIECE, longest)
    cut = known.select(F.when(F.length("value") > length, F.sha2("value", 256)).alias("long"),
                       F.explode(F.when(F.length("value") > length, pieces(F.col("value"), length, longest - 1))
                                 .otherwise(F.array("value"))).alias("piece"))
    index = cut.select("long", "piece", of_value("piece"))
    hits = index.join(looked_up, (index["gram"] == looked_up["gram"]) & F.contains(index["piece"], looked_up["needle"]))
    of_long = hits.where(F.col("long").isNotNull()).select("long", "needle").distinct()
    named = known.where(F.length("value") > length).withColumn("name", F.sha2("value", 256))
    return (hits.where(F.col("long").isNull()).select(F.col("piece").alias("value"), "needle")
            .unionByName(of_long.join(named, F.col("long") == F.col("name")).select("value", "needle")))
