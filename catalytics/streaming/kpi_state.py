"""KPIs of an append-only table that are kept up to date by its new rows only (S8 with A1, A3, A6).

``add`` reduces a batch of new variants to mergeable counts and writes them as the batch's own part of the state table: rows per
store and availability, prices per store as count, sum and bounds, and per store the products, vendors and types that it
has. A batch that is run again replaces its part, so nothing counts twice. ``read`` merges the parts: sums add up, bounds
take the least and greatest, and what occurs in several batches is one value. Its cost grows with the distinct values of the parts, not with
the rows. ``compact`` merges the parts up to a batch into one; readers that find it leave the older parts out.

Defined cases: a null availability counts as unavailable; null prices are left out of the price figures, which are null
for a store without prices; null products, vendors and types are not counted; stores are never null (``clean_variants``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DISTINCT = {"product_id": "unique_products", "vendor": "vendors", "product_type": "product_types"}


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("store_domain", "kind", "value").agg(F.sum("n").alias("n"), F.sum("total").alias("total"),
                                                              F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def facts(rows: DataFrame) -> DataFrame:
    """The state of some variants: ``store_domain, kind, value, n, total, lo, hi``."""
    price = F.col("price").cast("double")

    def fact(kind: str, value, number=None):
        number = F.lit(None).cast("double") if number is None else number
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), F.lit(1).cast("long").alias("n"), number.alias("total"),
                        number.alias("lo"), number.alias("hi"))

    each = [fact("rows", F.coalesce(F.col("available"), F.lit(False)))] + [fact(c, F.col(c)) for c in DISTINCT] + [fact("price", F.when(price.isNotNull(), F.lit("")), price)]
    exploded = rows.select("store_domain", F.explode(F.array(*each)).alias("f")).select("store_domain", "f.*").where(F.col("value").isNotNull())
    return _merged(exploded)


def add(rows: DataFrame, state_dir: str, number: int) -> None:
    """Write the state of a batch's rows as part ``number``, replacing what an earlier run of the batch left."""
    facts(rows).write.mode("overwrite").parquet(f"{state_dir}/merged=false/upto={number}")


def _parts(spark: SparkSession, state_dir: str) -> DataFrame:
    return spark.read.parquet(state_dir).withColumns({"merged": F.col("merged").cast("boolean"), "upto": F.col("upto").cast("long")})


def state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The merged state: the last compacted part and the batches after it."""
    parts = _parts(spark, state_dir)
    last = parts.where("merged").select(F.coalesce(F.max("upto"), F.lit(-1))).scalar()
    return _merged(parts.where((F.col("upto") > last) | (F.col("merged") & (F.col("upto") == last))))


def compact(spark: SparkSession, state_dir: str) -> None:
    """Merge all parts there are into one."""
    parts = _parts(spark, state_dir)
    last = parts.agg(F.max("upto")).first()[0]
    found = parts.select("merged", "upto").where(F.col("merged") & (F.col("upto") == last)).limit(1).count()
    if not found:
        state(spark, state_dir).write.mode("overwrite").parquet(f"{state_dir}/merged=true/upto={last}")


def read(spark: SparkSession, state_dir: str) -> DataFrame:
    """KPIs per store: ``store_domain, variants, available_variants, unavailable_variants, unique_products, vendors, product_types,
    avg_price, min_price, max_price``."""
    def of(kind: str, value):
        return F.when(F.col("kind") == kind, value)

    counts = state(spark, state_dir).groupBy("store_domain").agg(
        F.sum(of("rows", F.col("n"))).alias("variants"),
        F.coalesce(F.sum(F.when(F.col("value") == "true", of("rows", F.col("n")))), F.lit(0)).alias("available_variants"),
        *(F.count(of(c, F.lit(1))).alias(name) for c, name in DISTINCT.items()),
        (F.sum(of("price", F.col("total"))) / F.sum(of("price", F.col("n")))).alias("avg_price"),
        F.min(of("price", F.col("lo"))).alias("min_price"), F.max(of("price", F.col("hi"))).alias("max_price"))
    return counts.select("store_domain", "variants", "available_variants", (F.col("variants") - F.col("available_variants")).alias("unavailable_variants"),
                         *DISTINCT.values(), F.round("avg_price", 6).alias("avg_price"), "min_price", "max_price")
