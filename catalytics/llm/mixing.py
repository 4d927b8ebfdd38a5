"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size says how often the mix should take each of its
documents: a whole number of copies and a fractional one. The fractions are made
whole in pairs: words move at random from one side of a pair to the other
until one of the two is whole, so that the expected copies of each document and
the words of the pair stay as they were. Blocks of at most about ``BLOCK``
documents of a source are rounded independently and leave one fractional
document each; those residuals are paired again, level by level, until one is
left per source, which a draw decides. A source's words thus miss its target by
less than one document, however many tasks shared the work.

Defined cases: null texts have size 0, are whole at once and take no words. A null
source is a source of its own, last in order. Repeated rows are documents of
their own. Draws depend on the seed, source, block and order by content only,
so that reruns agree. With no rows, or no words at all, targets are 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import documents, landed

WEIGHTS = (5, 2, 1)
MOST = 3  # copies of a document, and a target over its source's size
BLOCK = 2048
WORD = r"[^\x20\x09-\x0D]+"

_ROW = "doc_id long, tkey long, source string, size long, source_size long, target double, copies long, share double, block long"


def sized(docs: DataFrame) -> DataFrame:
    """``doc_id, tkey, source, size`` of each row."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"),
                       docs["source"].cast("string").alias("source"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """``name, source_size, rows, target`` per source.

    The target is ``min(MOST * source_size, level * weight)`` with the level at which
    the targets share all words; over the sources in order of the level that caps
    them, running sums give it directly. One row per source: no text passes here.
    """
    by_source = sizes.groupBy(F.col("source").alias("name")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    order = Window.orderBy(F.col("name").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("name").asc_nulls_last())
    before, every = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    level = ((total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    rows = rows.withColumn("try", level)
    fits = F.when(F.col("try") * F.col("weight") <= F.col("cap"), F.col("try"))
    rows = rows.withColumn("level", F.first(fits, ignorenulls=True).over(every))
    return rows.select("name", "source_size", "rows", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def pivot_block(size: np.ndarray, share: float, draws: np.ndarray) -> np.ndarray:
    """Round documents of one common share, largest first, each paired with all that are left.

    Words move between the document and the rest, whose shares stay equal, until
    the document is whole (or the rest is, which ends the block). Expectations
    are kept as in ``pivot``, and it is the smallest document that stays fractional
    at the end, not a long one that many short ones fail to settle.
    """
    out = np.zeros(len(size))
    rest = np.concatenate([np.cumsum(size[::-1])[::-1][1:], [0.0]])
    for i in range(len(size)):
        if rest[i] == 0.0:
            out[i] = share
            break
        ratio = rest[i] / size[i]
        up = min(1.0 - share, share * ratio)
        down = min(share, (1.0 - share) * ratio)
        gain = up if draws[i] * (up + down) < down else -down
        out[i], share = _whole(share + gain), _whole(share - gain / ratio)
        if share in (0.0, 1.0):
            out[i + 1:] = share
            break
    return out


def _whole(share: float) -> float:
    return 0.0 if share < 1e-9 else 1.0 if share > 1 - 1e-9 else share


def pivot(size: np.ndarray, share: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Round shares in (0, 1) pairwise, keeping ``sum(size * share)``; at most one stays fractional."""
    share = share.copy()
    open_at = -1
    for i in range(len(share)):
        if not 0.0 < share[i] < 1.0:
            continue
        if open_at < 0:
            open_at = i
            continue
        a, b = open_at, i
        ratio = size[b] / size[a]
        up = min(1.0 - share[a], share[b] * ratio)  # a gains, b gives
        down = min(share[a], (1.0 - share[b]) * ratio)
        gain = up if draws[i] * (up + down) < down else -down
        share[a] += gain
        share[b] -= gain / ratio
        share[a], share[b] = _whole(share[a]), _whole(share[b])
        open_at = a if 0.0 < share[a] < 1.0 else b if 0.0 < share[b] < 1.0 else -1
    return share


def _round_block(seed: int, level: int, last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "tkey"], ascending=[False, True, True], kind="stable", na_position="first").reset_index(drop=True)
        name = rows["source"].iloc[0]
        key = zlib.crc32(b"\0" if name is None else b"\1" + name.encode())
        draws = np.random.default_rng([seed, level, int(rows["block"].iloc[0]), key]).random(len(rows) + 1)
        size, share = rows["size"].to_numpy(float), rows["share"].to_numpy(float)
        share = pivot_block(size, float(share[0]), draws) if level == 0 else pivot(size, share, draws)
        if last:  # what is left of a source: one document, decided by its share
            share = np.where((share > 0) & (share < 1), (draws[-1] < share).astype(float), share)
        rows["copies"] += (share == 1.0).astype(np.int64)
        rows["share"] = np.where((share == 0.0) | (share == 1.0), 0.0, share)
        return rows

    return run


def mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, copies, source, tkey."""
    sizes = landed(sized(docs), "mix-sizes")
    per_source = landed(targets(sizes, weights), "mix-targets")
    most = per_source.agg(F.max("rows")).first()[0] or 1
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    whole = F.floor(rate + 1e-9)
    share = F.when(F.col("size") > 0, F.greatest(rate - whole, F.lit(0.0))).otherwise(F.lit(0.0))
    blocks = F.ceil(F.col("rows") / BLOCK)
    rows = sizes.join(per_source, sizes["source"].eqNullSafe(per_source["name"])).select(
        "doc_id", "tkey", "source", "size", "source_size", "target", whole.cast("long").alias("copies"),
        F.when(share < 1e-9, 0.0).otherwise(share).alias("share"),
        F.pmod(F.xxhash64("doc_id", "tkey", F.lit(seed)), blocks).cast("long").alias("block"))
    done, level, blocks_left = [rows.where("share = 0")], 0, -(-most // BLOCK)
    open_rows = rows.where("share > 0")
    while True:
        last = blocks_left == 1
        rounded = landed(open_rows.groupBy("source", "block").applyInPandas(_round_block(seed, level, last), _ROW), f"mix-level-{level}")
        done.append(rounded.where("share = 0"))
        if last:
            break
        open_rows = rounded.where("share > 0").withColumn("block", F.floor(F.col("block") / BLOCK).cast("long"))
        blocks_left, level = -(-blocks_left // BLOCK), level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source", "tkey")


def repeat_rows(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mixed`` takes it, all columns as they are.

    Rows that agree in id and text share their decisions, which are dealt to them in order.
    """
    names = docs.columns
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    mine = docs.select(F.struct(*(docs[f"`{c}`"] for c in names)).alias("row"), docs["doc_id"].cast("long").alias("id"), key.alias("key"))
    mine = mine.withColumn("nth", F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(1))))
    plan = mixed.select(F.col("doc_id").alias("plan_id"), F.col("tkey").alias("plan_key"), "copies",
                        F.row_number().over(Window.partitionBy("doc_id", "tkey").orderBy("copies")).alias("plan_nth")).where("copies > 0")
    met = mine.join(plan, mine["id"].eqNullSafe(plan["plan_id"]) & (mine["key"] == plan["plan_key"]) & (mine["nth"] == plan["plan_nth"]))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")
