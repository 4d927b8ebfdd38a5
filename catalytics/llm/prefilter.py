"""Bitmaps of hashes: a filter of bounded size that spares rows a shuffle.

A bitmap has at most ``2**MAX_BITS`` bits however many hashes it holds, so it may be
broadcast at any scale; a fuller one only lets more rows pass to the exact join
behind it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import tidy

MAX_BITS = 28


def bitmap(hashes: DataFrame, column: str = "hash", rows: int | None = None) -> np.ndarray:
    """Packed bitmap of the low bits of a long column: about 32 bits a row, made on the executors."""
    rows = hashes.count() if rows is None else rows
    bits = int(min(MAX_BITS, max(20, 5 + int(np.ceil(np.log2(rows + 1))))))
    slot = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    pieces = (hashes.select(F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("at"))
              .groupBy("b").agg(F.bitmap_construct_agg("at").alias("bits")).collect())  # 2**MAX_BITS bits at most
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in pieces:
        piece = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["b"] - 1) * 4096
        out[at:at + len(piece)] = piece[:len(out) - at]
    return out


def passes(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the bitmap."""
    slot = hashes.view(np.uint64) & np.uint64(len(packed) * 8 - 1)
    return (packed[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def split(rows: DataFrame, key: str, packed: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose long column ``key`` may be in the bitmap, and those where it can't be."""
    shared = rows.sparkSession.sparkContext.broadcast(packed)
    at = rows.columns.index(key)

    def part(wanted: bool):
        def run(batches):
            for batch in batches:
                key_hash = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
                yield batch.filter(pa.array(passes(shared.value, key_hash) == wanted))

        return rows.mapInArrow(tidy(run), rows.schema)

    return part(True), part(False)


def hot_join(rows: DataFrame, row_key: str, facts: DataFrame, fact_key: str, hot: np.ndarray, salts: int = 32) -> DataFrame:
    """Inner join of many ``rows`` with one fact per key (both keys long), where a key may hold any share of the rows.

    Rows of the keys in the bitmap ``hot`` are dealt over ``salts`` parts by their content and their facts
    repeated for each part; the other keys are joined as they are.
    """
    many, few = split(rows, row_key, hot)
    facts_many, facts_few = split(facts, fact_key, hot)
    salted = many.withColumn("salt_", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    repeated = facts_many.withColumn("fact_salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    first = salted.join(repeated, (F.col(row_key) == F.col(fact_key)) & (F.col("salt_") == F.col("fact_salt_"))).drop("salt_", "fact_salt_")
    return first.unionByName(few.join(facts_few, F.col(row_key) == F.col(fact_key)))
