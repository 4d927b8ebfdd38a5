"""Integer vectors in packed blocks, and the meeting of a query set with all rows, block by block.

``integer_rows`` turns float vectors into integers, ``blocks`` packs all rows into blocks of bounded size,
``groups`` the query rows into groups of bounded size, and ``cells`` brings every group to every block: the
blocks are repeated per group, the groups dealt over salts, so that no task gathers more than one block and one group
at a time. What a cell gives back is bounded by the size of its group.

Defined cases: a vector that is null or holds a null, NaN or infinite component takes no part, nor does a row without
id. Rows that share an id are one row: the smallest vector (in byte order of its components) stands for it. A
shorter vector counts as one with zeros behind; an empty vector is all zeros. Components must fit 32 bits and scores
64 bits, else the job ends with an error, as integer overflow does in ANSI mode. Columns that are not named stay out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import landed, small_batches, tidy

#: Rows of a block and bytes of a group's vectors.
BLOCK_ROWS = 8192
GROUP_BYTES = 4 << 20
#: Tasks over which the blocks of one group are dealt, where there are as many blocks.
SALTS = 64

ROWS = "vec_id long, vector binary, label int"
BLOCK = "block long, ids binary, vectors binary, labels binary"
#: Greatest score that is sure to fit.
MAX_SCORE = (1 << 62) - 1


def integer_rows(table: DataFrame, scale: int, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """``(vec_id, vector, label)`` of the rows that take part; a vector is its components ``floor(scale * x)`` as 32-bit integers."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column(1)
        lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
        finite = np.isfinite(x)
        row = np.repeat(np.arange(len(lengths)), lengths)
        good = column.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[~finite], minlength=len(lengths)) == 0)
        y = np.floor(scale * x[good[row]])
        if len(y) and np.abs(y).max() >= 1 << 31:
            raise OverflowError("a component leaves 32 bits")
        raw, ends = y.astype("<i4").tobytes(), np.cumsum(lengths[good]) * 4
        vectors = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        chosen = batch.filter(pa.array(good))
        yield pa.RecordBatch.from_arrays([chosen.column(0), pa.array(vectors, pa.binary()), chosen.column(2)], ["vec_id", "vector", "label"])

    small_batches(table.sparkSession)
    rows = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].cast("array<double>").alias("vector"),
                        (F.lit(0) if label is None else label).cast("int").alias("label"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    found = rows.mapInArrow(tidy(lambda batches: (out for b in batches for out in run(b))), ROWS)
    first = found.groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("row"))
    return first.select("vec_id", "row.vector", "row.label")


def stack(vectors: list[bytes]) -> np.ndarray:
    """Vectors of any lengths as rows of a matrix, with zeros behind the shorter ones."""
    width = max((len(v) for v in vectors), default=0)
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in vectors), "<i4").reshape(len(vectors), width // 4)


def pack(ids, vectors: list[bytes], labels) -> tuple[bytes, bytes, bytes]:
    """Ids, vectors and labels of a block in ascending order of the ids."""
    ids = np.asarray(ids, np.int64)
    order = np.argsort(ids)
    return ids[order].tobytes(), stack([vectors[i] for i in order]).tobytes(), np.asarray(labels, np.int32)[order].tobytes()


def unpack(ids: bytes, vectors: bytes, labels: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(vectors, "<i4").reshape(len(ids), -1), np.frombuffer(labels, np.int32)


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices with as many columns as the wider one."""
    width = max(a.shape[1], b.shape[1])
    return tuple(m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))


def score_bound(a: np.ndarray, b: np.ndarray) -> int:
    """No inner product of a row of ``a`` with a row of ``b`` is above this (Cauchy-Schwarz); checked to fit 64 bits."""
    longest = [float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) for m in (a, b)]
    bound = int(longest[0] * longest[1] * (1 + 1e-9)) + 1
    if bound > MAX_SCORE:
        raise OverflowError("a score leaves 64 bits")
    return bound


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All rows in packed blocks, written: their content does not change when a task is repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, count = [], 0

        def packed(table: pa.Table) -> pa.RecordBatch:
            ids, vectors, labels = pack(table["vec_id"].to_numpy(), table["vector"].to_pylist(), table["label"].to_numpy())
            return pa.RecordBatch.from_pydict({"block": [number], "ids": [ids], "vectors": [vectors], "labels": [labels]})

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= block_rows:
                table = pa.Table.from_batches(held)
                yield packed(table.slice(0, block_rows))
                number += 1
                held, count = table.slice(block_rows).to_batches(), count - block_rows
        if count:
            yield packed(pa.Table.from_batches(held))

    return landed(rows.mapInArrow(tidy(run), BLOCK), "vector-blocks")


def groups(rows: DataFrame, extra: str = "", pack_extra: Callable[[pa.Table, np.ndarray], dict] | None = None, count: int | None = None) -> DataFrame:
    """Query rows in packed groups ``(g, ids, vectors, labels)`` of about ``GROUP_BYTES`` each, numbered from 0, written.

    ``pack_extra(table, order)`` may add columns (DDL ``extra``) made of further columns of ``rows``, in the order of the ids.
    """
    size = rows.agg(F.count(F.lit(1)), F.max(F.length("vector"))).first()
    number = max(1, -(-size[0] * max(size[1] or 4, 4) // GROUP_BYTES))

    def run(table: pa.Table) -> pa.Table:
        ids, vectors, labels = pack(table["vec_id"].to_numpy(), table["vector"].to_pylist(), table["label"].to_numpy())
        more = pack_extra(table, np.argsort(table["vec_id"].to_numpy())) if pack_extra else {}
        return pa.table({"g": table["g"].slice(0, 1), "ids": [ids], "vectors": [vectors], "labels": [labels]} | more)

    dealt = rows.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(number)).cast("int"))
    packed = dealt.groupBy("g").applyInArrow(run, "g int, ids binary, vectors binary, labels binary" + extra)  # GROUP_BYTES a group
    return landed(packed, "vector-groups")


def cells(packed: DataFrame, queries: DataFrame) -> DataFrame:
    """Every block beside every group (its columns prefixed ``q_``), dealt over tasks by group and salt.

    The groups' share in this is bounded by ``SALTS`` copies (or two per core); that of the blocks by the number of groups.
    """
    spark = packed.sparkSession
    n_blocks = packed.count()
    salts = max(1, min(n_blocks, max(SALTS, 2 * spark.sparkContext.defaultParallelism)))
    numbers = queries.select(*(F.col(c).alias("q_" + c) for c in queries.columns)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    n_groups = (queries.agg(F.max("g")).first()[0] or 0) + 1
    repeated = (packed.withColumn("q_g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
                .withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")))
    return repeated.repartition(max(1, min(4 * n_groups * salts, 20_000)), "q_g", "salt").join(numbers, ["q_g", "salt"])
