"""Exact top-k by inner product over an impact-ordered index, score at a time.

The index of a block of rows holds, per dimension, its postings (row, component) in segments of descending impact level:
a segment's components lie within a factor two of its impact, their greatest size. Zero components have no posting.

A query processes the segments in bands of descending ``|query component| * impact``: a band's segments
of one level are added for a whole group of queries by one product with the level's postings. What is left of a row
is bounded by the norms of the query and of the row over the dimensions not yet processed, so that

    upper(row) = sum so far + rest(query, row) * rest(row, query)

holds for every row of the block (Cauchy-Schwarz, with the rounding of 32-bit floats added). The exact scores of the
k best rows so far give a lower bound of the block's k-th score; only rows whose upper bound reaches it may be members. A
query stops when these are few, which is the proof that no other row is, and they are scored exactly in 64-bit integers; otherwise
the next band follows, until all postings are processed. Nothing is dropped by a cap. Each block gives its k best
per query; a ranked window takes the k best of all blocks.

Defined cases: see ``vectors``; a row is no candidate of the query with its own id. Queries with fewer candidates than k
give all of them; ties go to the smaller id. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import read_table
from . import vectors as V
from .common import landed, per_batch

#: Impact levels, each half of the one before; the last one holds all smaller components.
LEVELS = 8
#: Bands end at these parts of a query's greatest impact; the last band takes the rest.
BANDS = (16, 64)
#: A query stops once so many possible members are left of a block: a part of its rows, or some times k.
FEW_PART, FEW_TIMES = 32, 4
QUERIES_AT_ONCE = 256
PAIRS_AT_ONCE = 1 << 15

INDEX = "block long, ids binary, vectors binary, rows binary, ends binary, impacts binary"
HITS = "query_id long, vec_id long, score long"


def segments(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of a block: rows by (dimension, level), the end of each segment and its impact."""
    size = np.abs(vectors.astype(np.int64)).T  # dimension by row
    greatest = max(int(size.max(initial=0)), 1)
    level = np.clip(np.floor(np.log2(greatest / np.maximum(size, 1))), 0, LEVELS - 1).astype(np.int64)
    key = np.where(size > 0, level, LEVELS)
    order = np.argsort(key, axis=1, kind="stable")
    counts = np.stack([(key == at).sum(axis=1) for at in range(LEVELS)], axis=1)
    impacts = np.stack([np.where(key == at, size, 0).max(axis=1, initial=0) for at in range(LEVELS)], axis=1)
    posted = np.arange(size.shape[1])[None, :] < counts.sum(axis=1)[:, None]
    return order[posted].astype(np.int32), np.cumsum(counts.ravel()), impacts


def _index(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for row in batch.to_pylist():
        _, vectors, _ = V.unpack(row["ids"], row["vectors"], row["labels"])
        rows, ends, impacts = segments(vectors)
        yield pa.RecordBatch.from_pydict({"block": [row["block"]], "ids": [row["ids"]], "vectors": [row["vectors"]], "rows": [rows.tobytes()],
                                          "ends": [ends.tobytes()], "impacts": [impacts.tobytes()]})


def build_index(rows: DataFrame) -> DataFrame:
    """The impact-ordered index of all ``(vec_id, vector, label)`` rows: a written table of blocks."""
    return landed(per_batch(_index, INDEX)(V.blocks(rows)), "impact-index")


class Block:
    """A block of the index: its vectors and, per level, the components of the level's postings."""

    def __init__(self, ids: bytes, vectors: bytes, rows: bytes, ends: bytes, impacts: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, "<i4").reshape(len(self.ids), -1)
        self.impacts = np.frombuffer(impacts, np.int64).reshape(-1, LEVELS)
        rows, ends = np.frombuffer(rows, np.int32), np.frombuffer(ends, np.int64)
        lengths = np.diff(ends, prepend=0)
        dimension = np.repeat(np.repeat(np.arange(len(self.impacts)), LEVELS), lengths)
        level = np.repeat(np.tile(np.arange(LEVELS), len(self.impacts)), lengths)
        component = self.vectors[rows, dimension].astype(np.float32)
        self.levels = []
        for at in range(LEVELS):
            mine = level == at
            postings = np.zeros((len(self.impacts), len(self.ids)), np.float32)
            postings[dimension[mine], rows[mine]] = component[mine]
            self.levels.append(postings)


def exact_scores(queries: np.ndarray, block: Block, query: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs (query, row)."""
    out = np.empty(len(query), np.int64)
    for at in range(0, len(query), PAIRS_AT_ONCE):
        to = at + PAIRS_AT_ONCE
        out[at:to] = (queries[query[at:to]].astype(np.int64) * block.vectors[row[at:to]]).sum(axis=1)
    return out


def search_block(block: Block, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of a block per query: positions of queries and rows and their scores; and the segments that each query processed."""
    n, rows, width = len(ids), len(block.ids), block.vectors.shape[1]
    q = queries.astype(np.float32)
    q2, v2 = (q * q).sum(axis=1), (block.vectors.astype(np.float32) ** 2).sum(axis=1)
    rounding = (width + LEVELS * (len(BANDS) + 1) + 8) * 2.0 ** -23  # of sums of so many 32-bit terms
    impact = np.abs(q)[:, :, None] * block.impacts.astype(np.float32)[None, :, :]
    greatest = impact.max(axis=(1, 2), initial=0)
    total, left_v, left_q = np.zeros((n, rows), np.float32), np.tile(v2, (n, 1)), np.tile(q2[:, None], (1, rows))
    own = ids[:, None] == block.ids[None, :]
    lower = np.full(n, -np.inf)
    active, above, used = np.arange(n), np.full(n, np.inf, np.float32), np.zeros(n, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    few = max(FEW_TIMES * k, rows // FEW_PART)
    for band in (*BANDS, 0):
        below = greatest[active] / band if band else np.full(len(active), np.finfo(np.float32).tiny, np.float32)
        mine = (impact[active] < above[active, None, None]) & (impact[active] >= below[:, None, None])
        used[active] += mine.sum(axis=(1, 2))
        above[active] = below
        for at, postings in enumerate(block.levels):
            chosen = mine[:, :, at]
            if chosen.any():
                weights = np.where(chosen, q[active], 0)
                total[active] += weights @ postings
                left_v[active] -= chosen.astype(np.float32) @ (postings * postings)
                left_q[active] -= (weights * weights) @ (postings != 0).astype(np.float32)
        scale = np.sqrt(q2[active].astype(np.float64)[:, None] * v2[None, :])
        rest = np.sqrt(np.maximum(left_v[active] + rounding * v2[None, :], 0) * np.maximum(left_q[active] + rounding * q2[active, None], 0))
        upper = np.where(own[active], -np.inf, total[active] + rest + 2 * rounding * scale + 1)
        if rows > k:  # exact scores of the k best so far bound the k-th score from below
            best = np.argpartition(np.where(own[active], -np.inf, total[active]), rows - k, axis=1)[:, rows - k:]
            scores = exact_scores(queries, block, np.repeat(active, k), best.ravel()).reshape(-1, k).astype(np.float64)
            scores[np.take_along_axis(own[active], best, axis=1)] = -np.inf
            lower[active] = np.maximum(lower[active], scores.min(axis=1))
        possible = ~own[active] & (upper >= lower[active, None] * (1 - np.sign(lower[active, None]) * 1e-12))
        done = (possible.sum(axis=1) <= few) | (band == 0)
        query, row = np.nonzero(possible & done[:, None])
        found.append((active[query], row))
        active = active[~done]
        if not len(active):
            break
    query, row = (np.concatenate(x) for x in zip(*found))
    score = exact_scores(queries, block, query, row)
    order = np.lexsort((block.ids[row], -score, query))
    query, row, score = query[order], row[order], score[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], row[place < k], score[place < k], used


def _search(k: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for cell in batch.to_pylist():
            ids, queries, _ = V.unpack(cell["q_ids"], cell["q_vectors"], cell["q_labels"])
            block = Block(cell["ids"], cell["vectors"], cell["rows"], cell["ends"], cell["impacts"])
            V.score_bound(queries, block.vectors)
            width = max(queries.shape[1], block.vectors.shape[1])
            queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))[:, :block.vectors.shape[1]]  # beyond the block's width all rows are zero
            for at in range(0, len(ids), QUERIES_AT_ONCE):
                mine = slice(at, at + QUERIES_AT_ONCE)
                query, row, score, _ = search_block(block, ids[mine], queries[mine], k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[mine][query]), pa.array(block.ids[row]), pa.array(score)], ["query_id", "vec_id", "score"])

    return run


def top_k(rows: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best other rows of every row of the integer ``rows`` that meets ``queries``."""
    rows = landed(rows, "integer-rows")
    met = V.cells(build_index(rows), V.groups(rows.where(queries)))
    hits = per_batch(_search(k), HITS)(met)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op12_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows by integer inner product for every embedding whose id is divisible by 100, against all others."""
    rows = V.integer_rows(read_table(spark, sf_dir, "embeddings"), 1024)
    return top_k(rows, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
