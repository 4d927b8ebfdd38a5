"""Hard negatives by exact integer scores from residue-number-system matrix products.

Scores of a group of anchors with a block of rows come from 32-bit float products of the component matrices modulo
small primes: residues lie within half a prime of zero, and inner products of ``SLICE`` of them stay below 2^24, where
32-bit floats are exact. The residues of a score modulo several primes give the score itself by Chinese remaindering (mixed
radix digits, centred at zero); as many primes are used as the bound of the scores (Cauchy-Schwarz) needs. The six primes
represent scores up to half their product, about 5 * 10^17; larger ones end the job with an error.

Mining takes two passes over all cells of anchors and rows. The first takes each anchor's best rows of its own label,
its positives. The second takes, per anchor and positive, the best rows of other labels whose score lies in the
window ``low * positive <= 100 * score <= high * positive``. A cell gives back at most as many rows per anchor as the
result may hold, ranked windows merge the cells.

Defined cases: see ``vectors``; a row with a null label takes no part. Ties go to the smaller id. An anchor without other
rows of its label has no positives and gives no rows, nor does a positive whose window holds no row: that of a
negative score is empty, that of a zero score holds the zero scores. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import read_table
from . import vectors as V
from .common import landed, per_batch

#: The greatest primes below 1024; ``SLICE`` products of residues below half of them sum to less than 2^24.
PRIMES = (1021, 1019, 1013, 1009, 997, 991)
SLICE = 64
ANCHORS_AT_ONCE = 256

POSITIVES = "anchor_id long, positive_id long, positive_score long"
NEGATIVES = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"


def primes_for(bound: int) -> tuple[int, ...]:
    """As many primes as represent every whole number from ``-bound`` to ``bound``."""
    product = 1
    for i, p in enumerate(PRIMES):
        product *= p
        if product > 2 * bound:
            return PRIMES[:i + 1]
    raise OverflowError("scores need more primes")


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo p, nearest to zero, as 32-bit floats."""
    r = np.mod(x, p)
    return (r - p * (r > p // 2)).astype(np.float32)


def residue_products(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """``a @ b.T`` modulo p, from exact 32-bit float products of slices of the inner dimension."""
    out = np.zeros((len(a), len(b)), np.int64)
    ra, rb = centred(a, p), centred(b, p)
    for at in range(0, a.shape[1], SLICE):
        out += (ra[:, at:at + SLICE] @ rb[:, at:at + SLICE].T).astype(np.int64)
    return np.mod(out, p)


def from_residues(residues: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The signed numbers of least size with these residues."""
    value, product = residues[0].copy(), primes[0]
    for r, p in zip(residues[1:], primes[1:]):
        digit = np.mod((r - value) * pow(product, -1, p), p)
        value += digit * product
        product *= p
    return np.where(value > product // 2, value - product, value)


def rns_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of two integer matrices, exact."""
    a, b = V.same_width(a, b)
    primes = primes_for(V.score_bound(a, b))
    return from_residues([residue_products(a, b, p) for p in primes], primes)


def best_in_rows(scores: np.ndarray, allowed: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the n greatest allowed scores of each row, of equal ones the first columns."""
    width = scores.shape[1]
    if not width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if width > 4 * n:  # the n-th greatest allowed score bounds who can be among them
        masked = np.where(allowed, scores, np.iinfo(np.int64).min)
        allowed = allowed & (scores >= np.partition(masked, width - n, axis=1)[:, width - n, None])
    row, column = np.nonzero(allowed)
    order = np.lexsort((column, -scores[row, column], row))
    row, column = row[order], column[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[first], column[first]


def _positives(n: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for cell in batch.to_pylist():
            anchors, a, own = V.unpack(cell["q_ids"], cell["q_vectors"], cell["q_labels"])
            ids, b, labels = V.unpack(cell["ids"], cell["vectors"], cell["labels"])
            for label in np.intersect1d(own, labels):
                at, to = np.flatnonzero(own == label), np.flatnonzero(labels == label)
                for some in np.split(at, range(ANCHORS_AT_ONCE, len(at), ANCHORS_AT_ONCE)):
                    scores = rns_scores(a[some], b[to])
                    row, column = best_in_rows(scores, anchors[some][:, None] != ids[to][None, :], n)
                    yield pa.RecordBatch.from_arrays([pa.array(anchors[some][row]), pa.array(ids[to][column]), pa.array(scores[row, column])],
                                                     ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(n: int, low: int, high: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for cell in batch.to_pylist():
            anchors, a, own = V.unpack(cell["q_ids"], cell["q_vectors"], cell["q_labels"])
            ids, b, labels = V.unpack(cell["ids"], cell["vectors"], cell["labels"])
            p_ids, p_scores = (np.frombuffer(cell[c], np.int64) for c in ("q_positive_ids", "q_positive_scores"))
            count = np.frombuffer(cell["q_positives"], np.int64)
            first = np.cumsum(count) - count
            for start in range(0, len(anchors), ANCHORS_AT_ONCE):
                some = np.arange(start, min(start + ANCHORS_AT_ONCE, len(anchors)))
                scores = rns_scores(a[some], b)
                other = own[some][:, None] != labels[None, :]
                for turn in range(int(count[some].max(initial=0))):
                    mine = some[count[some] > turn]
                    at, s = first[mine] + turn, scores[mine - start]
                    # 100 s lies from low p to high p: the same as s from the quotient above to the quotient below
                    least, most = -(-low * p_scores[at] // 100), high * p_scores[at] // 100
                    row, column = best_in_rows(s, other[mine - start] & (s >= least[:, None]) & (s <= most[:, None]), n)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchors[mine][row], p_ids[at][row], ids[column], p_scores[at][row], s[row, column])],
                                                     ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])

    return run


def _pack_positives(table: pa.Table, order: np.ndarray) -> dict:
    lists = [table["positives"][int(i)].as_py() for i in order]
    flat = [p for ps in lists for p in ps]
    return {"positives": [np.array([len(ps) for ps in lists], np.int64).tobytes()],
            "positive_ids": [np.array([p["positive_id"] for p in flat], np.int64).tobytes()],
            "positive_scores": [np.array([p["positive_score"] for p in flat], np.int64).tobytes()]}


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows of the integer
    ``rows`` (vec_id, vector, label) that meet ``anchors``; ``low`` and ``high`` bound the window in percent of the positive's score."""
    rows = landed(rows, "integer-rows")
    packed, chosen = V.blocks(rows), rows.where(anchors)
    near = per_batch(_positives(positives), POSITIVES)(V.cells(packed, V.groups(chosen)))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    lists = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # few each
    queries = V.groups(landed(chosen.join(lists, "vec_id"), "anchors"), ", positives binary, positive_ids binary, positive_scores binary", _pack_positives)
    hits = per_batch(_negatives(negatives, low, high), NEGATIVES)(V.cells(packed, queries))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return (hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op13_rns_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every embedding whose id is divisible by 50, from the whole table, labels noised as the contract says."""
    table = read_table(spark, sf_dir, "embeddings")
    label = F.when(table["vec_id"] % 7 == 0, (table["label"] + 1) % 10).otherwise(table["label"])
    return mine(V.integer_rows(table, 256, label=label), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score
      FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
