"""Quality classifier: regularised quadratic discriminant analysis.

Documents become a short vector of transformed statistics (``FEATURES``). Per
class (label 0 and 1) Spark sums counts, vectors and outer products; the driver
only sees those fixed-size sums, shrinks each class covariance towards the
pooled one and towards its own diagonal, and keeps the Cholesky factors. The
score of a document is its Mahalanobis log-density difference plus the log prior
ratio, squashed into (0, 1).

Defined cases: a null text is an empty text and is scored. Labels with a null
id or null quality are ignored; an id with several labels counts with its
smallest. With labels of one class only, or none, every document scores 0.5 on
the side of the class that exists (1 where there is none). Repeated rows are
scored one by one. Only ``doc_id`` and ``text`` are read, so further columns may
have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import kernels as K
from .common import documents, landed, per_batch, read_table, texts, tidy

FEATURES = ("log_words", "word_length", "upper", "marks", "mark_runs", "lone_marks", "digits", "repeats", "distinct")
SCHEMA = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)

# classes of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 mark, 5 white space
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 4
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[[9, 10, 11, 12, 13, 32]] = 5


def _share(part: np.ndarray, whole: np.ndarray, prior: float, weight: float = 4.0) -> np.ndarray:
    """Variance-stabilised share; short texts lean towards ``prior``."""
    return np.arcsin(np.sqrt((part + weight * prior) / (whole + weight)))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each document of a run."""
    docs = len(offsets) - 1
    kind = _KIND[data]
    # upper-case letters of the Latin-1 block are C3 80 .. C3 9E
    high = np.zeros(len(data), bool)
    high[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80)
    kind[high] = np.where(data[high] <= 0x9E, 2, 1)
    starts, ends, first = K.words(data, offsets, K.NOT_SPACE)
    hashes = K.word_hash(data, starts, ends)
    doc = np.repeat(np.arange(docs), np.diff(offsets))
    count = np.bincount(doc * 6 + kind, minlength=docs * 6).reshape(docs, 6).astype(float)
    mark = kind == 4
    pairs = np.zeros(len(data), bool)
    pairs[1:] = mark[1:] & mark[:-1] & (doc[1:] == doc[:-1])
    of = np.repeat(np.arange(docs), np.diff(first))
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    lone = mark[starts] & (ends - starts == 1)
    order = np.lexsort((hashes, of))
    sorted_h, sorted_of = hashes[order], of[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_h[1:] != sorted_h[:-1]) | (sorted_of[1:] != sorted_of[:-1])
    per_doc = lambda at: np.bincount(at, minlength=docs).astype(float)
    n_words, letters = np.diff(first).astype(float), count[:, 1] + count[:, 2]
    size = np.diff(offsets).astype(float)
    return np.column_stack([
        np.log1p(n_words),
        np.log((per_doc(np.repeat(of, ends - starts)) + 20) / (n_words + 4)),
        _share(count[:, 2], letters, 0.03, 40),
        _share(count[:, 4], size, 0.03, 40),
        _share(per_doc(doc[pairs]), size, 0.0, 40),
        _share(per_doc(of[lone]), n_words, 0.0),
        _share(count[:, 3], size, 0.0, 40),
        _share(per_doc(of[again]), n_words, 0.01),
        _share(per_doc(sorted_of[new]), np.sqrt(np.maximum(n_words, 1)) * np.sqrt(np.maximum(per_doc(sorted_of[new]), 1)), 1.0),
    ])


def _feature_batches(batch: pa.RecordBatch):
    for rows, data, offsets in K.runs(batch, "text"):
        x = features(data, offsets)
        yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(x[:, j]) for j in range(x.shape[1]))],
                                         ["doc_id", *FEATURES])


def document_features(docs: DataFrame) -> DataFrame:
    return per_batch(_feature_batches, SCHEMA)(texts(docs).select("doc_id", "text"))


@dataclass
class Discriminant:
    """Per class: log prior, mean, inverse Cholesky factor of its covariance, log determinant."""

    parts: list[tuple[float, np.ndarray, np.ndarray, float]]
    constant: float | None = None  # the margin where there are not two classes

    def margin(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for log_prior, mean, inverse, log_det in self.parts:
            z = (x - mean) @ inverse.T
            density.append(log_prior - 0.5 * (log_det + (z * z).sum(axis=1)))
        return density[1] - density[0]


def score_of(margin: np.ndarray) -> np.ndarray:
    """Logistic of the margin, its size taken on a log scale so that far margins stay apart below 1."""
    m = np.sign(margin) * np.log1p(np.abs(margin))
    return 1.0 / (1.0 + np.exp(-m))


def fit(labelled: DataFrame, pool: float = 0.5, diagonal: float = 0.05) -> Discriminant:
    """Fit on ``(label, FEATURES...)``: class covariance, pooled one by weight ``pool``, own diagonal by ``diagonal``."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    sums = labelled.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)),
        *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs))
    found = {}
    for row in sums.where(F.col("label").isin(0, 1)).collect():  # two rows at most
        mean = np.array([row[f"s{i}"] for i in range(d)]) / row["n"]
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = row[f"p{i}_{j}"] / row["n"]
        found[int(row["label"])] = (row["n"], mean, second - np.outer(mean, mean))
    if len(found) < 2:
        return Discriminant([], 0.0 if 0 not in found else -1e-9)
    total = sum(n for n, _, _ in found.values())
    pooled = sum(n * cov for n, _, cov in found.values()) / total
    parts = []
    for label in (0, 1):
        n, mean, cov = found[label]
        cov = (1 - pool) * cov + pool * pooled
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(cov)
        parts.append((float(np.log(n / total)), mean, np.linalg.inv(factor), float(2 * np.log(np.diag(factor)).sum())))
    return Discriminant(parts)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(features_df: DataFrame, labels: DataFrame) -> DataFrame:
    """Feature rows of labelled documents outside the held-out third."""
    marks = (labels.select(labels["doc_id"].cast("long").alias("label_id"), labels["quality"].cast("int").alias("q"))
             .where("label_id is not null and q is not null").groupBy("label_id").agg(F.min("q").alias("label")))
    rows = features_df.where(~held_out(F.col("doc_id")))
    return rows.join(marks, rows["doc_id"] == marks["label_id"]).select("label", *FEATURES)


def score(features_df: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the margin of each feature row."""
    def run(batch: pa.RecordBatch):
        x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))])
        m = model.margin(x)
        s = score_of(m)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(m)],
                                         ["doc_id", "score", "predicted", "margin"])

    out = per_batch(run, "doc_id long, score double, predicted int, margin double")(features_df)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "margin")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled part of ``docs`` and score all of it; the texts are read once."""
    rows = landed(document_features(docs), "quality-features")
    return score(rows, fit(training_rows(rows, labels)))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """Filter: the rows of ``docs`` that the classifier accepts, all columns as they are."""
    model = fit(training_rows(document_features(docs), labels))  # sets small batches, too

    def run(batch: pa.RecordBatch):
        for rows, data, offsets in K.runs(batch, text_col):
            yield rows.filter(pa.array(score_of(model.margin(features(data, offsets))) >= 0.5))

    return docs.mapInArrow(tidy(lambda batches: (out for b in batches for out in run(b))), docs.schema)


def op7_qda_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))
