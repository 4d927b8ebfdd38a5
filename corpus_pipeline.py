"""Training-data pipeline over ``documents``: classify, de-duplicate, decontaminate, mix, write token ids.

Every stage takes what the one before kept, as a written table. All but the
last return the columns of ``documents`` unchanged; the last returns the documents of
the token store it wrote.

Defined cases, for every stage: a null text is an empty text, a null id is an id of its own, columns of any name and type are
handed on as they are, and an empty table gives an empty one. Texts of any length are read whole. What the stages do with nulls, empty texts,
ties and repeated rows beyond that is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalytics.llm import decontaminate, mixing, near_dup, quality, token_store
from catalytics.llm.common import documents, landed, read_table

ORACLE_SQL = None  # the classifier, the mix and the tokenizer are not SQL


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    An empty text is scored as any other, a score of exactly one half stays, repeated rows share their score and so stay or go
    together. Without labels of two classes nothing can be told apart: all rows score alike.
    """
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each class of near-duplicates.

    A null id counts as the smallest, rows of one id are told apart by a hash of their text, and one of several
    equal rows stays. Null and empty texts are copies of each other, so one of them stays; a text under five words is one shingle.
    """
    return near_dup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item.

    Empty texts, and all texts where the benchmark has no words, hold none and stay; repeated rows stay or go together.
    """
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix of sources asks, up to three times.

    Texts without words take no share and go. A null source is a source of its own, last in order; repeated
    rows are documents of their own. Draws depend on content only, so that reruns agree.
    """
    return mixing.repeat_rows(docs, mixing.mix(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token ids and return the stored documents: doc_id, start, n_tokens, ids_crc32.

    An empty text is stored as the end id alone. Null ids come first, rows of one id in the order of a hash of their text;
    repeated rows are stored as often as they occur.
    """
    return token_store.encode_and_read(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
    ("token ids", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on the written table of the one before."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
