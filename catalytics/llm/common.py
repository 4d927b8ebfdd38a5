"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import read_table, scratch_path
from . import kernels as K


#: Rows and bytes of a batch that passes between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 1024, "4m"


def small_batches(spark: SparkSession) -> None:
    """Keep the memory of a worker's batch small: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return read_table(spark, sf_dir, "documents")


def landed(df: DataFrame, name: str, **options) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not the work above it,
    and tables that are used twice are computed once. ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id long, text string, tkey long)`` of a table; other columns, whatever their names, stay out.

    ``tkey`` hashes the text. ``(doc_id, tkey)`` names a row by its content, so
    that a re-read finds it again whatever the partitioning: rows that agree in
    both are copies of one row and every operator treats them alike.
    """
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("tkey"),
    )


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Join condition of two frames that carry ``(doc_id, tkey)``; null ids meet each other."""
    return a["tkey"].eqNullSafe(b["tkey"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def attach(docs: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text, spans)`` of documents that may have a row in ``lists`` (doc_id, tkey, spans), and
    ``(doc_id, text, tkey)`` of the rest, which no shuffle sees."""
    from . import prefilter

    lists = landed(lists, "spans")
    some, none = prefilter.split(texts(docs), "tkey", prefilter.bitmap(lists, "tkey"))
    joined = some.join(lists, same_row(some, lists), "left")
    return joined.select(some["doc_id"], "text", F.coalesce("spans", F.array().cast(lists.schema["spans"].dataType)).alias("spans")), none


def per_batch(function: Callable, schema: str) -> Callable[[DataFrame], DataFrame]:
    """``df -> df.mapInArrow`` of ``function(batch) -> iterable of batches`` with ``schema``."""
    def run(batches: Iterator):
        for batch in batches:
            yield from function(batch)

    return lambda df: df.mapInArrow(tidy(run), schema)


def tidy(run: Callable) -> Callable:
    """``run(batches)`` that gives its memory back to the system when a task ends: workers outlive their tasks."""
    def whole(batches: Iterator):
        yield from run(batches)
        K.release()

    return whole


def tidy_group(run: Callable) -> Callable:
    """The same for a function of a group's table."""
    def whole(table):
        out = run(table)
        K.release()
        return out

    return whole
