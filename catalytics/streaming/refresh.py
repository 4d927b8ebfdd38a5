"""Incremental refresh of an append-only landing folder (S7 + S8).

The original appends scraped rows to one CSV and, on "refresh", drops its
cache and re-reads everything. Here new rows land as new files (S7,
``mode='append'``) and a file-source stream with ``trigger(availableNow=True)``
processes only files it has not seen, recorded in its checkpoint; the typed
rows become a new part of a Parquet table that dashboards read. Re-running after
an executor loss or a driver restart resumes from the checkpoint, and a batch that is
run again replaces its own part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources import quoted_csv


def refresh(spark: SparkSession, landing_dir: str, table_dir: str, checkpoint_dir: str, schema: T.StructType,
            transform: Callable[[DataFrame], DataFrame] | None = None, header: bool = True, multi_line: bool = False,
            state: Callable[[DataFrame, int], None] | None = None) -> None:
    """Process every file that landed since the last refresh.

    ``multi_line``: quoted fields may hold line breaks; files are still read in splits (``quoted_csv``). The typed rows
    of a refresh are written to ``table_dir/batch=<n>``, replacing what an interrupted run of the same batch left there. ``state`` is called with the
    rows of the batch, as written, and its number, e.g. to merge them into KPIs (``kpi_state``).
    """
    if multi_line:
        src = spark.readStream.text(landing_dir, lineSep="\n").select("value", "_metadata")
    else:
        src = spark.readStream.schema(schema).option("header", header).option("escape", '"').csv(landing_dir)

    def write(batch: DataFrame, number: int) -> None:
        rows = quoted_csv.parse(quoted_csv.records(batch, header), schema) if multi_line else batch
        path = f"{table_dir}/batch={number}"
        (transform(rows) if transform else rows).write.mode("overwrite").option("compression", "zstd").parquet(path)
        if state:
            state(batch.sparkSession.read.parquet(path), number)

    q = src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()
    q.awaitTermination()
