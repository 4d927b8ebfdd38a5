"""Incremental refresh: each file is processed once; a refresh without new files adds nothing."""

from pyspark.sql import functions as F

from catalytics.session import scratch_path
from catalytics.sources import files
from catalytics.streaming.refresh import refresh


def test_refresh_is_incremental_and_idempotent(spark):
    base = scratch_path(spark, "test-refresh")
    landing, table, ckpt = f"{base}/landing", f"{base}/table", f"{base}/ckpt"
    schema = files.string_schema(["k", "v"])
    drop1 = spark.createDataFrame([("1", "a"), ("2", "b")], "k string, v string")
    drop2 = spark.createDataFrame([("3", "c")], "k string, v string")
    files.write_csv(drop1, landing, mode="append")
    rows = lambda: spark.read.parquet(table).count()
    refresh(spark, landing, table, ckpt, schema)
    assert rows() == 2
    refresh(spark, landing, table, ckpt, schema)
    assert rows() == 2
    files.write_csv(drop2, landing, mode="append")
    refresh(spark, landing, table, ckpt, schema)
    assert rows() == 3
    got = sorted(r.k for r in spark.read.parquet(table).select(F.col("k")).collect())
    assert got == ["1", "2", "3"]


def _bytes_of(folder):
    import os
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, names in os.walk(folder) for f in names)


def test_landed_drops_are_compressed_and_leave_no_shuffle_files(spark, monkeypatch):
    """The landing folder held the text of all rows, and the joins' shuffle files stayed until the driver collected its garbage."""
    from catalytics.plans import io_queries
    from conftest import SF_SMALL

    folders, text = {}, []
    scratch, write = io_queries.scratch_path, files.write_csv
    monkeypatch.setattr(io_queries, "scratch_path", lambda s, name: folders.setdefault(name, scratch(s, name)))

    def written(df, path, **how):
        text.append(df.selectExpr("sum(octet_length(concat_ws(',', *)))").first()[0])
        write(df, path, **how)

    monkeypatch.setattr(files, "write_csv", written)
    monkeypatch.setattr(io_queries, "DROP_ROWS", 500)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in map(str, tracker.getAllFiles().mkString("\n").split("\n")) if "/shuffle_" in f}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    before = shuffles()
    got = io_queries.q_incremental_refresh(spark, SF_SMALL)
    left = shuffles() - before
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    landing = folders["refresh"].removeprefix("file:") + "/landing"
    assert got.count() == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count() and len(text) == 2
    assert _bytes_of(landing) < sum(text) / 4
    assert spark.read.text(landing).inputFiles() and all(f.endswith(".csv.gz") for f in spark.read.text(landing).inputFiles())
    assert sum(1 for _ in left) == 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
