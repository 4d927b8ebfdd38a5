"""Session helpers: shared folder handling, written intermediate tables."""

import pytest
from pyspark.sql import functions as F

from catalytics.session import materialise, scratch_path, shared_dir


def test_missing_shared_folder_is_an_error_on_a_cluster():
    """Without spark.checkpoint.dir a cluster session raises; a local one gets a folder of its own."""
    class Context:
        master, folder = "spark://host:7077", None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Session.sparkContext.master = "local[2]"
    assert shared_dir(Session()) == Session.sparkContext.folder


def test_materialised_tables_are_read_back(spark):
    df = materialise(spark.range(5).withColumn("x", F.lit("a")), "test-materialise")
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().executedPlan().toString().lower()


def test_scratch_paths_are_unique_under_the_shared_folder(spark):
    base = shared_dir(spark)
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(base) and b.startswith(base)
    assert spark.sparkContext.getCheckpointDir()
