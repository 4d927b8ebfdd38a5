"""Incremental KPIs equal those of the whole table; a repeated batch and a compaction change nothing."""

from pyspark.sql import functions as F

from catalytics.streaming import kpi_state

SCHEMA = "store_domain string, product_id long, vendor string, product_type string, price double, available boolean"


def variants(n):
    return [(f"s{i % 3}", i % 17, ["a", "b", None][i % 3 if i % 2 else 0], f"t{i % 5}", None if i % 7 == 0 else i * 1.5, [True, False, None][i % 3 - i % 2])
            for i in range(n)] + [("lonely", 1, "v", "t", None, None)]


def whole(df):
    avail = F.coalesce(F.col("available"), F.lit(False))
    return sorted(map(tuple, df.groupBy("store_domain").agg(
        F.count(F.lit(1)), F.count_if(avail), F.count_if(~avail), F.count_distinct("product_id"), F.count_distinct("vendor"), F.count_distinct("product_type"),
        F.round(F.avg("price"), 6), F.min("price"), F.max("price")).collect()))


def kpis(spark, folder):
    return sorted(map(tuple, kpi_state.read(spark, folder).collect()))


def test_batches_add_up(spark, tmp_path):
    folder, rows = str(tmp_path / "state"), variants(200)
    df = spark.createDataFrame(rows, SCHEMA)
    first, second, third = (spark.createDataFrame(part, SCHEMA) for part in (rows[:70], rows[70:150], rows[150:]))
    kpi_state.add(first, folder, 0)
    assert kpis(spark, folder) == whole(first)
    kpi_state.add(second, folder, 1)
    kpi_state.add(second, folder, 1)  # run again
    assert kpis(spark, folder) == whole(first.unionByName(second))
    kpi_state.compact(spark, folder)
    kpi_state.compact(spark, folder)
    assert kpis(spark, folder) == whole(first.unionByName(second))
    kpi_state.add(third, folder, 2)
    assert kpis(spark, folder) == whole(df)


def test_a_batch_without_rows(spark, tmp_path):
    folder = str(tmp_path / "state")
    kpi_state.add(spark.createDataFrame([], SCHEMA), folder, 0)
    assert kpis(spark, folder) == []
