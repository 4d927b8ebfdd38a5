"""The forest as a table: equal to the fitted model, and by hand."""

import pytest
from pyspark.sql import functions as F

from catalytics.operators import forest, ml

NODES = "tree int, node int, feature int, threshold double, left int, right int, weight double, gain double, shares array<double>"


def test_scores_and_importances_by_hand(spark):
    nodes = spark.createDataFrame([
        (0, 0, 0, 5.0, 1, 2, 8.0, 0.25, [0.5, 0.5]), (0, 1, None, None, -1, -1, 4.0, None, [1.0, 0.0]), (0, 2, 1, 0.5, 3, 4, 4.0, 0.5, [0.0, 1.0]),
        (0, 3, None, None, -1, -1, 2.0, None, [0.2, 0.8]), (0, 4, None, None, -1, -1, 2.0, None, [0.0, 1.0]),
        (1, 0, None, None, -1, -1, 8.0, None, [0.75, 0.25])], NODES)
    rows = spark.createDataFrame([(1, 5.0, 1), (2, 5.5, 0), (3, 9.0, 1)], "k int, a double, b int").withColumn("tree", F.lit("clash"))
    got = {r.k: (r.probability_1, r.prediction) for r in forest.scores(rows, nodes, ["a", "b"], "k", 2, 2).collect()}
    assert got == {1: (pytest.approx(0.125), 0), 2: (pytest.approx(0.525), 1), 3: (pytest.approx(0.625), 1)}
    assert forest.scores(rows.limit(0), nodes, ["a", "b"], "k", 2, 2).count() == 0
    found = {r.feature: r.importance for r in forest.importances(nodes, ["a", "b", "c"]).collect()}
    assert found == {"a": pytest.approx(0.5), "b": pytest.approx(0.5), "c": 0.0}
    bare = forest.importances(nodes.where("tree = 1"), ["a"]).collect()
    assert [(r.feature, r.importance) for r in bare] == [("a", 0.0)]


def test_table_equals_the_model(spark, tmp_path):
    rows = spark.range(400).select(
        F.col("id").alias("row_seq"), (F.col("id") * 37 % 101).cast("double").alias("price_numeric"), (F.col("id") * 53 % 997).alias("sales_numeric"),
        (F.col("id") % 11 / 2).alias("rating_numeric"), (F.col("id") % 3 == 0).cast("int").alias("has_bestseller_badge"))
    rows = rows.withColumn(ml.LABEL, ((F.col("sales_numeric") > 500) != (F.col("price_numeric") > 60)).cast("int"))
    model = ml.train(rows, num_trees=7, max_depth=5, partitions=2)
    model.write().save(f"{tmp_path}/model")
    nodes = forest.node_table(spark, f"{tmp_path}/model")
    want = {r.row_seq: r for r in ml.predict(model, rows).collect()}
    got = forest.scores(rows, nodes, ml.FEATURES, "row_seq", 7, 5).collect()
    assert len(got) == len(want) == 400 and {r.prediction for r in got} == {0, 1}
    assert all(abs(r.probability_1 - want[r.row_seq].probability_1) < 1e-9 for r in got)
    assert {r.feature: pytest.approx(r.importance) for r in forest.importances(nodes, ml.FEATURES).collect()} == dict(ml.importances(model))


def test_rows_are_dealt_before_the_walk(spark):
    nodes = spark.createDataFrame([(0, 0, 0, 5.0, 1, 2, 8.0, 0.25, [0.5, 0.5]), (0, 1, None, None, -1, -1, 4.0, None, [1.0, 0.0]),
                                   (0, 2, None, None, -1, -1, 4.0, None, [0.0, 1.0])], NODES)
    rows = spark.createDataFrame([(1, 5.0), (6, 5.5), (None, 9.0)], "k int, a double").coalesce(1)
    scored = forest.scores(rows, nodes, ["a", "k"], "k", 1, 1)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1
    assert {r.k: (r.probability_1, r.prediction) for r in scored.collect()} == {1: (0.0, 0), 6: (1.0, 1), None: (1.0, 1)}
