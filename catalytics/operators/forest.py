"""A saved forest as a table of nodes: scores and importances as joins and aggregates.

The table has a row per node of each tree, at most trees * (2 ** (depth + 1) - 1) of them, whatever the size of the
training data. Rows are scored by walking all trees a level at a time: each level is one equi-join of (tree, node), which
Spark broadcasts if the table is as small as it should be, so the walk is one narrow stage and the votes are summed by row.
The few bytes of a row make much work, so rows are dealt by key first; the votes then are where they are summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of the model saved under ``path``: tree, node, feature and threshold (null in leaves), left, right, weight of its
    training rows, gain, share of each class."""
    n = F.col("nodeData")
    inner, weight = n["leftChild"] >= 0, F.aggregate(n["impurityStats"], F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), F.when(inner, n["split"]["featureIndex"]).alias("feature"),
        F.when(inner, F.get(n["split"]["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), weight.alias("weight"), F.when(inner, n["gain"]).alias("gain"),
        F.transform(n["impurityStats"], lambda x: F.when(weight > 0, x / weight).otherwise(0.0)).alias("shares"))


def scores(rows: DataFrame, nodes: DataFrame, features: list[str], key: str, trees: int, depth: int) -> DataFrame:
    """M5: ``key``, probability of class 1 and class of every row, from the node table.

    A value goes left if it is at most the threshold. A row's probability is the mean share of class 1 in the leaves it
    reaches; class 1 needs more than half. ``depth`` is the most levels below a root. Features are numbers and
    not null, keys are distinct. No rows give no rows.
    """
    inner = nodes.where(F.col("feature").isNotNull()).select("tree", F.col("node").alias("at"), "feature", "threshold", "left", "right")
    dealt = rows.select(*dict.fromkeys([key, *features])).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    state = dealt.select(F.col(key), F.array(*[F.col(c).cast("double") for c in features]).alias("values"),
                        F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("at", F.lit(0))
    for _ in range(depth):
        goes = F.when(F.get("values", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        state = state.join(inner, ["tree", "at"], "left").select(
            key, "values", "tree", F.when(F.col("feature").isNull(), F.col("at")).otherwise(goes).alias("at"))
    leaves = nodes.select("tree", F.col("node").alias("at"), F.coalesce(F.get("shares", F.lit(1)), F.lit(0.0)).alias("share"))
    votes = state.join(leaves, ["tree", "at"]).groupBy(key).agg((F.sum("share") / F.lit(float(trees))).alias("probability_1"))
    return votes.withColumn("prediction", (F.col("probability_1") > 0.5).cast("int"))


def importances(nodes: DataFrame, features: list[str]) -> DataFrame:
    """M6: feature, importance: gains times weights by feature as shares of their tree, then of all trees.

    A feature that no node asks for has 0; a forest of bare leaves gives 0 for all.
    """
    spent = nodes.where(F.col("feature").isNotNull()).groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("weight")).alias("v"))
    whole = spent.groupBy("tree").agg(F.sum("v").alias("whole"))
    shares = spent.join(whole, "tree").groupBy("feature").agg(F.sum(F.when(F.col("whole") > 0, F.col("v") / F.col("whole"))).alias("share"))
    total = shares.select(F.sum("share")).scalar()
    names = nodes.sparkSession.createDataFrame(list(enumerate(features)), "feature int, name string")
    return names.join(shares, "feature", "left").select(F.col("name").alias("feature"),
                                                        F.coalesce(F.col("share") / total, F.lit(0.0)).alias("importance"))
