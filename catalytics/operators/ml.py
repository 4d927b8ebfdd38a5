"""Attractiveness classifier: label, split, train, evaluate, score (M1-M8).

* Labels (P17) are built from native expressions; median imputation (P18)
  uses exact, distributed medians as scalar subqueries.
* The stratified split (M2) is exact and repeatable *and* distributed: rows
  are ordered per class by a seeded hash; the class's test quota is found
  from a per-(class, hash-bucket) count table (a few thousand rows), so no
  task ever ranks a whole class - only the one boundary bucket is ranked.
* The model is Spark ML's random forest with balanced class weights.
* Metrics come from the confusion counts (a 4-row aggregate).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import materialise
from .stats import quantiles

FEATURES = ["price_numeric", "sales_numeric", "rating_numeric", "has_bestseller_badge"]
LABEL = "is_attractive"


def attractiveness_points(sales: Column, rating: Column, badge: Column) -> Column:
    """Sales > 500 (+1), > 2000 (+1), rating > 4.0 (+1), > 4.5 (+1), badge (+2)."""
    pts = ((sales > fixed.SALES_THRESHOLD_LOW).cast("int") + (sales > fixed.SALES_THRESHOLD_HIGH).cast("int")
           + (rating > fixed.RATING_THRESHOLD_GOOD).cast("int") + (rating > fixed.RATING_THRESHOLD_EXCELLENT).cast("int")
           + F.when(badge == 1, F.lit(fixed.BADGE_POINTS)).otherwise(F.lit(0)))
    return F.coalesce(pts, F.lit(0))


def preprocess(cleaned_b: DataFrame, threshold: int = fixed.ATTRACTIVENESS_SCORE_THRESHOLD,
               flip_single_class: bool = False, order_key: str = "row_seq") -> DataFrame:
    """M1: impute (P18), label (P17), drop incomplete rows.

    ``flip_single_class`` (M7) flips the label of the first row when only one
    class is present; it falsifies data, so it is off by default.

    The cleaned rows are written once with the columns they have (so pass no others than are needed): what parses them would
    otherwise be repeated in the medians, in the check for incomplete rows and wherever the result is used.
    """
    cleaned_b = materialise(cleaned_b, "cleaned")
    medians = quantiles(cleaned_b, ["price_numeric", "rating_numeric"], [0.5], written=True)
    price, rating = (medians.where(F.col("column") == c).select("value").scalar() for c in ("price_numeric", "rating_numeric"))
    df = cleaned_b.withColumns({
        "price_numeric": F.coalesce(F.col("price_numeric"), price),
        "sales_numeric": F.coalesce(F.col("sales_numeric"), F.lit(0).cast("bigint")),
        "rating_numeric": F.coalesce(F.col("rating_numeric"), rating),
    })
    pts = attractiveness_points(F.col("sales_numeric"), F.col("rating_numeric"), F.col("has_bestseller_badge"))
    df = df.withColumn("attractiveness_score", pts) \
           .withColumn(LABEL, (F.col("attractiveness_score") >= threshold).cast("int"))
    df = df.dropna(subset=FEATURES + [LABEL])
    if flip_single_class:
        stats = df.select(F.count_distinct(LABEL).alias("k"), F.count(F.lit(1)).alias("n"),
                          F.min(order_key).alias("first"))
        flip = ((stats.select("k").scalar() == 1) & (stats.select("n").scalar() > 1)
                & (F.col(order_key) == stats.select("first").scalar()))
        df = df.withColumn(LABEL, F.when(flip, 1 - F.col(LABEL)).otherwise(F.col(LABEL)))
    return df


def class_balance(df: DataFrame) -> DataFrame:
    """A10: rows per class."""
    return df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))


def require_classes(df: DataFrame, label: str = LABEL) -> None:
    """Guard of A10 / M3: a model needs rows of two classes."""
    found = df.select(label).distinct().limit(2).count()
    if found < 2:
        raise ValueError(f"the classifier needs rows of two classes, found {found}")


def test_quota(counts: DataFrame, share: float = fixed.TEST_SHARE, label: str = LABEL) -> DataFrame:
    """Test rows per class, allocated like a stratified train/test splitter.

    ``n_test = ceil(share * n)``; the train part gets ``floor(n_train * n_c / n)``
    per class plus one for each of the classes with the largest remainders
    until ``n_train`` is reached (equal remainders: smaller label first); the
    test part of a class is the rest. Works on the per-class counts only (one
    row per class), so the windows here are over a handful of rows.
    """
    per = counts.groupBy(label).agg(F.sum("_c").alias("_n_c"))
    everything = Window.partitionBy()
    n = F.sum("_n_c").over(everything)
    n_train = n - F.ceil(n * F.lit(share))
    per = per.withColumns({"_cont": (F.col("_n_c") / n) * n_train})
    per = per.withColumns({"_floor": F.floor("_cont"), "_rem": F.col("_cont") - F.floor("_cont")})
    need = n_train - F.sum("_floor").over(everything)
    order = Window.orderBy(F.desc("_rem"), F.col(label))
    train_c = F.col("_floor") + F.when(F.row_number().over(order) <= need, 1).otherwise(0)
    return per.select(label, (F.col("_n_c") - train_c).alias("_k"))


def stratified_split(df: DataFrame, key: str = "row_seq", share: float = fixed.TEST_SHARE,
                     seed: int = fixed.SEED, label: str = LABEL, bucket_bits: int = 16) -> DataFrame:
    """M2: exact stratified split; adds ``part`` = 'test' | 'train'.

    Per class, the test part is the ``test_quota`` rows with the smallest
    ``(xxhash64(key, seed), key)``. Hash buckets (top ``bucket_bits``
    bits) give per-class cumulative counts; only rows of the single boundary
    bucket of each class are ranked exactly.
    """
    h = F.xxhash64(F.col(key), F.lit(seed))
    d = df.withColumns({"_h": h, "_b": F.shiftright(h, 64 - bucket_bits)})
    counts = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("_cum", F.sum("_c").over(w)).join(test_quota(counts, share, label), label)
    quota = F.col("_k")
    boundary = (cum.where(F.col("_cum") >= quota)
                .groupBy(label)
                .agg(F.min_by(F.struct("_b", (F.col("_cum") - F.col("_c")).alias("_before"),
                                       quota.alias("_kk")), F.col("_b")).alias("_x"))
                .select(label, F.col("_x._b").alias("_bb"), F.col("_x._before").alias("_before"),
                        F.col("_x._kk").alias("_k")))
    # one row per class: a proven size bound for a broadcast
    j = d.join(F.broadcast(boundary), on=label, how="left")
    edge = j.where(F.col("_b") == F.col("_bb"))
    ranked = edge.withColumn("_r", F.row_number().over(
        Window.partitionBy(label, "_b").orderBy("_h", key)))
    edge_part = ranked.withColumn("part", F.when(F.col("_r") <= F.col("_k") - F.col("_before"), "test")
                                  .otherwise("train")).drop("_r")
    rest = j.where(F.col("_bb").isNull() | (F.col("_b") != F.col("_bb"))).withColumn(
        "part", F.when(F.col("_b") < F.col("_bb"), "test").otherwise("train"))
    out = rest.unionByName(edge_part)
    return out.drop("_h", "_b", "_bb", "_before", "_k")


def balanced_weights(train: DataFrame, label: str = LABEL) -> DataFrame:
    """``n / (n_classes * n_class)`` per row (class_weight='balanced')."""
    per = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = train.select(F.count(F.lit(1))).scalar()
    k = per.select(F.count(F.lit(1))).scalar()
    wt = per.select(label, (tot / (k * F.col("_nc"))).cast("double").alias("weight"))
    return train.join(F.broadcast(wt), on=label)  # one row per class


def assemble(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return va.transform(df.withColumns({c: F.col(c).cast("double") for c in FEATURES}))


def train(train_df: DataFrame, num_trees: int = fixed.NUM_TREES, seed: int = fixed.SEED,
          max_depth: int = 10, key: str = "row_seq", partitions: int | None = None):
    """M3: random forest on the weighted, assembled training rows.

    Spark's forest depends on partitioning, so rows are hash-partitioned by
    the key first (into the session's shuffle partitions, if not told otherwise): the same
    input and number of partitions give the same model.
    """
    from pyspark.ml.classification import RandomForestClassifier
    require_classes(train_df)
    partitions = partitions or int(train_df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = assemble(balanced_weights(train_df)).repartition(partitions, key)
    rf = RandomForestClassifier(featuresCol="features", labelCol=LABEL, weightCol="weight",
                                numTrees=num_trees, seed=seed, maxDepth=max_depth,
                                # larger node batches: fewer passes over the data per tree level
                                maxMemoryInMB=1024)
    return rf.fit(data)


def predict(model, df: DataFrame) -> DataFrame:
    """M5: predicted class and probability of class 1."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(assemble(df))
    return out.withColumns({"prediction": F.col("prediction").cast("int"),
                            "probability_1": F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(0.0))}) \
              .drop("features", "rawPrediction", "probability")


def report(pred: DataFrame, label: str = LABEL) -> DataFrame:
    """M4: accuracy and per-class precision / recall / F1 / support, plus macro
    and weighted averages; a zero division gives 0.

    Built from the confusion counts (<= 4 rows), one output row per class /
    average, with ``accuracy`` repeated on each row.
    """
    cm = pred.groupBy(label, "prediction").agg(F.count(F.lit(1)).alias("n"))
    per = []
    for c in (0, 1):
        per.append(cm.agg(
            F.lit(str(c)).alias("class"),
            F.sum(F.when((F.col(label) == c) & (F.col("prediction") == c), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when((F.col(label) != c) & (F.col("prediction") == c), F.col("n")).otherwise(0)).alias("fp"),
            F.sum(F.when((F.col(label) == c) & (F.col("prediction") != c), F.col("n")).otherwise(0)).alias("fn"),
        ))
    t = per[0].unionByName(per[1])
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    t = t.select("class", prec.alias("precision"), rec.alias("recall"),
                 (F.col("tp") + F.col("fn")).cast("bigint").alias("support"))
    t = t.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                  2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                     .otherwise(0.0))
    n = F.sum("support")
    macro = t.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), n.cast("bigint").alias("support"), F.avg("f1").alias("f1"))
    weighted = t.agg(F.lit("weighted avg").alias("class"),
                     (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
                     (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
                     n.cast("bigint").alias("support"),
                     (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"))
    acc = pred.select((F.sum((F.col(label) == F.col("prediction")).cast("int")) / F.count(F.lit(1))).alias("a"))
    return t.unionByName(macro).unionByName(weighted).withColumn("accuracy", acc.scalar())


def importances(model) -> list[tuple[str, float]]:
    """M6: feature importances, largest first (a 4-entry list on the driver)."""
    vals = model.featureImportances.toArray().tolist()
    return sorted(zip(FEATURES, vals), key=lambda t: -t[1])


def train_job(spark, listings: DataFrame, out_dir: str) -> DataFrame:
    """M8: listings -> M1 -> M2 -> M3 -> save model (S9), metrics.

    Returns the saved metrics read back (one row: accuracy and class-1
    precision / recall / F1, rounded to 4 places).
    """
    from .listings import clean_b
    data = preprocess(clean_b(listings).select("row_seq", *FEATURES))
    split = materialise(stratified_split(data), "split")  # cut lineage before the iterative fit
    model = train(split.where(F.col("part") == "train"))
    model.write().overwrite().save(f"{out_dir}/model")
    rep = report(predict(model, split.where(F.col("part") == "test")))
    metrics = rep.where(F.col("class") == "1").select(
        F.round("accuracy", 4).alias("accuracy"), F.round("precision", 4).alias("precision_1"),
        F.round("recall", 4).alias("recall_1"), F.round("f1", 4).alias("f1_1"))
    metrics.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/metrics")
    return spark.read.parquet(f"{out_dir}/metrics")
