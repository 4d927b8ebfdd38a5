"""Registered classifier queries and their DuckDB oracles (where SQL applies)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import forest
from ..operators import listings as L
from ..operators import ml
from ..session import materialise, scratch_path
from . import fixtures
from . import sql as S

R = 6


def labelled(spark, sf, **kw):
    return ml.preprocess(L.clean_b(fixtures.listings_raw(spark, sf)).select("row_seq", *ml.FEATURES), **kw)


def q_ml_labels(spark, sf):
    return labelled(spark, sf).select("row_seq", *ml.FEATURES, "attractiveness_score", ml.LABEL)


def q_class_balance(spark, sf):
    return ml.class_balance(labelled(spark, sf))


def q_preprocess_counts(spark, sf):
    raw = fixtures.listings_raw(spark, sf)
    n_raw = raw.select(F.count(F.lit(1))).scalar()
    return labelled(spark, sf).agg(F.count(F.lit(1)).alias("n_processed")).select(
        n_raw.alias("n_raw"), "n_processed")


def q_ml_split(spark, sf):
    s = ml.stratified_split(labelled(spark, sf))
    return s.groupBy(ml.LABEL, "part").agg(F.count(F.lit(1)).alias("n"))


def q_single_class_flip(spark, sf):
    # a threshold no listing reaches: one class only, so the first row is flipped
    return labelled(spark, sf, threshold=100, flip_single_class=True).select("row_seq", ml.LABEL)


def _split(spark, sf):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # files of like size: what reads them does much work a byte
    return materialise(ml.stratified_split(labelled(spark, sf)).repartition(parts, "row_seq"), "split")


def _fit(spark, sf):
    """Split and a forest fitted on its training part (every query fits its own)."""
    split = _split(spark, sf)
    return split, ml.train(split.where(F.col("part") == "train"))


def _share(c):
    return F.col(c).between(0.0, 1.0)


def q_report_rule(spark, sf):
    """M4 with a rule as the model: the badge predicts the label."""
    pred = labelled(spark, sf).withColumn("prediction", F.col("has_bestseller_badge"))
    rep = ml.report(pred)
    return rep.select("class", *[F.round(c, R).alias(c) for c in ("precision", "recall", "f1")], "support",
                      F.round("accuracy", R).alias("accuracy"))


def q_ml_metrics(spark, sf):
    """M3 + M4: the report's checkable facts - supports are those of the split, scores are shares, F1 follows from them."""
    split, model = _fit(spark, sf)
    rep = ml.report(ml.predict(model, split.where(F.col("part") == "test")))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return rep.select("class", "support", (_share("precision") & _share("recall") & _share("accuracy")).alias("shares"),
                      (F.col("class").endswith("avg") | (F.abs(f1 - F.col("f1")) < 1e-9)).alias("f1_follows"))


def q_ml_predict(spark, sf):
    """M5: every labelled listing is scored; the class follows from its probability."""
    split, model = _fit(spark, sf)
    out = ml.predict(model, split)  # both parts: all labelled rows
    return out.select("row_seq", _share("probability_1").alias("share"),
                      (F.col("prediction") == (F.col("probability_1") > 0.5).cast("int")).alias("class_follows"))


def q_ml_importance(spark, sf):
    """M6: importances of the forest fitted on the given tables: shares that sum to 1, largest first."""
    split, model = _fit(spark, sf)
    found = ml.importances(model)
    values = [v for _, v in found]
    rows = [(f, bool(0.0 <= v <= 1.0), abs(sum(values) - 1.0) < 1e-9, values == sorted(values, reverse=True)) for f, v in found]
    facts = spark.createDataFrame(rows, "feature string, share boolean, sum_is_one boolean, ordered boolean")
    n = split.where(F.col("part") == "train").select(F.count(F.lit(1))).scalar()
    return facts.withColumn("trained_on", n)


def q_model_table(spark, sf):
    """All labelled listings scored by joins with the saved forest's nodes, beside the model's own scores."""
    split, model = _fit(spark, sf)
    path = scratch_path(spark, "model-table")
    model.write().save(path)
    own = forest.scores(split, forest.node_table(spark, path), ml.FEATURES, "row_seq", fixed.NUM_TREES, model.getOrDefault("maxDepth"))
    other = ml.predict(model, split).select("row_seq", F.col("probability_1").alias("p"), F.col("prediction").alias("c"))
    return other.join(own, "row_seq", "left").select(
        "row_seq", F.coalesce(F.abs(F.col("p") - F.col("probability_1")) < 1e-9, F.lit(False)).alias("same_probability"),
        F.coalesce((F.col("c") == F.col("prediction")) | (F.abs(F.col("p") - 0.5) < 1e-9), F.lit(False)).alias("same_class"))


def q_model_importance(spark, sf):
    """M6: importances from the saved forest's nodes, beside the model's own."""
    _, model = _fit(spark, sf)
    path = scratch_path(spark, "model-table")
    model.write().save(path)
    own = forest.importances(forest.node_table(spark, path), ml.FEATURES)
    other = spark.createDataFrame(ml.importances(model), "feature string, p double")
    return other.join(own, "feature", "left").select(
        "feature", F.coalesce(F.abs(F.col("p") - F.col("importance")) < 1e-9, F.lit(False)).alias("same_importance"))


def q_train_job(spark, sf):
    """The saved model, read back, agrees with the saved metrics and scores all listings."""
    from pyspark.ml.classification import RandomForestClassificationModel

    path = scratch_path(spark, "train-job")
    raw = fixtures.listings_raw(spark, sf)
    saved = ml.train_job(spark, raw, path)
    model = RandomForestClassificationModel.load(f"{path}/model")
    split = _split(spark, sf)
    again = ml.report(ml.predict(model, split.where(F.col("part") == "test"))).where(F.col("class") == "1").select(
        F.round("accuracy", 4).alias("accuracy_again"), F.round("f1", 4).alias("f1_again"), "support")
    scored = ml.predict(model, split).select(F.count_if(_share("probability_1"))).scalar()
    return saved.join(again, F.lit(True)).select(  # one row each
        (F.col("accuracy") == F.col("accuracy_again")).alias("same_accuracy"), (F.col("f1_1") == F.col("f1_again")).alias("same_f1"),
        F.col("support").alias("test_support_1"), scored.alias("n_scored"))


QUERIES = {
    "q_ml_labels": q_ml_labels,
    "q_class_balance": q_class_balance,
    "q_preprocess_counts": q_preprocess_counts,
    "q_ml_split": q_ml_split,
    "q_single_class_flip": q_single_class_flip,
    "q_report_rule": q_report_rule,
    "q_ml_metrics": q_ml_metrics,
    "q_ml_predict": q_ml_predict,
    "q_ml_importance": q_ml_importance,
    "q_model_table": q_model_table,
    "q_model_importance": q_model_importance,
    "q_train_job": q_train_job,
}

LABELS = S.LISTINGS_RAW + f""",
b AS (
  SELECT row_seq, {S.price_b('price')} AS price_numeric, CAST({S.sales_b('sales_info')} AS BIGINT) AS sales_numeric,
         {S.rating_b('rating')} AS rating_numeric, {S.badge('additional_badges')} AS has_bestseller_badge
  FROM listings_raw
),
imp AS (
  SELECT row_seq, coalesce(price_numeric, (SELECT median(price_numeric) FROM b)) AS price_numeric,
         coalesce(sales_numeric, 0) AS sales_numeric,
         coalesce(rating_numeric, (SELECT median(rating_numeric) FROM b)) AS rating_numeric, has_bestseller_badge
  FROM b
),
lab AS (
  SELECT *, CAST(sales_numeric > 500 AS INTEGER) + CAST(sales_numeric > 2000 AS INTEGER)
            + CAST(rating_numeric > 4.0 AS INTEGER) + CAST(rating_numeric > 4.5 AS INTEGER)
            + CASE WHEN has_bestseller_badge = 1 THEN 2 ELSE 0 END AS attractiveness_score
  FROM imp
),
labelled AS (
  SELECT *, CAST(attractiveness_score >= 3 AS INTEGER) AS is_attractive FROM lab
  WHERE price_numeric IS NOT NULL AND sales_numeric IS NOT NULL AND rating_numeric IS NOT NULL
)"""

# rows per class of the split's parts
SPLIT = """
, c AS (SELECT is_attractive, count(*) AS n_c FROM labelled GROUP BY 1),
t0 AS (SELECT *, sum(n_c) OVER () AS n, sum(n_c) OVER () - CAST(ceil(sum(n_c) OVER () * 0.25) AS BIGINT) AS n_train
      FROM c),
a AS (SELECT *, (CAST(n_c AS DOUBLE) / n) * n_train AS cont FROM t0),
f0 AS (SELECT *, floor(cont) AS fl, cont - floor(cont) AS rem FROM a),
g AS (SELECT *, n_train - sum(fl) OVER () AS need, row_number() OVER (ORDER BY rem DESC, is_attractive) AS r FROM f0),
q AS (SELECT is_attractive, n_c, CAST(fl + CASE WHEN r <= need THEN 1 ELSE 0 END AS BIGINT) AS tr FROM g)"""

ORACLE = {
    "q_ml_labels": S.with_ctes(LABELS, """
SELECT row_seq, price_numeric, sales_numeric, rating_numeric, has_bestseller_badge, attractiveness_score,
       is_attractive FROM labelled"""),
    "q_class_balance": S.with_ctes(LABELS, "SELECT is_attractive, count(*) AS n FROM labelled GROUP BY 1"),
    "q_preprocess_counts": S.with_ctes(LABELS, """
SELECT (SELECT count(*) FROM listings_raw) AS n_raw, count(*) AS n_processed FROM labelled"""),
    "q_ml_split": S.with_ctes(LABELS, SPLIT + """
SELECT is_attractive, 'test' AS part, n_c - tr AS n FROM q WHERE n_c - tr > 0
UNION ALL SELECT is_attractive, 'train' AS part, tr AS n FROM q WHERE tr > 0"""),
    "q_report_rule": S.with_ctes(LABELS, f"""
, m AS (SELECT c, count(*) FILTER (is_attractive = c AND has_bestseller_badge = c) AS tp,
               count(*) FILTER (is_attractive <> c AND has_bestseller_badge = c) AS fp,
               count(*) FILTER (is_attractive = c AND has_bestseller_badge <> c) AS fn
        FROM labelled, (VALUES (0), (1)) AS k(c) GROUP BY c),
p AS (SELECT CAST(c AS VARCHAR) AS class, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, tp + fn AS support FROM m),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM p),
r AS (SELECT class, precision, recall, f1, support FROM f
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                       sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT class, round(precision, {R}) AS precision, round(recall, {R}) AS recall, round(f1, {R}) AS f1,
       CAST(support AS BIGINT) AS support,
       (SELECT round(avg(CAST(is_attractive = has_bestseller_badge AS INTEGER)), {R}) FROM labelled) AS accuracy FROM r"""),
    "q_ml_metrics": S.with_ctes(LABELS, SPLIT + """
, t AS (SELECT is_attractive, n_c - tr AS n FROM q)
SELECT CAST(is_attractive AS VARCHAR) AS class, n AS support, true AS shares, true AS f1_follows FROM t
UNION ALL SELECT 'macro avg', CAST(sum(n) AS BIGINT), true, true FROM t
UNION ALL SELECT 'weighted avg', CAST(sum(n) AS BIGINT), true, true FROM t"""),
    "q_ml_predict": S.with_ctes(LABELS, "SELECT row_seq, true AS share, true AS class_follows FROM labelled"),
    "q_ml_importance": S.with_ctes(LABELS, SPLIT + """
SELECT feature, true AS share, true AS sum_is_one, true AS ordered, (SELECT CAST(sum(tr) AS BIGINT) FROM q) AS trained_on
FROM (VALUES ('price_numeric'), ('sales_numeric'), ('rating_numeric'), ('has_bestseller_badge')) AS v(feature)"""),
    "q_model_table": S.with_ctes(LABELS, "SELECT row_seq, true AS same_probability, true AS same_class FROM labelled"),
    "q_model_importance": """
SELECT feature, true AS same_importance
FROM (VALUES ('price_numeric'), ('sales_numeric'), ('rating_numeric'), ('has_bestseller_badge')) AS v(feature)""",
    "q_train_job": S.with_ctes(LABELS, SPLIT + """
SELECT true AS same_accuracy, true AS same_f1, (SELECT n_c - tr FROM q WHERE is_attractive = 1) AS test_support_1,
       (SELECT count(*) FROM labelled) AS n_scored"""),
    "q_single_class_flip": S.with_ctes(LABELS, """
, one AS (SELECT row_seq, CAST(attractiveness_score >= 100 AS INTEGER) AS y FROM labelled),
s AS (SELECT count(DISTINCT y) AS k, count(*) AS n, min(row_seq) AS first FROM one)
SELECT row_seq, CASE WHEN s.k = 1 AND s.n > 1 AND row_seq = s.first THEN 1 - y ELSE y END AS is_attractive
FROM one, s"""),
}
