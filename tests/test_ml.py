"""Classifier invariants: exact split, report arithmetic, persistence."""

from pyspark.sql import functions as F

from catalytics.operators import listings as L
from catalytics.operators import ml
from catalytics.plans import ml_queries as MQ
from conftest import SF_SMALL


def test_split_is_exact_and_repeatable(spark):
    data = MQ.labelled(spark, SF_SMALL)
    s1 = {(r.row_seq, r.part) for r in ml.stratified_split(data).select("row_seq", "part").collect()}
    s2 = {(r.row_seq, r.part) for r in ml.stratified_split(data).select("row_seq", "part").collect()}
    assert s1 == s2
    counts = {r[ml.LABEL]: r["n"] for r in ml.class_balance(data).collect()}
    split = ml.stratified_split(data)
    # allocation of a stratified splitter: n_test = ceil(n / 4); train per class = floor share of
    # n_train, the leftover going to the largest remainders; test gets the rest of each class
    n = sum(counts.values())
    n_train = n - (-(-n // 4))
    cont = {c: k / n * n_train for c, k in counts.items()}
    train = {c: int(v // 1) for c, v in cont.items()}
    for c in sorted(cont, key=lambda c: (-(cont[c] - train[c]), c))[: n_train - sum(train.values())]:
        train[c] += 1
    for label, k in counts.items():
        test_n = split.where((F.col(ml.LABEL) == label) & (F.col("part") == "test")).count()
        assert test_n == k - train[label]


def test_split_ranks_by_hash_within_class(spark):
    """The test part is exactly the smallest seeded hashes of each class (brute force)."""
    data = MQ.labelled(spark, SF_SMALL).withColumn("h", F.xxhash64("row_seq", F.lit(42)))
    rows = data.select("row_seq", ml.LABEL, "h").collect()
    split = {r.row_seq: r.part for r in ml.stratified_split(MQ.labelled(spark, SF_SMALL)).collect()}
    for label in {r[ml.LABEL] for r in rows}:
        cls = sorted((r.h, r.row_seq) for r in rows if r[ml.LABEL] == label)
        k = sum(1 for rs, p in split.items() if p == "test" and rs in {x for _, x in cls})
        assert {rs for _, rs in cls[:k]} == {rs for rs, p in split.items() if p == "test" and rs in {x for _, x in cls}}


def test_report_matches_confusion_arithmetic(spark):
    pred = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (0, 1), (1, 1)], "is_attractive int, prediction int")
    rep = {r["class"]: r for r in ml.report(pred).collect()}
    assert abs(rep["1"].precision - 2 / 3) < 1e-12 and abs(rep["1"].recall - 2 / 3) < 1e-12
    assert abs(rep["0"].precision - 2 / 3) < 1e-12 and rep["0"].support == 3
    assert abs(rep["1"].accuracy - 4 / 6) < 1e-12


def test_train_job_saves_reloadable_model(spark):
    from pyspark.ml.classification import RandomForestClassificationModel
    from catalytics.plans import fixtures
    from catalytics.session import scratch_path
    out = scratch_path(spark, "test-train")
    metrics = ml.train_job(spark, fixtures.listings_raw(spark, SF_SMALL), out).collect()
    assert len(metrics) == 1 and 0.0 <= metrics[0].accuracy <= 1.0
    model = RandomForestClassificationModel.load(f"{out}/model")
    assert model.getNumTrees == 100
    assert len(ml.importances(model)) == 4


def test_one_class_is_refused(spark):
    import pytest

    data = MQ.labelled(spark, SF_SMALL, threshold=100)
    with pytest.raises(ValueError, match="two classes"):
        ml.train(data)


LISTINGS = "row_seq long, price string, sales_info string, rating string, additional_badges string, name string, url string"


def test_texts_are_parsed_once(spark):
    rows = spark.createDataFrame([(1, "MAD 10.5", "1 200 vendus", "4.2", "Le plus vendu", "a", "u"), (1, "N/A", None, "4,9", "N/A", "b", "u"),
                                  (None, "MAD 20.5", "3k vendus", "N/A", None, None, None), (4, None, "abc", "5.0", "N/A", "d", "u")], LISTINGS)
    data = ml.preprocess(L.clean_b(rows))
    assert "regexp" not in data._jdf.queryExecution().optimizedPlan().toString().lower()
    got = sorted((tuple(r) for r in data.select("row_seq", "url", *ml.FEATURES, "attractiveness_score", ml.LABEL).collect()), key=str)
    assert got == sorted([(1, "u", 10.5, 1200, 4.2, 1, 4, 1), (1, "u", 15.5, 0, 4.6, 0, 2, 0), (None, None, 20.5, 3000, 4.6, 0, 4, 1),
                          (4, "u", 15.5, 0, 5.0, 0, 2, 0)], key=str)
    assert ml.preprocess(L.clean_b(rows.where("row_seq = 4"))).count() == 0  # no price at all: no median


def test_train_job_writes_no_texts(spark, monkeypatch, tmp_path):
    written = {}
    monkeypatch.setattr(ml, "materialise", lambda df, name: written.setdefault(name, df.checkpoint()))
    rows = spark.range(200).select(F.col("id").alias("row_seq"), F.concat(F.lit("MAD "), F.col("id").cast("string")).alias("price"),
                                   F.concat((F.col("id") * 37 % 4001).cast("string"), F.lit(" vendus")).alias("sales_info"),
                                   (F.col("id") % 50 / 10.0).cast("string").alias("rating"), F.lit("N/A").alias("additional_badges"), F.lit("x").alias("url"))
    assert ml.train_job(spark, rows, str(tmp_path)).count() == 1
    assert set(written["cleaned"].columns) == {"row_seq", *ml.FEATURES}
    assert set(written["split"].columns) == {"row_seq", *ml.FEATURES, "attractiveness_score", ml.LABEL, "part"}
    assert written["split"].count() == 200
