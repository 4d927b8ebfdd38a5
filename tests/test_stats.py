"""Statistics operators: exact vs bounded-memory quantiles, histogram invariants."""

import pytest
from pyspark.sql import functions as F

from catalytics.operators import stats


def test_describe_exact_and_approximate(spark):
    df = spark.range(0, 10001).select((F.col("id") * 1.5).alias("v"))
    exact = stats.describe(df, ["v"]).collect()[0]
    approx = stats.describe(df, ["v"], accuracy=10000).collect()[0]
    assert exact.p50 == 7500.0 and exact.p25 == 3750.0 and exact["count"] == 10001
    assert abs(approx.p50 - exact.p50) <= 1.5 * 10001 / 10000 + 1.5


def test_quantiles_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    data = {"a": rng.normal(0, 100, 997), "b": np.repeat([3.0, 7.0, 1e12], [500, 490, 7]), "c": np.round(rng.exponential(5, 997), 1)}
    rows = [tuple(float(x) for x in r) for r in zip(*data.values(), strict=True)] + [(None, None, float("nan"))]
    df = spark.createDataFrame(rows, "a double, b double, c double").withColumn("d", F.lit(None).cast("double"))
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {(r["column"], r["share"]): r["value"] for r in stats.quantiles(df, ["a", "b", "c", "d"], shares).collect()}
    assert set(got) == {(c, q) for c in data for q in shares}
    for (c, q), value in got.items():
        assert abs(value - np.quantile(data[c], q)) <= 1e-9 * max(1.0, abs(value))
    assert stats.quantiles(df.limit(0), ["a"], [0.5]).count() == 0


@pytest.mark.parametrize("limit, margin", [(20, 0.01), (100, 0.0)])
def test_quantiles_by_narrowed_bounds(spark, monkeypatch, limit, margin):
    """Few values may be ordered, so bounds are drawn closer in several rounds; bounds that miss the rank are given up."""
    import numpy as np

    monkeypatch.setattr(stats, "SELECT_ROWS", limit)
    monkeypatch.setattr(stats, "MARGIN", margin)
    rng = np.random.default_rng(3)
    n = 6000
    data = {"a": rng.normal(0, 1, n), "b": np.repeat([1.0, 2.0, 3.0], [n // 3, n // 3 + 1, n // 3 - 1]), "c": np.where(rng.random(n) < 0.4, 5.0, rng.exponential(5, n)),
            "d": np.full(n, 7.0), "e": rng.integers(-50, 50, n).astype(float)}
    df = spark.createDataFrame([tuple(float(x) for x in r) for r in zip(*data.values(), strict=True)], ", ".join(f"{c} double" for c in data)).repartition(5)
    shares = [0.0, 0.25, 0.3334, 0.5, 0.999, 1.0]
    got = {(r["column"], r["share"]): r["value"] for r in stats.quantiles(df, list(data), shares).collect()}
    assert set(got) == {(c, q) for c in data for q in shares}
    for (c, q), value in got.items():
        assert abs(value - np.quantile(data[c], q)) <= 1e-9 * max(1.0, abs(value)), (c, q)


def test_ranks_follow_the_order(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(500)], "k int, v int").repartition(7)
    got = stats.ranked(df, "v", "k").collect()
    assert [r["k"] for r in sorted(got, key=lambda r: r["rank"])] == [r["k"] for r in sorted(got, key=lambda r: (r["v"], r["k"]))]
    assert sorted(r["rank"] for r in got) == list(range(1, 501))


def test_slider_bounds(spark):
    one = lambda values: tuple(stats.slider_bounds(spark.createDataFrame([(v,) for v in values], "price double"), "price").first())
    assert one([1.5, 4.0]) == (1.5, 4.0) and one([2.0, 2.0]) == (2.0, 3.0) and one([None]) == (0.0, 1.0)


def test_histogram_counts_sum_to_non_null(spark):
    df = spark.createDataFrame([(float(i % 37),) for i in range(500)] + [(None,)], "v double")
    h = stats.histogram(df, "v", 10)
    rows = h.collect()
    assert sum(r.n for r in rows) == 500 and max(r.bin for r in rows) == 10 and min(r.bin for r in rows) == 1


@pytest.mark.parametrize("values, bins, step", [
    ([0.0, 1.0, 2.5, 99.0], 30, 5.0), ([0.1, 4.9, 5.0], 10, 1.0), ([0.0, 4.9], 10, 0.5), ([-3.0, -0.1, 0.1, 7.0], 2, 10.0), ([7.25, 7.25], 5, 1.0),
    ([1000001.0, 1000001.04], 4, 0.02), ([-5e9, 5e9], 10, 2e9), ([10.0, 20.0], 10, 2.0)])
def test_round_histogram(spark, values, bins, step):
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan"), float("inf")]], "v double")
    rows = sorted(stats.round_histogram(df, "v", bins).collect())
    want = {}
    for v in values:
        want[int(v // step)] = want.get(int(v // step), 0) + 1
    assert [r.n for r in rows] == [n for _, n in sorted(want.items())]
    assert all(r.bin_lo == pytest.approx(b * step) and r.bin_hi == pytest.approx((b + 1) * step) for r, b in zip(rows, sorted(want)))
    assert rows[0].bin == 1 and rows[-1].bin <= bins


def test_round_histogram_of_nothing(spark):
    assert stats.round_histogram(spark.createDataFrame([(None,)], "v double"), "v", 10).count() == 0
    with pytest.raises(ValueError):
        stats.round_histogram(spark.createDataFrame([(1.0,)], "v double"), "v", 1)
