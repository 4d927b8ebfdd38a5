"""Distribution statistics: equal-width histograms, value counts, describe.

All are partial/final aggregations: each task pre-aggregates its rows, so a
hot value never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """A4: exactly ``bins`` equal-width bins over [min, max] of the non-null values.

    The maximum falls in the last bin; min = max puts everything in bin 1.
    Output: ``bin`` (1-based), ``bin_lo``, ``bin_hi``, ``n`` for non-empty bins.
    The bounds are one scalar subquery; the counting is a grouped aggregate.
    """
    x = F.col(column)
    vals = df.where(x.isNotNull())
    rng = vals.select(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    lo, hi = rng.select("lo").scalar(), rng.select("hi").scalar()
    width = (hi - lo) / F.lit(float(bins))
    b = F.coalesce(F.least(F.width_bucket(x.cast("double"), lo, hi, F.lit(bins)), F.lit(bins)),
                   F.lit(1)).cast("int")
    counted = vals.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "bin",
        (lo + (F.col("bin") - 1) * width).alias("bin_lo"),
        (lo + F.col("bin") * width).alias("bin_hi"),
        "n",
    )


#: Multiples of a power of ten that a round step may be; two decades on, as the start is one too low on purpose.
ROUND_STEPS = [m * 10 ** k for k in range(3) for m in (1, 2, 5)] + [1000]


def round_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """A4 as plotted: at most ``bins`` bins whose edges are multiples of a round step.

    The step is the smallest of 1, 2, 5 times a power of ten with which no more than ``bins`` bins, each closed below, cover
    the finite values; it is 1 if all are equal. At least two bins are needed, as one can't hold values of both signs. The
    bounds and the step are one scalar subquery, the counting is a grouped aggregate. Output as of ``histogram``:
    ``bin`` (1-based, from the smallest value's), ``bin_lo``, ``bin_hi``, ``n`` for non-empty bins.
    """
    if bins < 2:
        raise ValueError(f"round steps need at least two bins, got {bins}")
    x = F.col(column).cast("double")
    vals = df.where(F.abs(x) < F.lit(float("inf")))  # NaN is larger than infinity
    lo, hi = F.col("lo"), F.col("hi")
    power = F.col("power")
    # powers of ten with positive exponents are exact
    unit = [F.pow(F.lit(10.0), F.greatest(p, F.lit(0))) for p in (power, -power)]
    fits = F.filter(F.array(*[F.lit(float(m)) * unit[0] / unit[1] for m in ROUND_STEPS]),
                    lambda s: F.floor(hi / s) - F.floor(lo / s) + 1 <= bins)
    chosen = vals.select(F.min(x).alias("lo"), F.max(x).alias("hi")) \
        .withColumn("power", F.when(hi > lo, F.floor(F.log10((hi - lo) / F.lit(float(bins)))).cast("int") - 1)) \
        .withColumn("step", F.coalesce(F.get(fits, F.lit(0)), F.lit(1.0)))
    step, first = chosen.select("step").scalar(), chosen.select(F.floor(lo / F.col("step"))).scalar()
    counted = vals.groupBy(F.floor(x / step).alias("_at")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select((F.col("_at") - first + 1).cast("int").alias("bin"), (F.col("_at") * step).alias("bin_lo"),
                          ((F.col("_at") + 1) * step).alias("bin_hi"), "n")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A5: frequency per exact non-null value."""
    return (df.where(F.col(column).isNotNull())
            .groupBy(column).agg(F.count(F.lit(1)).alias("n")))


#: Values between a quantile's bounds that are ordered; while there are more, the bounds are drawn closer.
SELECT_ROWS = 1 << 14
#: Size of the sketches that propose bounds, and their distance from the wanted rank as a share of the values.
SKETCH_K, MARGIN = 800, 0.01
#: Least margin after a bound that the count disproved; beyond the whole range the bounds stay as they are.
MARGIN_STEP = 0.005


def _narrowed(data: DataFrame, targets: list[dict]) -> None:
    """Draw the bounds ``lo``, ``hi`` of the targets closer: KLL sketches of the values between them propose new bounds, a count of the
    values below and between those proves them. A bound that the count disproves is given up."""
    def between(t, lo, hi):
        return (F.col(t["column"]) >= F.lit(lo)) & (F.col(t["column"]) <= F.lit(hi))

    proposals = []
    for i, t in enumerate(targets):
        sketch = F.kll_sketch_agg_double(F.when(between(t, t["lo"], t["hi"]), F.col(t["column"])), F.lit(SKETCH_K))  # one for all targets of a column at first
        for side, rank, sign in (("l", t["first"], -1), ("h", t["last"] + 1, 1)):
            share = (rank - t["below"]) / t["inside"] + sign * t["margin"]
            proposals.append(F.kll_sketch_get_quantile_double(sketch, F.lit(min(1.0, max(0.0, share)))).alias(f"{side}{i}"))
    found = data.agg(*proposals).first()
    new = [(max(t["lo"], found[f"l{i}"]), min(t["hi"], found[f"h{i}"])) for i, t in enumerate(targets)]
    counts = data.agg(*(F.count_if(F.col(t["column"]) < F.lit(lo)).alias(f"b{i}") for i, (t, (lo, _)) in enumerate(zip(targets, new))),
                      *(F.count_if(between(t, lo, hi)).alias(f"i{i}") for i, (t, (lo, hi)) in enumerate(zip(targets, new)))).first()
    for i, (t, (lo, hi)) in enumerate(zip(targets, new)):
        below, inside = counts[f"b{i}"], counts[f"i{i}"]
        if below <= t["first"] and t["last"] < below + inside:
            t["done"] = lo == hi or inside > 0.5 * t["inside"]  # a value that fills the range is one row when values are grouped
            t.update(lo=lo, hi=hi, below=below, inside=inside)
        else:
            t["margin"] = max(4 * t["margin"], MARGIN_STEP)
            t["done"] = t["margin"] > 1


def quantiles(df: DataFrame, columns: list[str], shares: list[float], written: bool = False) -> DataFrame:
    """Exact interpolated quantiles: ``column, share, value`` (no row for a column without values).

    All columns and shares together: the columns are written once (a ``written`` table is read as it is), sketches bound
    the wanted ranks (``_narrowed``: two aggregates over the written columns), and only the values between the bounds are
    grouped, shuffled and ordered. What passes through the driver are two bounds and two counts a quantile.
    """
    values = {c: F.col(c).cast("double") for c in columns}
    data = df.select(*(F.when(~F.isnan(v), v).alias(c) for c, v in values.items()))
    data = data if written else materialise(data, "quantile-input")
    sizes = data.agg(*(F.count(c).alias(c) for c in columns)).first()
    targets = [{"column": c, "share": float(q), "first": int(q * (sizes[c] - 1)), "last": -int(-q * (sizes[c] - 1) // 1), "part": q * (sizes[c] - 1) % 1,
                "lo": float("-inf"), "hi": float("inf"), "below": 0, "inside": sizes[c], "margin": MARGIN, "done": False}
               for c in columns for q in shares if sizes[c]]
    while wide := [t for t in targets if t["inside"] > SELECT_ROWS and not t["done"]]:
        _narrowed(data, wide)
    known = data.sparkSession.createDataFrame([(i, t["column"], t["share"], t["part"], t["first"], t["last"], t["below"]) for i, t in enumerate(targets)],
                                              "i int, column string, share double, part double, first long, last long, below long")
    near = [F.when((F.col(t["column"]) >= F.lit(t["lo"])) & (F.col(t["column"]) <= F.lit(t["hi"])), F.struct(F.lit(i).alias("i"), F.col(t["column"]).alias("v")))
            for i, t in enumerate(targets)] or [F.lit(None).cast("struct<i: int, v: double>")]
    inside = data.select(F.explode(F.array_compact(F.array(*near))).alias("x")).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = inside.withColumn("before", before).join(F.broadcast(known), "i").withColumn("at", F.col("below") + F.col("before"))  # a row a quantile
    low, high = (F.max(F.when((F.col("at") <= F.col(r)) & (F.col(r) < F.col("at") + F.col("c")), F.col("v"))) for r in ("first", "last"))
    return placed.groupBy("column", "share", "part").agg(low.alias("low"), high.alias("high")).select(
        "column", "share", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("value"))


def median(df: DataFrame, column: str):
    """Exact median as a scalar subquery; null without values."""
    return quantiles(df, [column], [0.5]).select("value").scalar()


def describe(df: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """Count, mean, sample std, min, interpolated quartiles, max per column.

    One pass for the moments; quartiles are exact (see ``quantiles``) unless ``accuracy``
    asks for ``percentile_approx`` (relative rank error about 1 / accuracy).
    """
    shares = [0.25, 0.5, 0.75]
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"{c}__count"), F.avg(x).alias(f"{c}__mean"),
                 F.stddev_samp(x).alias(f"{c}__std"), F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max")]
        if accuracy is not None:
            aggs.append(F.percentile_approx(x, shares, accuracy).alias(f"{c}__quartiles"))
    stats = ["count", "mean", "std", "min", "max"] + (["quartiles"] if accuracy is not None else [])
    parts = ", ".join(f"'{c}', " + ", ".join(f"`{c}__{s}`" for s in stats) for c in columns)
    rows = df.agg(*aggs).selectExpr(f"stack({len(columns)}, {parts}) AS (column, {', '.join(stats)})")
    if accuracy is not None:
        rows = rows.select("column", *stats[:-1], *(F.get("quartiles", F.lit(i)).alias(f"p{int(q * 100)}") for i, q in enumerate(shares)))
    else:
        found = quantiles(df, columns, shares).groupBy("column").agg(
            *(F.max(F.when(F.col("share") == q, F.col("value"))).alias(f"p{int(q * 100)}") for q in shares))
        rows = rows.join(found, "column", "left")
    return rows.select("column", F.col("count").cast("bigint").alias("count"), "mean", "std", "min", "p25", "p50", "p75", "max")


def ranked(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``df`` with each row's 1-based rank in ``order``, over the whole table, without ordering it in one task.

    The sorted table is written with ids that grow along its partitions; the partitions'
    row counts (one row each) turn them into ranks.
    """
    ids = materialise(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_id", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ids.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    low = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return ids.join(parts, part == F.col("_part")).select(*df.columns, (F.col("_before") + low + 1).cast("bigint").alias(name))


def slider_bounds(df: DataFrame, column: str) -> DataFrame:
    """A13, storefront: price slider limits; equal ones are set apart by 1, (0, 1) without any price."""
    lo, hi = F.min(column).cast("double"), F.max(column).cast("double")
    return df.agg(lo.alias("lo"), hi.alias("hi")).select(
        F.coalesce("lo", F.lit(0.0)).alias("price_min"),
        F.when(F.col("hi").isNull(), 1.0).when(F.col("hi") == F.col("lo"), F.col("hi") + 1.0).otherwise(F.col("hi")).alias("price_max"))


def bounds(df: DataFrame, columns: list[str], fallback: dict[str, tuple[float, float]]) -> DataFrame:
    """Min / max per column, with a fallback pair when the column is all null."""
    out = []
    for c in columns:
        lo, hi = fallback.get(c, (0.0, 1.0))
        out += [F.coalesce(F.min(c).cast("double"), F.lit(lo)).alias(f"{c}_min"),
                F.coalesce(F.max(c).cast("double"), F.lit(hi)).alias(f"{c}_max")]
    return df.agg(*out)
