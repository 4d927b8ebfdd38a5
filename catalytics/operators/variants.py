"""Storefront variant analytics: typing, cascading facets, KPIs, rankings.

Input is the flat variant table (one row per variant, text columns). The
order key ``ORDER`` stands for file order and ends every sort.

Scale notes: distinct-count group-bys run as partial/final aggregates
(``count_distinct`` is rewritten into two hash aggregations), the
per-product first row is a ``row_number`` window that Spark turns into a
partial ``WindowGroupLimit`` before the shuffle, and every data-derived
scalar (price range) is a scalar subquery.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, parse
from ..functions.display import fixed_point, thousands
from ..session import materialise
from . import stats

ORDER = ["variant_id", "product_id", "supplier_key"]
TIMESTAMP_COLUMNS = ["created_at", "updated_at", "published_at", "variant_created_at", "variant_updated_at"]
CATEGORY_COLUMNS = ["vendor", "product_type", "store_domain"]
RAW_VIEW_COLUMNS = ["store_domain", "vendor", "title", "product_type", "variant_title", "price", "available",
                    "updated_at"]


def order_cols(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in ORDER if c in df.columns]


def clean_variants(df: DataFrame) -> DataFrame:
    """Numeric prices, timestamps, tri-state availability, unknown categories."""
    typed = {c: parse.numeric(c) for c in ("price", "compare_at_price") if c in df.columns}
    typed.update({c: parse.timestamp(c) for c in TIMESTAMP_COLUMNS if c in df.columns})
    if "available" in df.columns:
        typed["available"] = parse.tri_bool("available")
    typed.update({c: parse.unknown_if_null(c) for c in CATEGORY_COLUMNS if c in df.columns})
    return df.withColumns(typed)


# --- facets and filters (F5-F7, A14) --------------------------------------------

def facet_filter(df: DataFrame, store: str = fixed.ALL_LABEL, vendor: str = fixed.ALL_LABEL,
                 product_type: str = fixed.ALL_LABEL) -> DataFrame:
    """cascading equality filters; the "all" label means no filter."""
    for col, val in (("store_domain", store), ("vendor", vendor), ("product_type", product_type)):
        if val != fixed.ALL_LABEL:
            df = df.where(F.col(col) == F.lit(val))
    return df


def facet_values(df: DataFrame, store: str = fixed.ALL_LABEL, vendor: str = fixed.ALL_LABEL) -> DataFrame:
    """Sorted distinct values of each facet, each after the facets before it."""
    df = df.select("store_domain", "vendor", "product_type").distinct()  # one pass; the rest works on its few rows
    stores = df.select(F.lit("store_domain").alias("facet"), F.col("store_domain").alias("value")).distinct()
    s = facet_filter(df, store=store)
    vendors = s.select(F.lit("vendor").alias("facet"), F.col("vendor").alias("value")).distinct()
    sv = facet_filter(s, vendor=vendor)
    types = sv.select(F.lit("product_type").alias("facet"), F.col("product_type").alias("value")).distinct()
    return stores.unionByName(vendors).unionByName(types)


def price_range_filter(df: DataFrame, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """price within [lo, hi]; null prices always dropped.

    Unset bounds default to the data's min / max (max + 1 when they are equal;
    (0, 1) when every price is null). A default bound is the data's own
    extreme, which every non-null price satisfies, so it reduces to dropping
    null prices - no extra pass over the data.
    """
    p = F.col("price")
    cond = p.isNotNull()
    if lo is not None:
        cond = cond & (p >= F.lit(lo))
    if hi is not None:
        cond = cond & (p <= F.lit(hi))
    return df.where(cond)


def availability_filter(df: DataFrame, available: bool | None = None) -> DataFrame:
    """all (None) / only available / only unavailable; null matches neither."""
    return df if available is None else df.where(F.col("available") == F.lit(available))


# --- aggregates -------------------------------------------------------------------

def kpis(df: DataFrame) -> DataFrame:
    """A3 + A12: one row of variant KPIs.

    ``unavailable`` = rows - available, so a null availability counts as
    unavailable; the median is exact. Counts and median read one
    written copy of the columns they need.
    """
    df = materialise(df.select("product_id", "available", "price", "vendor", "product_type"), "variant-kpis")
    median = stats.median(df, "price")
    # a product has few vendors and types: the distinct counts, which repeat their input per column, see a row a combination
    per = df.groupBy("product_id", "vendor", "product_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("available") == F.lit(True)).alias("n_available"),
        F.sum("price").alias("prices"), F.count("price").alias("n_prices"))
    k = per.agg(
        F.count_distinct("product_id").alias("unique_products"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("variants"),
        F.coalesce(F.sum("n_available"), F.lit(0)).alias("available_variants"),
        (F.sum("prices") / F.sum("n_prices")).alias("avg_price"),
        F.count_distinct("vendor").alias("vendors"),
        F.count_distinct("product_type").alias("product_types"),
    ).withColumn("median_price", median)
    return k.withColumns({
        "unavailable_variants": F.col("variants") - F.col("available_variants"),
    }).withColumn("unavailable_pct", F.when(F.col("variants") > 0,
                                            F.col("unavailable_variants") / F.col("variants") * F.lit(100.0))
                  .otherwise(F.lit(0.0)))


def availability_counts(df: DataFrame) -> DataFrame:
    """A6 + P23: variants per availability value (nulls excluded), with labels."""
    return (df.where(F.col("available").isNotNull())
            .groupBy("available").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("label", parse.availability_label("available")))


def products_by(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """Distinct products per value of ``column``, most first, top ``top``."""
    return (df.groupBy(column).agg(F.count_distinct("product_id").alias("unique_products"))
            .orderBy(F.desc("unique_products"), F.col(column)).limit(top))


def vendor_dominance(df: DataFrame, threshold: float = fixed.DOMINANCE_PERCENT) -> DataFrame:
    """Share of the top vendor among the per-vendor distinct product counts.

    Only defined with more than one vendor (otherwise no row). The top vendor
    is the one with most products, ties broken by name.
    """
    per_vendor = df.groupBy("vendor").agg(F.count_distinct("product_id").alias("n"))
    agg = per_vendor.agg(
        F.count(F.lit(1)).alias("n_vendors"),
        F.min_by("vendor", F.struct(-F.col("n"), F.col("vendor"))).alias("top_vendor"),
        F.max("n").alias("top_vendor_products"),
        F.sum("n").alias("total_vendor_products"),
    )
    share = F.col("top_vendor_products").cast("double") / F.col("total_vendor_products") * F.lit(100.0)
    return (agg.where(F.col("n_vendors") > 1)
            .select("top_vendor", "top_vendor_products", "total_vendor_products",
                    share.alias("top_vendor_share"), (share > F.lit(threshold)).alias("dominant")))


# --- samples and rankings -----------------------------------------------------------

def _placed(top: DataFrame, place: bool, order: list, cols: list[str]) -> DataFrame:
    """The columns of a short ranking, with its rows numbered if asked."""
    if place:
        top = top.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return top.select(*cols, *["place"] * place)


def unavailable_sample(df: DataFrame, n: int = 10, place: bool = False) -> DataFrame:
    """T5: first ``n`` distinct (title, variant_title, vendor, store) of unavailable variants.

    "First" is by first occurrence in file order: a partial/final aggregate
    keeps each combination's smallest order key, then a top-``n``.
    """
    cols = ["title", "variant_title", "vendor", "store_domain"]
    first = (df.where(F.col("available") == F.lit(False))
             .groupBy(*cols).agg(F.min(F.struct(*order_cols(df))).alias("_first")))
    return _placed(first.orderBy("_first").limit(n), place, ["_first"], cols)


def most_expensive(df: DataFrame, n: int = 5, place: bool = False) -> DataFrame:
    """Each product's most expensive variant, then the ``n`` most expensive products."""
    w = Window.partitionBy("product_id").orderBy(F.desc_nulls_last("price"), *order_cols(df))
    best = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    order = [F.desc_nulls_last("price"), *order_cols(df)]
    return _placed(best.orderBy(*order).limit(n), place, order, ["product_id", "title", "vendor", "price", "store_domain"])


def raw_projection(df: DataFrame) -> DataFrame:
    """The fixed view columns that exist in the table."""
    return df.select(*[c for c in RAW_VIEW_COLUMNS if c in df.columns])


def kpi_display(k: DataFrame) -> DataFrame:
    """P22 for A3: counts with thousands separators, prices as ``$1,234.56`` (N/D when absent)."""
    counts = ["unique_products", "variants", "available_variants", "unavailable_variants", "vendors",
              "product_types"]
    return k.select(
        *[thousands(F.col(c)).alias(f"{c}_display") for c in counts],
        F.coalesce(fixed_point(F.col("avg_price"), 2, "$", grouping=True), F.lit("N/D")).alias("avg_price_display"),
        F.coalesce(fixed_point(F.col("median_price"), 2, "$", grouping=True),
                   F.lit("N/D")).alias("median_price_display"),
        fixed_point(F.col("unavailable_pct"), 1, "", "%").alias("unavailable_pct_display"),
    )
