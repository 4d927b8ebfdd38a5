"""Listing analytics: clean, score, filter, KPIs, rankings, display fields.

Inputs are listing tables with the marketplace text columns (``price``,
``rating``, ``sales_info`` ...) plus a unique order key ``row_seq`` (file
order = relevance). All outputs are lazy DataFrames; scalars derived from the
data (bounds, means) are scalar subqueries, evaluated once by Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, parse
from ..functions.display import fixed_point, thousands
from ..sources.files import ensure_columns

ORDER_KEY = "row_seq"


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _number(x: Column) -> Column:
    """A numeric input column as it is; NaN is missing."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def _whole(x: Column) -> Column:
    return F.coalesce(_number(x).cast("bigint"), F.lit(0).cast("bigint"))


def _parsed(df: DataFrame, name: str, text_rule, number_rule) -> Column:
    """``text_rule`` of a text column, ``number_rule`` of a numeric one (decided by the schema, when planning)."""
    if name in df.columns and isinstance(df.schema[name].dataType, T.NumericType):
        return number_rule(F.col(name))
    return text_rule(_text(df, name))


# --- cleaning dialects -------------------------------------------------------

def clean_a(df: DataFrame) -> DataFrame:
    """Dashboard dialect (P1, P4, P6, P9; P10 when no discount column exists).

    Missing text columns are tolerated (S3): price / rating become null,
    sales 0, discount 0.0 or derived from original and current price. Numeric
    prices and ratings are taken as they are; sales and discounts are
    only read from text, a number there counts as 0.
    """
    out = df.withColumns({
        "price_numeric": _parsed(df, "price", parse.price_a, _number),
        "rating_numeric": _parsed(df, "rating", parse.rating_a, _number),
        "sales_numeric": _parsed(df, "sales_info", parse.sales_a, lambda x: F.lit(0).cast("bigint")) if "sales_info" in df.columns
        else F.lit(0).cast("bigint"),
    })
    if "discount_percentage" in df.columns:
        return out.withColumn("discount_percentage_numeric", _parsed(df, "discount_percentage", parse.discount, lambda x: F.lit(0.0)))
    if "original_price" in df.columns:
        out = out.withColumn("original_price_numeric", _parsed(df, "original_price", parse.price_a, _number))
        return out.withColumn("discount_percentage_numeric",
                              parse.derived_discount("original_price_numeric", "price_numeric"))
    return out.withColumn("discount_percentage_numeric", F.lit(0.0))


def clean_b(df: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """Classifier dialect (P2, P7, P5, P11), before imputation."""
    df = ensure_columns(df, {"price": "string", "sales_info": "string", "rating": "string",
                             "additional_badges": "string", "name": "string"})
    return df.withColumns({
        "price_numeric": _parsed(df, "price", parse.price_b, _number),
        "sales_numeric": _parsed(df, "sales_info", parse.sales_b, _whole),
        "rating_numeric": _parsed(df, "rating", parse.rating_b, _number),
        "has_bestseller_badge": parse.badge_flag("additional_badges", markers),
    })


def clean_c(df: DataFrame) -> DataFrame:
    """Product-grid dialect on the positional columns."""
    return df.withColumns({
        "Price_MAD": _parsed(df, "Price_MAD", parse.price_c, _number),
        "Rating": _parsed(df, "Rating", parse.rating_b, _number),
        "Sales_Num": _parsed(df, "Sales", parse.sales_c, lambda x: F.abs(_number(x).cast("bigint"))),
        # the intended defaults (the original turns nulls into the text "nan")
        "Image_URL": F.coalesce(F.col("Image_URL"), F.lit("")),
        "Title": F.coalesce(F.col("Title"), F.lit("Titre non disponible")),
    })


# --- score, filters -----------------------------------------------------------

def with_score(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted score; a term is skipped when its input is null or its weight <= 0."""
    w = {**fixed.SCORE_WEIGHTS, **(weights or {})}
    terms = [
        (w["rating"], F.col("rating_numeric") * F.lit(w["rating"])),
        (w["sales"], F.log1p(F.col("sales_numeric")) * F.lit(w["sales"])),
        (w["price"], -(F.col("price_numeric") / F.lit(100.0)) * F.lit(w["price"])),
        (w["discount"], F.col("discount_percentage_numeric") * F.lit(w["discount"])),
    ]
    score = F.lit(0.0)
    for weight, term in terms:
        if weight > 0:  # weights are plan constants: a zero weight drops the term
            score = score + F.coalesce(term, F.lit(0.0))
    return df.withColumn("score", score)


def filter_dashboard(df: DataFrame, price_lo=None, price_hi=None, rating_min=None) -> DataFrame:
    """F1 + F2: price in range with null passing; rating >= threshold with null as 0.

    Unset bounds default to the sliders' defaults: the data's min / max price
    and min rating. A default price bound is the data's own extreme, which
    every non-null price satisfies and null passes anyway, so it adds no
    predicate (and no extra pass); only the rating threshold needs the data,
    as one scalar subquery.
    """
    p = F.col("price_numeric")
    cond = F.lit(True)
    if price_lo is not None:
        cond = cond & (F.coalesce(p, F.lit(price_lo)) >= F.lit(price_lo))
    if price_hi is not None:
        cond = cond & (F.coalesce(p, F.lit(price_hi)) <= F.lit(price_hi))
    rmin = F.lit(rating_min) if rating_min is not None else \
        df.select(F.coalesce(F.min("rating_numeric"), F.lit(0.0))).scalar()
    return df.where(cond & (F.coalesce(F.col("rating_numeric"), F.lit(0.0)) >= rmin))


def keyword_filter(df: DataFrame, keyword: str | None, column: str = "Title") -> DataFrame:
    """case-insensitive regular-expression match on the title; null -> no match."""
    if not keyword:
        return df
    return df.where(F.coalesce(F.col(column).rlike("(?i)" + keyword), F.lit(False)))


def filter_grid(df: DataFrame, price_lo: float = 0.0, price_hi: float | None = None,
                rating_min: float = 0.0) -> DataFrame:
    """price in range (null price dropped); rating >= minimum or null.

    ``price_hi`` defaults to the maximum price, which every non-null price
    satisfies, so the default adds no predicate beyond dropping nulls.
    """
    p, r = F.col("Price_MAD"), F.col("Rating")
    cond = p.isNotNull() & (p >= F.lit(price_lo))
    if price_hi is not None:
        cond = cond & (p <= F.lit(price_hi))
    return df.where(cond & (r.isNull() | (r >= F.lit(rating_min))))


GRID_SORTS = {
    "relevance": None,
    "price_asc": ("Price_MAD", "asc"),
    "price_desc": ("Price_MAD", "desc"),
    "rating_desc": ("Rating", "desc"),
    "sales_desc": ("Sales_Num", "desc"),
}


def grid_order(mode: str = "relevance") -> list[Column]:
    """Sort keys of the five modes (nulls last), each ending in file order."""
    spec = GRID_SORTS[mode]
    keys = []
    if spec:
        c, d = spec
        keys.append(F.asc_nulls_last(c) if d == "asc" else F.desc_nulls_last(c))
    return [*keys, F.col(ORDER_KEY)]


def sort_grid(df: DataFrame, mode: str = "relevance") -> DataFrame:
    """The table in one of the five sort modes."""
    return df.orderBy(*grid_order(mode))


# --- KPIs, rankings -------------------------------------------------------------

def kpis_a(df: DataFrame) -> DataFrame:
    """A1: count, mean price, mean rating, sum of sales (nulls skipped)."""
    return df.agg(
        F.count(F.lit(1)).alias("n_products"),
        F.avg("price_numeric").alias("avg_price"),
        F.avg("rating_numeric").alias("avg_rating"),
        F.sum("sales_numeric").cast("bigint").alias("total_sales"),
    )


def kpis_c(df: DataFrame) -> DataFrame:
    """A2 (grid dialect): the same four figures; a zero or null sales total is null."""
    return df.agg(
        F.count(F.lit(1)).alias("n_products"),
        F.avg("Price_MAD").alias("avg_price"),
        F.avg("Rating").alias("avg_rating"),
        F.sum("Sales_Num").cast("bigint").alias("total_sales_raw"),
    ).select("n_products", "avg_price", "avg_rating",
             F.when(F.col("total_sales_raw") > 0, F.col("total_sales_raw")).alias("total_sales"))


def top_k(df: DataFrame, k: int = 10, by: str = "score") -> DataFrame:
    """Best ``k`` rows by a column, ties in file order (TakeOrderedAndProject)."""
    return df.orderBy(F.desc_nulls_last(by), F.col(ORDER_KEY)).limit(k)


def top_sales(df: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` by sales; empty when the sales total is 0."""
    total = df.select(F.coalesce(F.sum("sales_numeric"), F.lit(0))).scalar()
    return top_k(df.where(total > 0), k, "sales_numeric")


def head(df: DataFrame, n: int = 5) -> DataFrame:
    """T4: first rows in file order."""
    return df.orderBy(ORDER_KEY).limit(n)


def scatter(df: DataFrame) -> DataFrame:
    """Price x rating points with sales as size; both coordinates present."""
    return df.dropna(subset=["price_numeric", "rating_numeric"]).select(
        ORDER_KEY, "name", "price_numeric", "rating_numeric", "sales_numeric")


def price_band(df: DataFrame, price: str = "Price_MAD") -> DataFrame:
    """Green below the mean price of the table, else orange; no mean -> blue."""
    mean = df.select(F.avg(price)).scalar()
    p = F.col(price)
    return df.withColumn("price_color", F.when(mean.isNull(), F.lit("blue"))
                         .when(p < mean, F.lit("green")).otherwise(F.lit("orange")))


# --- display fields (P22, P26) ---------------------------------------------------

def display_a(df: DataFrame) -> DataFrame:
    """Dashboard card texts for a cleaned + scored listing table."""
    has_orig = "original_price_numeric" in df.columns
    p = F.col("price_numeric")
    strike = (F.when(F.col("original_price_numeric") > p,  # no comparison, no strike, without a current price
                     fixed_point(F.col("original_price_numeric"), 2, "~~MAD ", "~~")).otherwise(F.lit(""))
              if has_orig else F.lit(""))
    disc = F.col("discount_percentage_numeric")
    disc_txt = F.when(disc > 0, fixed_point(disc, 0, " (", "% de réduction)")).otherwise(F.lit(""))
    return df.select(
        ORDER_KEY,
        F.coalesce(fixed_point(p, 2, "MAD "), F.lit("N/D")).alias("price_display"),
        strike.alias("original_price_display"),
        disc_txt.alias("discount_display"),
        F.coalesce(fixed_point(F.col("rating_numeric"), 1, "", " " + fixed.STAR), F.lit("N/D")).alias("rating_display"),
        F.coalesce(thousands(F.col("sales_numeric"), ","), F.lit("N/D")).alias("sales_display"),
        fixed_point(F.col("score"), 2).alias("score_display"),
        F.when(F.col("url").isNotNull() & (F.col("url") != fixed.SENTINEL), F.col("url")).alias("link"),
        F.when(F.col("additional_badges").isNotNull() & (F.col("additional_badges") != fixed.SENTINEL),
               F.col("additional_badges")).alias("badges"),
        F.when(F.col("image_url").isNotNull() & (F.col("image_url") != fixed.SENTINEL),
               F.col("image_url")).alias("image"),
    )


def display_c(df: DataFrame, placeholder: str = fixed.IMAGE_PLACEHOLDER) -> DataFrame:
    """Product-grid card texts (P22, P26) for the positional dialect, blank thousands separator."""
    highlight = F.col("Highlight")
    return df.select(
        ORDER_KEY,
        F.when(F.col("Image_URL").startswith("http"), F.col("Image_URL")).otherwise(F.lit(placeholder)).alias("image"),
        fixed_point(F.col("Price_MAD"), 2, "", " MAD").alias("price_display"),
        F.coalesce(fixed_point(F.col("Rating"), 1, "", "/5.0"), F.lit("N/A")).alias("rating_display"),
        F.coalesce(thousands(F.col("Sales_Num"), " "), F.lit("N/A")).alias("sales_display"),
        F.when(F.length(parse.pystrip(highlight)) > 0, highlight).alias("highlight"),
    )


def kpi_display_a(kpis: DataFrame) -> DataFrame:
    """P22 for A1: the dashboard's KPI texts; an empty selection shows N/D."""
    empty = F.col("n_products") == 0
    return kpis.select(
        F.col("n_products").cast("string").alias("products_display"),
        F.when(empty, F.lit("N/D")).otherwise(
            F.coalesce(fixed_point(F.col("avg_price"), 2, "MAD "), F.lit("N/D"))).alias("price_display"),
        F.when(empty, F.lit("N/D")).otherwise(
            F.coalesce(fixed_point(F.col("avg_rating"), 2, "", " " + fixed.STAR), F.lit("N/D"))).alias("rating_display"),
        F.when(empty, F.lit("N/D")).otherwise(
            F.coalesce(fixed_point(F.col("total_sales"), 0, grouping=True), F.lit("N/D"))).alias("sales_display"),
    )


def kpi_display_c(kpis: DataFrame) -> DataFrame:
    """P22 for A2: the product grid's KPI texts (blank thousands separator, N/A)."""
    return kpis.select(
        F.col("n_products").cast("string").alias("products_display"),
        F.coalesce(fixed_point(F.col("avg_price"), 2, "", " MAD"), F.lit("N/A")).alias("price_display"),
        F.coalesce(fixed_point(F.col("avg_rating"), 1, "", " " + fixed.STAR), F.lit("N/A")).alias("rating_display"),
        F.coalesce(F.concat(thousands(F.col("total_sales"), " "), F.lit(" ")), F.lit("N/A")).alias("sales_display"),
    )
