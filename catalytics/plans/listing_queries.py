"""Registered listing queries (dashboard, grid) and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import listings as L
from ..operators import stats
from ..session import read_table
from ..sources.files import normalise_na
from . import fixtures
from . import sql as S

R = 6  # decimals kept for doubles on both sides


def _r(c: str):
    return F.round(F.col(c), R).alias(c)


# --- shared inputs -------------------------------------------------------------------

def cleaned_a(spark: SparkSession, sf: str) -> DataFrame:
    return L.with_score(L.clean_a(fixtures.listings_raw(spark, sf)))


def filtered_a(spark: SparkSession, sf: str) -> DataFrame:
    return L.filter_dashboard(cleaned_a(spark, sf))


def positional(spark: SparkSession, sf: str) -> DataFrame:
    """The listing table named by position (S2), NA tokens as nulls."""
    raw = fixtures.listings_raw(spark, sf)
    pos = raw.select(
        "row_seq", F.col("page_number").cast("string").alias("Index"), F.col("url").alias("URL"),
        F.col("name").alias("Title"), F.col("price").alias("Price_MAD"), F.col("original_price").alias("Unknown1"),
        F.col("discount_percentage").alias("Unknown2"), F.col("rating").alias("Rating"),
        F.col("sales_info").alias("Sales"), F.col("image_url").alias("Image_URL"),
        F.col("additional_badges").alias("Highlight"))
    return normalise_na(pos, [c for c in pos.columns if c not in ("row_seq", "Index")])


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return L.filter_grid(L.clean_c(positional(spark, sf)))


# --- queries ---------------------------------------------------------------------------

def _place(top: DataFrame, *order) -> DataFrame:
    """Number the rows of a short ranking (a limit's result) in its own order."""
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def q_topk_score(spark, sf):
    top = _place(L.top_k(filtered_a(spark, sf), 10), F.desc("score"), "row_seq")
    return top.select("place", "row_seq", "name", "price_numeric", "rating_numeric", "sales_numeric",
                      "discount_percentage_numeric", _r("score"))


def q_clean_dialect_a(spark, sf):
    return L.clean_a(fixtures.listings_raw(spark, sf)).select(
        "row_seq", "price_numeric", "rating_numeric", "sales_numeric", "discount_percentage_numeric")


def q_clean_dialect_b(spark, sf):
    return L.clean_b(fixtures.listings_raw(spark, sf)).select(
        "row_seq", "price_numeric", "sales_numeric", "rating_numeric", "has_bestseller_badge")


def q_clean_dialect_c(spark, sf):
    return L.clean_c(positional(spark, sf)).select("row_seq", "Title", "Price_MAD", "Rating", "Sales_Num",
                                                    "Image_URL")


def q_missing_columns(spark, sf):
    raw = fixtures.listings_raw(spark, sf).drop("discount_percentage")
    return L.clean_a(raw).select("row_seq", "price_numeric", "original_price_numeric",
                                 _r("discount_percentage_numeric"))


def q_listing_kpis(spark, sf):
    return L.kpis_a(filtered_a(spark, sf)).select("n_products", _r("avg_price"), _r("avg_rating"), "total_sales")


def q_listing_kpis_c(spark, sf):
    return L.kpis_c(grid(spark, sf)).select("n_products", _r("avg_price"), _r("avg_rating"), "total_sales")


def q_keyword_filter_sorted(spark, sf):
    df = L.filter_grid(L.keyword_filter(L.clean_c(positional(spark, sf)), "RING|bolt"))
    df = df.select("row_seq", "Title", "Price_MAD", "Rating", "Sales_Num")
    return stats.ranked(df, *L.grid_order("rating_desc"))


def _sorted(mode: str):
    def query(spark, sf):
        """The whole grid in one sort mode, with every row's rank."""
        df = grid(spark, sf).select("row_seq", "Title", "Price_MAD", "Rating", "Sales_Num")
        return stats.ranked(df, *L.grid_order(mode)).select("rank", "row_seq", "Price_MAD", "Rating", "Sales_Num")

    return query


def q_clean_numeric_input(spark, sf):
    """P1, P2, P4-P7, P9 on numeric columns (a table whose reader already typed them)."""
    part, sold = (read_table(spark, sf, t) for t in ("part", "lineitem"))
    sold = sold.groupBy("l_partkey").agg(F.sum("l_quantity").alias("sales_info"), F.max("l_discount").alias("discount_percentage"))
    raw = part.join(sold, part["p_partkey"] == sold["l_partkey"], "left").select(
        F.col("p_partkey").alias("row_seq"), F.when(F.col("p_partkey") % 17 != 0, F.col("p_retailprice") * 10000).alias("price"),
        F.when(F.col("p_partkey") % 13 != 0, F.lit(1) + F.col("p_size") * F.lit(0.08)).otherwise(F.lit(float("nan"))).alias("rating"),
        "sales_info", "discount_percentage", F.lit(None).cast("string").alias("additional_badges"), F.lit("x").alias("name"))
    a = L.clean_a(raw).select("row_seq", _r("price_numeric"), _r("rating_numeric"), "sales_numeric", "discount_percentage_numeric")
    b = L.clean_b(raw).select(F.col("row_seq").alias("k"), F.round("price_numeric", R).alias("price_b"), F.col("sales_numeric").alias("sales_b"),
                              F.round("rating_numeric", R).alias("rating_b"))
    return a.join(b, a["row_seq"] == b["k"]).drop("k")


def q_price_band(spark, sf):
    return L.price_band(grid(spark, sf)).select("row_seq", "Price_MAD", "price_color")


def q_display_fields(spark, sf):
    return L.display_a(cleaned_a(spark, sf))


def q_display_no_discount(spark, sf):
    """The table without a discount column: original prices are parsed and struck through where they are higher."""
    raw = fixtures.listings_raw(spark, sf).drop("discount_percentage")
    shown = L.display_a(L.with_score(L.clean_a(raw)))
    return shown.select("row_seq", "price_display", "original_price_display", "discount_display", "rating_display")


def q_display_grid(spark, sf):
    return L.display_c(grid(spark, sf))


def _hist(df, col, bins):
    h = stats.histogram(df, col, bins)
    return h.select("bin", _r("bin_lo"), _r("bin_hi"), "n")


def q_hist_price30(spark, sf):
    return _hist(filtered_a(spark, sf), "price_numeric", 30)


def q_hist_rating10(spark, sf):
    return _hist(filtered_a(spark, sf), "rating_numeric", 10)


def _round_hist(df, col, bins):
    h = stats.round_histogram(df, col, bins)
    return h.select("bin", _r("bin_lo"), _r("bin_hi"), "n")


def q_hist_price_round(spark, sf):
    return _round_hist(filtered_a(spark, sf), "price_numeric", 30)


def q_hist_rating_round(spark, sf):
    return _round_hist(filtered_a(spark, sf), "rating_numeric", 10)


def q_value_counts(spark, sf):
    g = grid(spark, sf)
    price = stats.value_counts(g, "Price_MAD").select(F.lit("price").alias("column"),
                                                      F.col("Price_MAD").alias("value"), "n")
    rating = stats.value_counts(g, "Rating").select(F.lit("rating").alias("column"),
                                                    F.col("Rating").alias("value"), "n")
    return price.unionByName(rating)


def q_describe(spark, sf):
    d = stats.describe(cleaned_a(spark, sf),
                       ["price_numeric", "rating_numeric", "sales_numeric", "discount_percentage_numeric"])
    return d.select("column", "count", *[_r(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


def q_bounds(spark, sf):
    b = stats.bounds(cleaned_a(spark, sf), ["price_numeric", "rating_numeric"],
                     {"price_numeric": (0.0, 1000.0), "rating_numeric": (0.0, 5.0)})
    gmax = L.clean_c(positional(spark, sf)).agg(F.coalesce(F.max("Price_MAD"), F.lit(1000.0)).alias("grid_price_max"))
    return b.withColumn("grid_price_max", gmax.scalar())


def q_kpi_display(spark, sf):
    a = L.kpi_display_a(L.kpis_a(filtered_a(spark, sf)))
    c = L.kpi_display_c(L.kpis_c(grid(spark, sf)))
    return a.withColumn("view", F.lit("dashboard")).unionByName(c.withColumn("view", F.lit("grid")))


def q_top_sales(spark, sf):
    top = _place(L.top_sales(filtered_a(spark, sf), 10), F.desc("sales_numeric"), "row_seq")
    return top.select("place", "row_seq", "name", "sales_numeric")


def q_scatter(spark, sf):
    return L.scatter(filtered_a(spark, sf))


def q_head_sample(spark, sf):
    return L.head(cleaned_a(spark, sf), 5).select("row_seq", "name", "price_numeric", "rating_numeric",
                                                  "sales_numeric", "discount_percentage_numeric")


QUERIES = {
    "q_topk_score": q_topk_score,
    "q_clean_dialect_a": q_clean_dialect_a,
    "q_clean_dialect_b": q_clean_dialect_b,
    "q_clean_dialect_c": q_clean_dialect_c,
    "q_missing_columns": q_missing_columns,
    "q_listing_kpis": q_listing_kpis,
    "q_listing_kpis_c": q_listing_kpis_c,
    "q_keyword_filter_sorted": q_keyword_filter_sorted,
    **{f"q_sort_{mode}": _sorted(mode) for mode in L.GRID_SORTS},
    "q_clean_numeric_input": q_clean_numeric_input,
    "q_price_band": q_price_band,
    "q_display_fields": q_display_fields,
    "q_display_no_discount": q_display_no_discount,
    "q_display_grid": q_display_grid,
    "q_hist_price30": q_hist_price30,
    "q_hist_rating10": q_hist_rating10,
    "q_hist_price_round": q_hist_price_round,
    "q_hist_rating_round": q_hist_rating_round,
    "q_value_counts": q_value_counts,
    "q_describe": q_describe,
    "q_bounds": q_bounds,
    "q_kpi_display": q_kpi_display,
    "q_top_sales": q_top_sales,
    "q_scatter": q_scatter,
    "q_head_sample": q_head_sample,
}


# --- oracles ---------------------------------------------------------------------------

def _hist_sql(col: str, bins: int) -> str:
    return S.with_ctes(S.LISTINGS_A, f"""
, v AS (SELECT {col} AS x FROM filtered WHERE {col} IS NOT NULL),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT CASE WHEN r.hi = r.lo THEN 1
                  ELSE least(CAST(floor({bins} * (v.x - r.lo) / (r.hi - r.lo)) AS BIGINT) + 1, {bins}) END AS bin,
             r.lo, r.hi FROM v, r)
SELECT CAST(bin AS INTEGER) AS bin, round(lo + (bin - 1) * ((hi - lo) / {bins}), {R}) AS bin_lo,
       round(lo + bin * ((hi - lo) / {bins}), {R}) AS bin_hi, count(*) AS n
FROM b GROUP BY bin, lo, hi""")


def _round_sql(col: str, bins: int) -> str:
    return S.with_ctes(S.LISTINGS_A, f"""
, v AS (SELECT CAST({col} AS DOUBLE) AS x FROM filtered WHERE {col} IS NOT NULL)""" + S.round_bins(bins, R))


_DESCRIBE_PARTS = []
for _c in ["price_numeric", "rating_numeric", "sales_numeric", "discount_percentage_numeric"]:
    _x = f"CAST({_c} AS DOUBLE)"
    _DESCRIBE_PARTS.append(
        f"SELECT '{_c}' AS \"column\", count({_x}) AS count, round(avg({_x}), {R}) AS mean, "
        f"round(stddev_samp({_x}), {R}) AS std, round(min({_x}), {R}) AS min, "
        f"round(quantile_cont({_x}, 0.25), {R}) AS p25, round(quantile_cont({_x}, 0.5), {R}) AS p50, "
        f"round(quantile_cont({_x}, 0.75), {R}) AS p75, round(max({_x}), {R}) AS max FROM scored")

ORACLE = {
    "q_topk_score": S.with_ctes(S.LISTINGS_A, f"""
SELECT CAST(row_number() OVER (ORDER BY f.score DESC, row_seq) AS INTEGER) AS place, row_seq, name, price_numeric, rating_numeric,
       sales_numeric, discount_percentage_numeric, round(f.score, {R}) AS score
FROM filtered f ORDER BY f.score DESC, row_seq LIMIT 10"""),
    "q_clean_dialect_a": S.with_ctes(S.LISTINGS_A, """
SELECT row_seq, price_numeric, rating_numeric, sales_numeric, discount_percentage_numeric FROM clean_a"""),
    "q_clean_dialect_b": S.with_ctes(S.LISTINGS_RAW, f"""
SELECT row_seq, {S.price_b('price')} AS price_numeric, CAST({S.sales_b('sales_info')} AS BIGINT) AS sales_numeric,
       {S.rating_b('rating')} AS rating_numeric, {S.badge('additional_badges')} AS has_bestseller_badge
FROM listings_raw"""),
    "q_clean_dialect_c": S.with_ctes(S.LISTINGS_C, """
SELECT row_seq, "Title", "Price_MAD", "Rating", "Sales_Num", "Image_URL" FROM clean_c"""),
    "q_missing_columns": S.with_ctes(S.LISTINGS_RAW, f"""
, c AS (SELECT row_seq, {S.price_a('price')} AS price_numeric, {S.price_a('original_price')} AS original_price_numeric
        FROM listings_raw)
SELECT row_seq, price_numeric, original_price_numeric,
       round(coalesce(CASE WHEN original_price_numeric > price_numeric AND original_price_numeric > 0
                  THEN (original_price_numeric - price_numeric) / original_price_numeric * 100.0 END, 0.0), {R})
         AS discount_percentage_numeric
FROM c"""),
    "q_listing_kpis": S.with_ctes(S.LISTINGS_A, f"""
SELECT count(*) AS n_products, round(avg(price_numeric), {R}) AS avg_price,
       round(avg(rating_numeric), {R}) AS avg_rating, CAST(sum(sales_numeric) AS BIGINT) AS total_sales
FROM filtered"""),
    "q_listing_kpis_c": S.with_ctes(S.LISTINGS_C, f"""
SELECT count(*) AS n_products, round(avg("Price_MAD"), {R}) AS avg_price, round(avg("Rating"), {R}) AS avg_rating,
       CASE WHEN sum("Sales_Num") > 0 THEN CAST(sum("Sales_Num") AS BIGINT) END AS total_sales
FROM grid"""),
    "q_keyword_filter_sorted": S.with_ctes(S.LISTINGS_C, """
SELECT row_seq, "Title", "Price_MAD", "Rating", "Sales_Num", row_number() OVER (ORDER BY "Rating" DESC NULLS LAST, row_seq) AS rank
FROM grid WHERE coalesce(regexp_matches("Title", 'RING|bolt', 'i'), false)"""),
    **{f"q_sort_{mode}": S.with_ctes(S.LISTINGS_C, f"""
SELECT row_number() OVER (ORDER BY {order}row_seq) AS rank, row_seq, "Price_MAD", "Rating", "Sales_Num" FROM grid""")
       for mode, order in {"relevance": "", "price_asc": '"Price_MAD" ASC NULLS LAST, ', "price_desc": '"Price_MAD" DESC NULLS LAST, ',
                           "rating_desc": '"Rating" DESC NULLS LAST, ', "sales_desc": '"Sales_Num" DESC NULLS LAST, '}.items()},
    "q_clean_numeric_input": f"""
WITH s AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
t AS (SELECT p_partkey AS row_seq, CASE WHEN p_partkey % 17 <> 0 THEN p_retailprice * 10000 END AS price,
             CASE WHEN p_partkey % 13 <> 0 THEN 1 + p_size * CAST(0.08 AS DOUBLE) END AS rating, q
      FROM part LEFT JOIN s ON l_partkey = p_partkey)
SELECT row_seq, round(price, {R}) AS price_numeric, round(rating, {R}) AS rating_numeric, CAST(0 AS BIGINT) AS sales_numeric,
       CAST(0.0 AS DOUBLE) AS discount_percentage_numeric, round(price, {R}) AS price_b, CAST(coalesce(trunc(q), 0) AS BIGINT) AS sales_b,
       round(rating, {R}) AS rating_b
FROM t""",
    "q_price_band": S.with_ctes(S.LISTINGS_C, """
, m AS (SELECT avg("Price_MAD") AS mean FROM grid)
SELECT row_seq, "Price_MAD", CASE WHEN m.mean IS NULL THEN 'blue' WHEN "Price_MAD" < m.mean THEN 'green'
                                  ELSE 'orange' END AS price_color
FROM grid, m"""),
    "q_display_fields": S.with_ctes(S.LISTINGS_A, """
SELECT row_seq,
  coalesce(printf('MAD %.2f', price_numeric), 'N/D') AS price_display,
  '' AS original_price_display,
  CASE WHEN discount_percentage_numeric > 0 THEN printf(' (%.0f%% de réduction)', discount_percentage_numeric)
       ELSE '' END AS discount_display,
  coalesce(printf('%.1f \u2b50', rating_numeric), 'N/D') AS rating_display,
  coalesce(format('{:,}', sales_numeric), 'N/D') AS sales_display,
  printf('%.2f', score) AS score_display,
  CASE WHEN url IS NOT NULL AND url <> 'N/A' THEN url END AS link,
  CASE WHEN additional_badges IS NOT NULL AND additional_badges <> 'N/A' THEN additional_badges END AS badges,
  CASE WHEN image_url IS NOT NULL AND image_url <> 'N/A' THEN image_url END AS image
FROM scored"""),
    "q_display_no_discount": S.with_ctes(S.LISTINGS_RAW, f"""
, c AS (SELECT row_seq, {S.price_a('price')} AS p, {S.price_a('original_price')} AS o, {S.rating_a('rating')} AS r FROM listings_raw),
d AS (SELECT *, CASE WHEN o > p AND o > 0 THEN (o - p) / o * 100.0 ELSE 0.0 END AS pct FROM c)
SELECT row_seq, coalesce(printf('MAD %.2f', p), 'N/D') AS price_display,
       CASE WHEN o > p THEN printf('~~MAD %.2f~~', o) ELSE '' END AS original_price_display,
       CASE WHEN pct > 0 THEN printf(' (%.0f%% de réduction)', pct) ELSE '' END AS discount_display,
       coalesce(printf('%.1f \u2b50', r), 'N/D') AS rating_display FROM d"""),
    "q_display_grid": S.with_ctes(S.LISTINGS_C, """
SELECT row_seq,
  CASE WHEN starts_with("Image_URL", 'http') THEN "Image_URL"
       ELSE 'https://via.placeholder.com/150?text=Image+N/A' END AS image,
  printf('%.2f MAD', "Price_MAD") AS price_display,
  coalesce(printf('%.1f/5.0', "Rating"), 'N/A') AS rating_display,
  coalesce(replace(format('{:,}', "Sales_Num"), ',', ' '), 'N/A') AS sales_display,
  CASE WHEN length(trim("Highlight")) > 0 THEN "Highlight" END AS highlight
FROM grid"""),
    "q_hist_price30": _hist_sql("price_numeric", 30),
    "q_hist_rating10": _hist_sql("rating_numeric", 10),
    "q_hist_price_round": _round_sql("price_numeric", 30),
    "q_hist_rating_round": _round_sql("rating_numeric", 10),
    "q_value_counts": S.with_ctes(S.LISTINGS_C, """
SELECT 'price' AS "column", "Price_MAD" AS value, count(*) AS n FROM grid WHERE "Price_MAD" IS NOT NULL GROUP BY 2
UNION ALL
SELECT 'rating' AS "column", "Rating" AS value, count(*) AS n FROM grid WHERE "Rating" IS NOT NULL GROUP BY 2"""),
    "q_describe": S.with_ctes(S.LISTINGS_A, "\n" + "\nUNION ALL\n".join(_DESCRIBE_PARTS)),
    "q_bounds": S.with_ctes(S.LISTINGS_C, """
, ca AS (SELECT * FROM clean_c)
SELECT coalesce(min(""" + S.price_a("price") + """), 0.0) AS price_numeric_min,
       coalesce(max(""" + S.price_a("price") + """), 1000.0) AS price_numeric_max,
       coalesce(min(""" + S.rating_a("rating") + """), 0.0) AS rating_numeric_min,
       coalesce(max(""" + S.rating_a("rating") + """), 5.0) AS rating_numeric_max,
       (SELECT coalesce(max("Price_MAD"), 1000.0) FROM clean_c) AS grid_price_max
FROM listings_raw"""),
    "q_top_sales": S.with_ctes(S.LISTINGS_A, """
SELECT CAST(row_number() OVER (ORDER BY sales_numeric DESC, row_seq) AS INTEGER) AS place, row_seq, name, sales_numeric FROM filtered
WHERE (SELECT coalesce(sum(sales_numeric), 0) FROM filtered) > 0
ORDER BY sales_numeric DESC, row_seq LIMIT 10"""),
    "q_scatter": S.with_ctes(S.LISTINGS_A, """
SELECT row_seq, name, price_numeric, rating_numeric, sales_numeric FROM filtered
WHERE price_numeric IS NOT NULL AND rating_numeric IS NOT NULL"""),
    "q_head_sample": S.with_ctes(S.LISTINGS_A, """
SELECT row_seq, name, price_numeric, rating_numeric, sales_numeric, discount_percentage_numeric
FROM clean_a ORDER BY row_seq LIMIT 5"""),
    "q_kpi_display": S.with_ctes(S.LISTINGS_A + S.LISTINGS_C[len(S.LISTINGS_RAW):], """
, ka AS (SELECT count(*) AS n, avg(price_numeric) AS ap, avg(rating_numeric) AS ar,
                CAST(sum(sales_numeric) AS DOUBLE) AS ts FROM filtered),
kc AS (SELECT count(*) AS n, avg("Price_MAD") AS ap, avg("Rating") AS ar, CAST(sum("Sales_Num") AS BIGINT) AS ts
       FROM grid)
SELECT CAST(n AS VARCHAR) AS products_display,
  CASE WHEN n = 0 OR ap IS NULL THEN 'N/D' ELSE 'MAD ' || format('{:.2f}', ap) END AS price_display,
  CASE WHEN n = 0 OR ar IS NULL THEN 'N/D' ELSE format('{:.2f}', ar) || ' \u2b50' END AS rating_display,
  CASE WHEN n = 0 OR ts IS NULL THEN 'N/D' ELSE format('{:,.0f}', ts) END AS sales_display,
  'dashboard' AS view FROM ka
UNION ALL
SELECT CAST(n AS VARCHAR),
  CASE WHEN ap IS NULL THEN 'N/A' ELSE format('{:.2f}', ap) || ' MAD' END,
  CASE WHEN ar IS NULL THEN 'N/A' ELSE format('{:.1f}', ar) || ' \u2b50' END,
  CASE WHEN ts > 0 THEN replace(format('{:,}', ts), ',', ' ') || ' ' ELSE 'N/A' END,
  'grid' FROM kc"""),
}
