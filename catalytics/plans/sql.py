"""DuckDB oracle building blocks (independent SQL, not used by the Spark side).

The oracle re-derives the fixtures and re-implements each operator in plain
SQL so that the driver can compare both engines row by row.
"""

from __future__ import annotations

from ..functions import fixed

FLOAT_RE = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def to_double(s: str) -> str:
    """float(text) or NULL (the text is first stripped of blanks)."""
    t = f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
    return f"(CASE WHEN regexp_full_match({t}, '{FLOAT_RE}') THEN TRY_CAST({t} AS DOUBLE) END)"


def to_long(s: str) -> str:
    t = f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
    return f"(CASE WHEN regexp_full_match({t}, '[+-]?[0-9]+') THEN TRY_CAST({t} AS BIGINT) END)"


def price_a(x: str) -> str:
    body = f"replace(replace({x}, 'MAD', ''), ',', '.')"
    return f"(CASE WHEN {x} IS NULL OR {x} = 'N/A' THEN NULL ELSE {to_double(body)} END)"


def rating_a(x: str) -> str:
    body = f"replace({x}, ',', '.')"
    return f"(CASE WHEN {x} IS NULL OR {x} = 'N/A' THEN NULL ELSE {to_double(body)} END)"


def sales_a(x: str) -> str:
    g = f"replace(replace(regexp_extract({x}, '([\\d\\s,]+)\\s*vendus', 1), ' ', ''), ',', '')"
    return f"(CASE WHEN {x} IS NULL OR {x} = 'N/A' THEN 0 ELSE coalesce({to_long(g)}, 0) END)"


def discount(x: str) -> str:
    g = f"nullif(regexp_extract({x}, '([0-9]+\\.?[0-9]*)', 1), '')"
    return f"(CASE WHEN {x} IS NULL OR {x} = 'N/A' THEN 0.0 ELSE coalesce(TRY_CAST({g} AS DOUBLE), 0.0) END)"


def price_b(x: str) -> str:
    kept = f"nullif(regexp_replace({x}, '[^0-9.]', '', 'g'), '')"
    return f"(CASE WHEN {x} IS NULL OR lower({x}) = 'n/a' THEN NULL ELSE {to_double(kept)} END)"


def rating_b(x: str) -> str:
    return f"(CASE WHEN {x} IS NULL OR lower({x}) = 'n/a' THEN NULL ELSE {to_double(x)} END)"


def sales_b(x: str) -> str:
    s = f"replace(replace(lower({x}), ' ', ''), ',', '')"
    d = f"TRY_CAST(nullif(regexp_replace({s}, '[^0-9]', '', 'g'), '') AS BIGINT)"
    return (f"(CASE WHEN {x} IS NULL OR lower({x}) = 'n/a' THEN 0 ELSE "
            f"coalesce(CASE WHEN contains({s}, 'k') THEN {d} * 1000 ELSE {d} END, 0) END)")


def sales_c(x: str) -> str:
    g = f"regexp_extract(coalesce({x}, 'nan'), '([\\d\\s+]+)', 1)"
    return f"TRY_CAST(nullif(regexp_replace({g}, '[^0-9]', '', 'g'), '') AS BIGINT)"


def badge(x: str) -> str:
    marks = [m.replace("'", "''") for m in fixed.BADGE_MARKERS]
    cond = " OR ".join(f"contains(lower({x}), '{m}')" for m in marks)
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


def na(x: str) -> str:
    """pandas read_csv NA tokens -> NULL."""
    lst = ", ".join("'" + t + "'" for t in fixed.NA_TOKENS)
    return f"(CASE WHEN {x} IN ({lst}) THEN NULL ELSE {x} END)"


LISTINGS_RAW = r"""
listings_raw AS (
  WITH s AS (SELECT l_partkey, CAST(SUM(l_quantity) AS BIGINT) AS q, MAX(l_discount) AS d
             FROM lineitem GROUP BY l_partkey)
  SELECT p_partkey AS row_seq,
    CAST(p_partkey // 60 + 1 AS INTEGER) AS page_number,
    'https://shop.example.com/item/' || CAST(p_partkey AS VARCHAR) || '.html' AS url,
    'item ' || p_name AS name,
    CASE WHEN p_partkey % 17 = 0 THEN 'N/A'
         WHEN p_partkey % 5 = 0 THEN replace(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR), '.', ',') || ' MAD'
         ELSE 'MAD ' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) END AS price,
    CASE WHEN p_partkey % 4 = 0 THEN 'MAD ' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) + CAST(250 AS DECIMAL(12,2)) AS VARCHAR)
         WHEN p_partkey % 4 = 2 THEN 'MAD ' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) - CAST(100 AS DECIMAL(12,2)) AS VARCHAR)
         ELSE 'N/A' END AS original_price,
    CASE WHEN d IS NULL OR d = 0 THEN 'N/A'
         ELSE '-' || CAST(CAST(round(d * 100) AS INTEGER) AS VARCHAR) || '%' END AS discount_percentage,
    CASE WHEN p_partkey % 13 = 0 THEN 'N/A'
         WHEN p_partkey % 7 = 0 THEN replace(CAST(CAST(1 + p_size * 0.08 AS DECIMAL(3,1)) AS VARCHAR), '.', ',')
         ELSE CAST(CAST(1 + p_size * 0.08 AS DECIMAL(3,1)) AS VARCHAR) END AS rating,
    CASE WHEN q IS NULL THEN 'N/A'
         WHEN p_partkey % 11 = 0 THEN CAST(q AS VARCHAR) || '+ vendus'
         WHEN p_partkey % 7 = 3 AND q >= 1000
           THEN CAST(q // 1000 AS VARCHAR) || ' ' || lpad(CAST(q % 1000 AS VARCHAR), 3, '0') || ' vendus'
         WHEN p_partkey % 13 = 5 AND q >= 1000
           THEN CAST(q // 1000 AS VARCHAR) || '.' || CAST((q % 1000) // 100 AS VARCHAR) || 'k vendus'
         WHEN p_partkey % 29 = 1 THEN 'plus de ' || CAST(q AS VARCHAR) || ' vendus'
         ELSE CAST(q AS VARCHAR) || ' vendus' END AS sales_info,
    CASE WHEN p_partkey % 23 = 0 THEN 'N/A'
         ELSE 'https://img.example.com/' || CAST(p_partkey AS VARCHAR) || '.jpg' END AS image_url,
    CASE WHEN p_partkey % 9 = 0 THEN 'Le plus vendu'
         WHEN p_partkey % 14 = 0 THEN 'AliExpress Choice | Livraison gratuite'
         WHEN p_partkey % 10 = 3 THEN 'Livraison gratuite'
         ELSE 'N/A' END AS additional_badges
  FROM part LEFT JOIN s ON p_partkey = l_partkey
)"""

# Dashboard-cleaned listings (dialect A) with the default score.
LISTINGS_A = LISTINGS_RAW + f""",
clean_a AS (
  SELECT *, {price_a('price')} AS price_numeric, {rating_a('rating')} AS rating_numeric,
         CAST({sales_a('sales_info')} AS BIGINT) AS sales_numeric,
         {discount('discount_percentage')} AS discount_percentage_numeric
  FROM listings_raw
),
scored AS (
  SELECT *, 0.0 + coalesce(rating_numeric * 2.0, 0.0) + coalesce(ln(1 + sales_numeric) * 1.5, 0.0)
              + coalesce(-(price_numeric / 100.0) * 0.5, 0.0) + coalesce(discount_percentage_numeric * 1.0, 0.0) AS score
  FROM clean_a
),
bounds AS (
  SELECT coalesce(min(price_numeric), 0.0) AS price_lo, coalesce(max(price_numeric), 1000.0) AS price_hi,
         coalesce(min(rating_numeric), 0.0) AS rating_lo, coalesce(max(rating_numeric), 5.0) AS rating_hi
  FROM scored
),
filtered AS (
  SELECT s.* FROM scored s, bounds b
  WHERE coalesce(s.price_numeric, b.price_lo) >= b.price_lo AND coalesce(s.price_numeric, b.price_hi) <= b.price_hi
    AND coalesce(s.rating_numeric, 0.0) >= b.rating_lo
)"""

# Positional read of the same listings (dialect C); NA tokens are nulls.
LISTINGS_C = LISTINGS_RAW + f""",
pos_listing AS (
  SELECT row_seq, CAST(page_number AS VARCHAR) AS "Index", {na('url')} AS "URL", {na('name')} AS "Title",
         {na('price')} AS "Price_MAD", {na('original_price')} AS "Unknown1",
         {na('discount_percentage')} AS "Unknown2", {na('rating')} AS "Rating", {na('sales_info')} AS "Sales",
         {na('image_url')} AS "Image_URL", {na('additional_badges')} AS "Highlight"
  FROM listings_raw
),
clean_c AS (
  SELECT row_seq, "Index", "URL", coalesce("Title", 'Titre non disponible') AS "Title",
         {price_a('"Price_MAD"')} AS "Price_MAD", "Unknown1", "Unknown2",
         {rating_b('"Rating"')} AS "Rating", "Sales", {sales_c('"Sales"')} AS "Sales_Num",
         coalesce("Image_URL", '') AS "Image_URL", "Highlight"
  FROM pos_listing
),
grid AS (
  SELECT * FROM clean_c
  WHERE "Price_MAD" >= 0.0 AND "Price_MAD" <= (SELECT coalesce(max("Price_MAD"), 1000.0) FROM clean_c)
    AND ("Rating" IS NULL OR "Rating" >= 0.0)
)"""


def with_ctes(ctes: str, body: str) -> str:
    return "WITH " + ctes.strip() + "\n" + body


def round_bins(bins: int, places: int = 6) -> str:
    """Histogram with round steps over the column ``x`` of the table ``v``, in CTEs that follow it."""
    return f"""
, range_of AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
powers AS (SELECT lo, hi, CAST(floor(log10((hi - lo) / {bins}.0)) AS INTEGER) - 1 AS k FROM range_of WHERE hi > lo),
steps AS (SELECT lo, hi, m * pow(10.0, greatest(k, 0)) / pow(10.0, greatest(-k, 0)) AS step
          FROM powers, (SELECT CAST(unnest([1, 2, 5, 10, 20, 50, 100, 200, 500, 1000]) AS DOUBLE) AS m)),
chosen AS (SELECT coalesce(min(step), 1.0) AS step FROM steps WHERE floor(hi / step) - floor(lo / step) + 1 <= {bins}),
counted AS (SELECT floor(x / step) AS b, step, floor(lo / step) AS b0, count(*) AS n FROM v, chosen, range_of GROUP BY ALL)
SELECT CAST(b - b0 + 1 AS INTEGER) AS bin, round(b * step, {places}) AS bin_lo, round((b + 1) * step, {places}) AS bin_hi, n FROM counted"""
