"""Registered storefront queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import stats
from ..operators import variants as V
from ..sources import documents
from ..session import read_table, scratch_path
from ..sources import files
from . import fixtures
from .sql import round_bins

R = 6
PROBE_STORE = "nation_3.example.com"
PROBE_VENDOR = "Brand#4"
PROBE_TYPE = "SMALL"
STORE_SALTS = 16


def _r(c: str):
    return F.round(F.col(c), R).alias(c)


def _s(c: str):
    return F.col(c).cast("string").alias(c)


def cleaned(spark: SparkSession, sf: str, dates: bool = False) -> DataFrame:
    return V.clean_variants(fixtures.variants_raw(spark, sf, dates))


def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    """Default dashboard selection: all facets, default price range, all availability."""
    return V.availability_filter(V.price_range_filter(V.facet_filter(cleaned(spark, sf))))


def _place(top: DataFrame, *order) -> DataFrame:
    """Number the rows of a short ranking (a limit's result) in its own order."""
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def q_variant_clean(spark, sf):
    return cleaned(spark, sf, dates=True).select(
        *V.ORDER, "store_domain", "vendor", "product_type", "price", "compare_at_price", "available",
        *[_s(c) for c in V.TIMESTAMP_COLUMNS])


def q_variant_kpis(spark, sf):
    k = V.kpis(dashboard(spark, sf))
    return k.select("unique_products", "variants", "available_variants", "unavailable_variants",
                    _r("avg_price"), _r("median_price"), "vendors", "product_types", _r("unavailable_pct"))


def q_variant_kpi_display(spark, sf):
    return V.kpi_display(V.kpis(dashboard(spark, sf)))


def q_facet_values(spark, sf):
    return V.facet_values(cleaned(spark, sf), store=PROBE_STORE, vendor=PROBE_VENDOR)


def q_facet_cascade(spark, sf):
    df = V.facet_filter(cleaned(spark, sf), PROBE_STORE, PROBE_VENDOR, PROBE_TYPE)
    df = V.availability_filter(V.price_range_filter(df), True)
    return df.select(*V.ORDER, "price")


def q_variant_bounds(spark, sf):
    """Slider limits of the whole table, of one store and of a selection without prices."""
    df = cleaned(spark, sf)
    views = {"all": df, "store": V.facet_filter(df, store=PROBE_STORE), "none": df.where(F.col("price").isNull()),
             "one": df.where(F.col("price") == df.select(F.max("price")).scalar())}
    out = None
    for name, view in views.items():
        row = stats.slider_bounds(view, "price").withColumn("view", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def q_availability(spark, sf):
    return V.availability_counts(dashboard(spark, sf))


def q_products_by_vendor(spark, sf):
    return _place(V.products_by(dashboard(spark, sf), "vendor"), F.desc("unique_products"), "vendor")


def q_products_by_type(spark, sf):
    return _place(V.products_by(dashboard(spark, sf), "product_type"), F.desc("unique_products"), "product_type")


def q_vendor_dominance(spark, sf):
    d = V.vendor_dominance(dashboard(spark, sf))
    return d.select("top_vendor", "top_vendor_products", "total_vendor_products", _r("top_vendor_share"),
                    "dominant")


def q_unavailable_sample(spark, sf):
    return V.unavailable_sample(dashboard(spark, sf), place=True)


def q_most_expensive(spark, sf):
    return V.most_expensive(dashboard(spark, sf), place=True)


def q_raw_projection(spark, sf):
    p = V.raw_projection(dashboard(spark, sf))
    return p.withColumn("updated_at", F.col("updated_at").cast("string"))


def q_hist_variant50(spark, sf):
    h = stats.histogram(dashboard(spark, sf), "price", 50)
    return h.select("bin", _r("bin_lo"), _r("bin_hi"), "n")


def q_hist_variant_round(spark, sf):
    h = stats.round_histogram(dashboard(spark, sf), "price", 50)
    return h.select("bin", _r("bin_lo"), _r("bin_hi"), "n")


def q_json_flatten(spark, sf):
    pages = documents.parse_pages(fixtures.products_json(spark, sf))
    flat = documents.flatten(pages)
    return flat.select("store_domain", "product_id", "title", "vendor", "tags", "image_src", "all_image_srcs",
                       "variant_id", "variant_title", "price", "available")


def land_variants(spark, sf, path: str) -> None:
    """Land the typed variant table once, partitioned by store (F5 then prunes whole folders)."""
    # a store's rows meet in STORE_SALTS tasks: few files per folder, and a hot store still spreads; the narrow
    # rows are shuffled, the text columns are made of them behind the shuffle
    narrow = fixtures.variant_sources(spark, sf)
    narrow = narrow.repartition("n_name", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(STORE_SALTS)))
    files.write_table(V.clean_variants(fixtures.variant_texts(narrow)), path, partition_by=["store_domain"])


def q_landed_store_facet(spark, sf):
    path = scratch_path(spark, "variants-by-store")
    land_variants(spark, sf, path)
    landed = spark.read.parquet(path)
    return (V.facet_filter(landed, store=PROBE_STORE)
            .select(*V.ORDER, "store_domain", "vendor", "price", "available"))


def q_store_endpoint(spark, sf):
    """E14 on every page's address without its scheme (host, path, query as a user would type it)."""
    pages = read_table(spark, sf, "pages").select("page_id", "url")
    d = pages.select("page_id", F.regexp_replace("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "").alias("domain"))
    return d.withColumn("endpoint", parse.store_endpoint("domain"))


QUERIES = {
    "q_variant_clean": q_variant_clean,
    "q_variant_kpis": q_variant_kpis,
    "q_variant_kpi_display": q_variant_kpi_display,
    "q_facet_values": q_facet_values,
    "q_facet_cascade": q_facet_cascade,
    "q_variant_bounds": q_variant_bounds,
    "q_availability": q_availability,
    "q_products_by_vendor": q_products_by_vendor,
    "q_products_by_type": q_products_by_type,
    "q_vendor_dominance": q_vendor_dominance,
    "q_unavailable_sample": q_unavailable_sample,
    "q_most_expensive": q_most_expensive,
    "q_raw_projection": q_raw_projection,
    "q_hist_variant50": q_hist_variant50,
    "q_hist_variant_round": q_hist_variant_round,
    "q_json_flatten": q_json_flatten,
    "q_store_endpoint": q_store_endpoint,
    "q_landed_store_facet": q_landed_store_facet,
}


# --- oracles -------------------------------------------------------------------------

def _to_double(s: str) -> str:
    t = f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
    return (f"(CASE WHEN regexp_full_match({t}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN TRY_CAST({t} AS DOUBLE) END)")


VARIANTS = f"""
variants_raw AS (
  SELECT lower(n_name) || '.example.com' AS store_domain, l_partkey AS product_id, p_name AS title,
    replace(p_name, ' ', '-') AS handle,
    CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE p_brand END AS vendor, p_type AS product_type,
    CASE WHEN l_orderkey % 29 = 0 THEN 'garbage' ELSE CAST(o_orderdate AS VARCHAR) END AS created_at,
    CAST(l_shipdate AS VARCHAR) AS updated_at,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS VARCHAR) END AS published_at,
    l_orderkey * 10 + l_linenumber AS variant_id, 'V' || CAST(l_linenumber AS VARCHAR) AS variant_title,
    CASE WHEN l_orderkey % 23 = 0 THEN 'bad' ELSE CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR) END AS price,
    CASE WHEN l_discount >= 0.05
         THEN CAST(CAST(l_extendedprice AS DECIMAL(14,2)) + CAST(10 AS DECIMAL(14,2)) AS VARCHAR) END AS compare_at_price,
    CASE l_returnflag WHEN 'N' THEN 'True' WHEN 'R' THEN 'false' END AS available,
    CAST(l_shipdate AS VARCHAR) AS variant_created_at,
    CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_shipdate AS VARCHAR) ELSE 'n/a' END AS variant_updated_at,
    l_suppkey AS supplier_key
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey LEFT JOIN orders ON l_orderkey = o_orderkey
),
vclean AS (
  SELECT variant_id, product_id, supplier_key, title, variant_title,
    coalesce(store_domain, 'Inconnu') AS store_domain, coalesce(vendor, 'Inconnu') AS vendor,
    coalesce(product_type, 'Inconnu') AS product_type,
    {_to_double('price')} AS price, {_to_double('compare_at_price')} AS compare_at_price,
    CASE lower(available) WHEN 'true' THEN true WHEN 'false' THEN false END AS available,
    TRY_CAST(created_at AS TIMESTAMP) AS created_at, TRY_CAST(updated_at AS TIMESTAMP) AS updated_at,
    TRY_CAST(published_at AS TIMESTAMP) AS published_at,
    TRY_CAST(variant_created_at AS TIMESTAMP) AS variant_created_at,
    TRY_CAST(variant_updated_at AS TIMESTAMP) AS variant_updated_at
  FROM variants_raw
),
vdash AS (
  SELECT * FROM vclean
  WHERE price >= (SELECT coalesce(min(price), 0.0) FROM vclean)
    AND price <= (SELECT CASE WHEN max(price) IS NULL THEN 1.0 WHEN min(price) = max(price) THEN max(price) + 1.0
                              ELSE max(price) END FROM vclean)
)"""


def _w(body: str) -> str:
    return "WITH " + VARIANTS.strip() + "\n" + body


ORACLE = {
    "q_variant_clean": _w("""
SELECT variant_id, product_id, supplier_key, store_domain, vendor, product_type, price, compare_at_price, available,
  CAST(created_at AS VARCHAR) AS created_at, CAST(updated_at AS VARCHAR) AS updated_at,
  CAST(published_at AS VARCHAR) AS published_at, CAST(variant_created_at AS VARCHAR) AS variant_created_at,
  CAST(variant_updated_at AS VARCHAR) AS variant_updated_at
FROM vclean"""),
    "q_variant_kpis": _w(f"""
SELECT count(DISTINCT product_id) AS unique_products, count(*) AS variants,
  count(*) FILTER (WHERE available = true) AS available_variants,
  count(*) - count(*) FILTER (WHERE available = true) AS unavailable_variants,
  round(avg(price), {R}) AS avg_price, round(median(price), {R}) AS median_price,
  count(DISTINCT vendor) AS vendors, count(DISTINCT product_type) AS product_types,
  round(CASE WHEN count(*) > 0 THEN (count(*) - count(*) FILTER (WHERE available = true)) / count(*) * 100.0
        ELSE 0.0 END, {R}) AS unavailable_pct
FROM vdash"""),
    "q_facet_values": _w(f"""
SELECT DISTINCT 'store_domain' AS facet, store_domain AS value FROM vclean
UNION ALL SELECT DISTINCT 'vendor', vendor FROM vclean WHERE store_domain = '{PROBE_STORE}'
UNION ALL SELECT DISTINCT 'product_type', product_type FROM vclean
  WHERE store_domain = '{PROBE_STORE}' AND vendor = '{PROBE_VENDOR}'"""),
    "q_facet_cascade": _w(f"""
, f AS (SELECT * FROM vclean WHERE store_domain = '{PROBE_STORE}' AND vendor = '{PROBE_VENDOR}'
          AND product_type = '{PROBE_TYPE}')
SELECT variant_id, product_id, supplier_key, price FROM f
WHERE price >= (SELECT coalesce(min(price), 0.0) FROM f)
  AND price <= (SELECT CASE WHEN max(price) IS NULL THEN 1.0 WHEN min(price) = max(price) THEN max(price) + 1.0
                            ELSE max(price) END FROM f)
  AND available = true"""),
    "q_variant_bounds": _w(f"""
, v AS (SELECT 'all' AS view, price FROM vclean UNION ALL SELECT 'store', price FROM vclean WHERE store_domain = '{PROBE_STORE}'
        UNION ALL SELECT 'one', price FROM vclean WHERE price = (SELECT max(price) FROM vclean)),
b AS (SELECT view, min(price) AS lo, max(price) AS hi FROM v GROUP BY view UNION ALL SELECT 'none', NULL, NULL)
SELECT view, coalesce(lo, 0.0) AS price_min,
       CASE WHEN hi IS NULL THEN 1.0 WHEN hi = lo THEN hi + 1.0 ELSE hi END AS price_max FROM b"""),
    "q_availability": _w("""
SELECT available, count(*) AS n, CASE WHEN available THEN 'Disponible' ELSE 'Indisponible' END AS label
FROM vdash WHERE available IS NOT NULL GROUP BY available"""),
    "q_products_by_vendor": _w("""
SELECT *, CAST(row_number() OVER (ORDER BY unique_products DESC, vendor) AS INTEGER) AS place FROM (
SELECT vendor, count(DISTINCT product_id) AS unique_products FROM vdash GROUP BY vendor)
ORDER BY unique_products DESC, vendor LIMIT 20"""),
    "q_products_by_type": _w("""
SELECT *, CAST(row_number() OVER (ORDER BY unique_products DESC, product_type) AS INTEGER) AS place FROM (
SELECT product_type, count(DISTINCT product_id) AS unique_products FROM vdash GROUP BY product_type)
ORDER BY unique_products DESC, product_type LIMIT 20"""),
    "q_vendor_dominance": _w(f"""
, pv AS (SELECT vendor, count(DISTINCT product_id) AS n FROM vdash GROUP BY vendor),
top AS (SELECT vendor, n FROM pv ORDER BY n DESC, vendor LIMIT 1),
tot AS (SELECT count(*) AS n_vendors, sum(n) AS total FROM pv)
SELECT top.vendor AS top_vendor, top.n AS top_vendor_products, CAST(tot.total AS BIGINT) AS total_vendor_products,
       round(CAST(top.n AS DOUBLE) / tot.total * 100.0, {R}) AS top_vendor_share,
       CAST(top.n AS DOUBLE) / tot.total * 100.0 > 40.0 AS dominant
FROM top, tot WHERE tot.n_vendors > 1"""),
    "q_unavailable_sample": _w("""
SELECT title, variant_title, vendor, store_domain,
       CAST(row_number() OVER (ORDER BY min((variant_id, product_id, supplier_key))) AS INTEGER) AS place
FROM vdash WHERE available = false
GROUP BY title, variant_title, vendor, store_domain
ORDER BY min((variant_id, product_id, supplier_key)) LIMIT 10"""),
    "q_most_expensive": _w("""
, best AS (SELECT *, row_number() OVER (PARTITION BY product_id
                                         ORDER BY price DESC NULLS LAST, variant_id, product_id, supplier_key) AS rn
           FROM vdash)
SELECT product_id, title, vendor, price, store_domain,
       CAST(row_number() OVER (ORDER BY price DESC NULLS LAST, variant_id, product_id, supplier_key) AS INTEGER) AS place
FROM best WHERE rn = 1
ORDER BY price DESC NULLS LAST, variant_id, product_id, supplier_key LIMIT 5"""),
    "q_raw_projection": _w("""
SELECT store_domain, vendor, title, product_type, variant_title, price, available,
       CAST(updated_at AS VARCHAR) AS updated_at FROM vdash"""),
    "q_hist_variant_round": _w("""
, v AS (SELECT CAST(price AS DOUBLE) AS x FROM vdash WHERE price IS NOT NULL)""" + round_bins(50, R)),
    "q_hist_variant50": _w(f"""
, v AS (SELECT price AS x FROM vdash WHERE price IS NOT NULL),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT CASE WHEN r.hi = r.lo THEN 1
                  ELSE least(CAST(floor(50 * (v.x - r.lo) / (r.hi - r.lo)) AS BIGINT) + 1, 50) END AS bin,
             r.lo, r.hi FROM v, r)
SELECT CAST(bin AS INTEGER) AS bin, round(lo + (bin - 1) * ((hi - lo) / 50), {R}) AS bin_lo,
       round(lo + bin * ((hi - lo) / 50), {R}) AS bin_hi, count(*) AS n
FROM b GROUP BY bin, lo, hi"""),
    "q_json_flatten": """
WITH v AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS variant_id,
                  'V' || CAST(l_linenumber AS VARCHAR) AS variant_title,
                  CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR) AS price, l_returnflag = 'N' AS available
           FROM lineitem)
SELECT 'store' || CAST(p_partkey % 5 AS VARCHAR) || '.example.com' AS store_domain, p_partkey AS product_id,
  p_name AS title, p_brand AS vendor,
  CASE WHEN p_partkey % 6 = 0 THEN '' ELSE lower(p_brand) || ', ' || lower(p_type) END AS tags,
  CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 2 THEN ''
       ELSE 'https://cdn.example.com/' || CAST(p_partkey AS VARCHAR) || '-a.jpg' END AS image_src,
  CASE p_partkey % 4 WHEN 0 THEN ''
       WHEN 1 THEN 'https://cdn.example.com/' || CAST(p_partkey AS VARCHAR) || '-a.jpg'
       WHEN 2 THEN 'https://cdn.example.com/' || CAST(p_partkey AS VARCHAR) || '-b.jpg'
       ELSE 'https://cdn.example.com/' || CAST(p_partkey AS VARCHAR) || '-a.jpg|https://cdn.example.com/'
            || CAST(p_partkey AS VARCHAR) || '-b.jpg|https://cdn.example.com/' || CAST(p_partkey AS VARCHAR) || '-c.jpg'
  END AS all_image_srcs,
  v.variant_id, v.variant_title, v.price, v.available
FROM part LEFT JOIN v ON v.l_partkey = p_partkey AND p_partkey % 31 <> 0 AND p_partkey % 37 <> 0""",
    "q_store_endpoint": """
WITH d AS (SELECT page_id, regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS domain FROM pages)
SELECT page_id, domain, 'https://' || nullif(regexp_extract(domain, '^([^/?#]+)', 1), '') || '/products.json'
       AS endpoint FROM d""",
    "q_variant_kpi_display": _w("""
, k AS (SELECT count(DISTINCT product_id) AS unique_products, count(*) AS variants,
               count(*) FILTER (WHERE available = true) AS available_variants,
               avg(price) AS ap, median(price) AS mp, count(DISTINCT vendor) AS vendors,
               count(DISTINCT product_type) AS product_types FROM vdash)
SELECT format('{:,}', unique_products) AS unique_products_display, format('{:,}', variants) AS variants_display,
  format('{:,}', available_variants) AS available_variants_display,
  format('{:,}', variants - available_variants) AS unavailable_variants_display,
  format('{:,}', vendors) AS vendors_display, format('{:,}', product_types) AS product_types_display,
  CASE WHEN ap IS NULL THEN 'N/D' ELSE '$' || format('{:,.2f}', ap) END AS avg_price_display,
  CASE WHEN mp IS NULL THEN 'N/D' ELSE '$' || format('{:,.2f}', mp) END AS median_price_display,
  format('{:.1f}', CASE WHEN variants > 0 THEN (variants - available_variants) / variants * 100.0 ELSE 0.0 END)
    || '%' AS unavailable_pct_display
FROM k"""),
    "q_landed_store_facet": _w("""
SELECT variant_id, product_id, supplier_key, store_domain, vendor, price, available FROM vclean
WHERE store_domain = '{PROBE_STORE}'""".replace("{PROBE_STORE}", PROBE_STORE)),
}
