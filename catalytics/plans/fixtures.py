"""Catalogue-shaped inputs derived from the driver tables.

The original application reads scraped CSV / JSON / HTML. The driver gives
TPC-H-like Parquet tables instead, so each input shape is derived from them
with a Spark job (joins + aggregation), and its work grows with the tables:

* ``listings_raw``  - one marketplace listing per ``part`` row, text columns
  written in the dirty formats the parsers expect (prices with ``MAD`` and a
  decimal comma, ``N/A`` sentinels, sales like ``1 234 vendus`` / ``5.2k``).
* ``variants_raw``  - one storefront variant per ``lineitem`` row (21 text
  columns of the flat variant table).
* ``products_json`` - nested product documents (one per part) as JSON text.

The DuckDB oracle builds the same rows with its own SQL (``plans/oracle.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table


def listings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    sales = (read_table(spark, sf_dir, "lineitem")
             .groupBy("l_partkey")
             .agg(F.sum("l_quantity").cast("bigint").alias("q"), F.max("l_discount").alias("d")))
    j = part.join(sales, part.p_partkey == sales.l_partkey, "left")
    return j.select(
        F.col("p_partkey").alias("row_seq"),
        F.expr("CAST(p_partkey DIV 60 + 1 AS INT)").alias("page_number"),
        F.expr("concat('https://shop.example.com/item/', CAST(p_partkey AS STRING), '.html')").alias("url"),
        F.expr("concat('item ', p_name)").alias("name"),
        F.expr("""CASE WHEN p_partkey % 17 = 0 THEN 'N/A'
                   WHEN p_partkey % 5 = 0
                     THEN concat(replace(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING), '.', ','), ' MAD')
                   ELSE concat('MAD ', CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING)) END""").alias("price"),
        F.expr("""CASE WHEN p_partkey % 4 = 0
                     THEN concat('MAD ', CAST(CAST(p_retailprice AS DECIMAL(12,2)) + CAST(250 AS DECIMAL(12,2)) AS STRING))
                   WHEN p_partkey % 4 = 2
                     THEN concat('MAD ', CAST(CAST(p_retailprice AS DECIMAL(12,2)) - CAST(100 AS DECIMAL(12,2)) AS STRING))
                   ELSE 'N/A' END""").alias("original_price"),
        F.expr("""CASE WHEN d IS NULL OR d = 0 THEN 'N/A'
                   ELSE concat('-', CAST(CAST(round(d * 100) AS INT) AS STRING), '%') END""").alias("discount_percentage"),
        F.expr("""CASE WHEN p_partkey % 13 = 0 THEN 'N/A'
                   WHEN p_partkey % 7 = 0 THEN replace(CAST(CAST(1 + p_size * 0.08 AS DECIMAL(3,1)) AS STRING), '.', ',')
                   ELSE CAST(CAST(1 + p_size * 0.08 AS DECIMAL(3,1)) AS STRING) END""").alias("rating"),
        F.expr("""CASE WHEN q IS NULL THEN 'N/A'
                   WHEN p_partkey % 11 = 0 THEN concat(CAST(q AS STRING), '+ vendus')
                   WHEN p_partkey % 7 = 3 AND q >= 1000
                     THEN concat(CAST(q DIV 1000 AS STRING), ' ', lpad(CAST(q % 1000 AS STRING), 3, '0'), ' vendus')
                   WHEN p_partkey % 13 = 5 AND q >= 1000
                     THEN concat(CAST(q DIV 1000 AS STRING), '.', CAST((q % 1000) DIV 100 AS STRING), 'k vendus')
                   WHEN p_partkey % 29 = 1 THEN concat('plus de ', CAST(q AS STRING), ' vendus')
                   ELSE concat(CAST(q AS STRING), ' vendus') END""").alias("sales_info"),
        F.expr("""CASE WHEN p_partkey % 23 = 0 THEN 'N/A'
                   ELSE concat('https://img.example.com/', CAST(p_partkey AS STRING), '.jpg') END""").alias("image_url"),
        F.expr("""CASE WHEN p_partkey % 9 = 0 THEN 'Le plus vendu'
                   WHEN p_partkey % 14 = 0 THEN 'AliExpress Choice | Livraison gratuite'
                   WHEN p_partkey % 10 = 3 THEN 'Livraison gratuite'
                   ELSE 'N/A' END""").alias("additional_badges"),
    )


def variant_sources(spark: SparkSession, sf_dir: str, dates: bool = True) -> DataFrame:
    """One narrow row per line item, of which ``variant_texts`` makes a variant: what a shuffle or a written copy should carry.

    Without ``dates`` the order dates are null and ``orders`` is not read.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount",
        "l_returnflag", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    if dates:  # first, so that the names of the parts are not in this join's shuffle
        orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
        li = li.join(orders, li.l_orderkey == orders.o_orderkey, "left").drop("o_orderkey")
    else:
        li = li.withColumn("o_orderdate", F.lit(None).cast("date"))
    return (li.join(supp, li.l_suppkey == supp.s_suppkey)
            .join(nation, supp.s_nationkey == nation.n_nationkey)
            .join(part, li.l_partkey == part.p_partkey)  # last, for the same reason
            .drop("p_partkey", "s_suppkey", "s_nationkey", "n_nationkey"))


#: Of a variant, in terms of ``variant_sources``.
VARIANT_ID = "l_orderkey * 10 + l_linenumber"


def variant_texts(j: DataFrame) -> DataFrame:
    """The text columns of the flat variant table, from ``variant_sources``."""
    return j.select(
        F.expr("concat(lower(n_name), '.example.com')").alias("store_domain"),
        F.col("l_partkey").alias("product_id"),
        F.col("p_name").alias("title"),
        F.expr("replace(p_name, ' ', '-')").alias("handle"),
        F.expr("CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE p_brand END").alias("vendor"),
        F.col("p_type").alias("product_type"),
        F.expr("CASE WHEN l_orderkey % 29 = 0 THEN 'garbage' ELSE CAST(o_orderdate AS STRING) END").alias("created_at"),
        F.expr("CAST(l_shipdate AS STRING)").alias("updated_at"),
        F.expr("CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS STRING) END").alias("published_at"),
        F.expr("concat(lower(p_brand), ', ', lower(p_type))").alias("tags"),
        F.expr("concat('<p>', p_name, '</p>\n<p>\"', p_type, '\"</p>')").alias("body_html"),
        F.expr(VARIANT_ID).alias("variant_id"),
        F.expr("concat('V', CAST(l_linenumber AS STRING))").alias("variant_title"),
        F.expr("concat('SKU-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING))").alias("sku"),
        F.expr("""CASE WHEN l_orderkey % 23 = 0 THEN 'bad'
                   ELSE CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS STRING) END""").alias("price"),
        F.expr("""CASE WHEN l_discount >= 0.05
                   THEN CAST(CAST(l_extendedprice AS DECIMAL(14,2)) + CAST(10 AS DECIMAL(14,2)) AS STRING)
                   ELSE NULL END""").alias("compare_at_price"),
        F.expr("CASE l_returnflag WHEN 'N' THEN 'True' WHEN 'R' THEN 'false' ELSE NULL END").alias("available"),
        F.expr("CAST(l_shipdate AS STRING)").alias("variant_created_at"),
        F.expr("CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_shipdate AS STRING) ELSE 'n/a' END").alias("variant_updated_at"),
        F.expr("concat('https://cdn.example.com/', CAST(l_partkey AS STRING), '-0.jpg')").alias("image_src"),
        F.expr("""concat('https://cdn.example.com/', CAST(l_partkey AS STRING), '-0.jpg|https://cdn.example.com/',
                   CAST(l_partkey AS STRING), '-1.jpg')""").alias("all_image_srcs"),
        # unique tie-break key, carried for deterministic ordering
        F.col("l_suppkey").alias("supplier_key"),
    )


def variants_raw(spark: SparkSession, sf_dir: str, dates: bool = True) -> DataFrame:
    """One variant per line item; without ``dates`` the order dates are null and ``orders`` is not read."""
    return variant_texts(variant_sources(spark, sf_dir, dates))


VARIANT_COLUMNS = ["store_domain", "product_id", "title", "handle", "vendor", "product_type", "created_at",
                   "updated_at", "published_at", "tags", "body_html", "variant_id", "variant_title", "sku", "price",
                   "compare_at_price", "available", "variant_created_at", "variant_updated_at", "image_src",
                   "all_image_srcs"]


ORDERS_PER_PAGE = 50_000


def products_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON text per part: ``{"products": [ {product with variants} ]}``.

    Variants come from the part's line items; parts with ``p_partkey % 31 == 0``
    get an empty variant list, parts with ``% 37 == 0`` have no ``variants``
    key at all. Images hold 0-3 entries, one with an empty ``src``.
    """
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    # Paginate: a part's variants of ORDERS_PER_PAGE orders form a document, so no document (and no
    # collect_list group) holds a hot part whole. Pages are concatenated on read, so flattening
    # gives the same rows. Parts whose variant list must be empty or absent keep a single document.
    li = li.withColumn("page", F.floor(F.col("l_orderkey") / ORDERS_PER_PAGE))
    li = li.where(~((F.col("l_partkey") % 31 == 0) | (F.col("l_partkey") % 37 == 0)))
    variants = (li.groupBy("l_partkey", "page")
                .agg(F.collect_list(F.struct(
                    F.expr("l_orderkey * 10 + l_linenumber").alias("id"),
                    F.expr("concat('V', CAST(l_linenumber AS STRING))").alias("title"),
                    F.expr("concat('SKU-', CAST(l_orderkey AS STRING))").alias("sku"),
                    F.expr("CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS STRING)").alias("price"),
                    F.lit(None).cast("string").alias("compare_at_price"),
                    F.expr("l_returnflag = 'N'").alias("available"),
                    F.expr("CAST(l_shipdate AS STRING)").alias("created_at"),
                    F.expr("CAST(l_shipdate AS STRING)").alias("updated_at"),
                )).alias("variants")))
    j = part.join(variants, part.p_partkey == variants.l_partkey, "left")
    images = F.expr("""CASE p_partkey % 4
        WHEN 0 THEN array()
        WHEN 1 THEN array(named_struct('src', concat('https://cdn.example.com/', CAST(p_partkey AS STRING), '-a.jpg')))
        WHEN 2 THEN array(named_struct('src', ''),
                          named_struct('src', concat('https://cdn.example.com/', CAST(p_partkey AS STRING), '-b.jpg')))
        ELSE array(named_struct('src', concat('https://cdn.example.com/', CAST(p_partkey AS STRING), '-a.jpg')),
                   named_struct('src', concat('https://cdn.example.com/', CAST(p_partkey AS STRING), '-b.jpg')),
                   named_struct('src', concat('https://cdn.example.com/', CAST(p_partkey AS STRING), '-c.jpg'))) END""")
    tags = F.expr("CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE array(lower(p_brand), lower(p_type)) END")
    base = [
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
        F.expr("replace(p_name, ' ', '-')").alias("handle"), F.col("p_brand").alias("vendor"),
        F.col("p_type").alias("product_type"),
        F.lit("2024-01-01T00:00:00+00:00").alias("created_at"),
        F.lit("2024-02-01T00:00:00+00:00").alias("updated_at"),
        F.lit("2024-01-15T00:00:00+00:00").alias("published_at"),
        tags.alias("tags"),
        F.expr("concat('<p>', p_name, '</p>\n<p>\"quoted\" text</p>')").alias("body_html"),
        images.alias("images"),
    ]
    with_variants = F.struct(*base, F.coalesce(F.col("variants"), F.array()).alias("variants"))
    empty_variants = F.struct(*base, F.array().alias("variants"))
    no_variants = F.struct(*base)
    doc = (F.when(F.col("p_partkey") % 37 == 0, F.to_json(F.struct(F.array(no_variants).alias("products"))))
           .when(F.col("p_partkey") % 31 == 0, F.to_json(F.struct(F.array(empty_variants).alias("products"))))
           .otherwise(F.to_json(F.struct(F.array(with_variants).alias("products")))))
    store = F.concat(F.lit("store"), (F.col("p_partkey") % 5).cast("string"), F.lit(".example.com"))
    return j.select(F.col("p_partkey").alias("doc_key"), F.coalesce(F.col("page"), F.lit(0)).alias("page"),
                    store.alias("store_domain"), doc.alias("value"))


# --- rendered HTML pages ----------------------------------------------------------------

CARDS_PER_PAGE = 60


def cards_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search-result pages rendered from ``listings_raw`` (one row per page).

    Cards sit in ``div#card-list``; prices are written as 4 spans, 2 spans or
    one text; links are protocol-relative, root-relative or absolute; badges
    come as spans or as image titles. Pages with ``page_number % 7 == 0`` have
    no container (they yield nothing) and every card with ``row_seq % 50 == 7``
    is wrapped one level deeper (not a direct child: ignored).
    """
    lr = listings_raw(spark, sf_dir)
    k = F.col("row_seq")
    path = F.regexp_extract("url", r"^https://shop\.example\.com(/.*)$", 1)
    href = (F.when(k % 3 == 0, F.concat(F.lit("//shop.example.com"), path))
            .when(k % 3 == 1, path).otherwise(F.col("url")))
    link = F.concat(F.lit('<a class="jr_g" href="'), href, F.lit('">'))
    name = F.concat(F.lit('<h3 class="jr_kp"> '), F.col("name"), F.lit(" </h3>"))
    m = F.regexp_extract("price", r"^MAD ([0-9]+)\.([0-9]+)$", 1)
    d = F.regexp_extract("price", r"^MAD ([0-9]+)\.([0-9]+)$", 2)
    price = (F.when(F.col("price") == "N/A", F.lit(""))
             .when((m != "") & (k % 3 == 1), F.concat(
                 F.lit('<div class="jr_kr"><span>MAD</span><span>'), m, F.lit("</span><span>.</span><span>"), d,
                 F.lit("</span></div>")))
             .when((m != "") & (k % 3 == 2), F.concat(
                 F.lit('<div class="jr_kr"><span>MAD</span><span>'), m, F.lit("."), d, F.lit("</span></div>")))
             .otherwise(F.concat(F.lit('<div class="jr_kr">'), F.col("price"), F.lit("</div>"))))

    def opt(col, open_tag, close_tag):
        return F.when(F.col(col) == "N/A", F.lit("")).otherwise(F.concat(F.lit(open_tag), F.col(col), F.lit(close_tag)))

    sales = F.when(F.col("sales_info") == "N/A", F.lit("")).otherwise(F.concat(
        F.lit('<span class="jr_j7">'), F.when(k % 4 == 0, F.lit("+ ")).otherwise(F.lit("")), F.col("sales_info"),
        F.lit("</span>")))
    src = F.regexp_extract("image_url", r"^https://img\.example\.com(/.*)$", 1)
    img = (F.when(F.col("image_url") == "N/A", F.lit(""))
           .when(k % 2 == 0, F.concat(F.lit('<img class="mm_be" src="//img.example.com'), src, F.lit('">')))
           .otherwise(F.concat(F.lit('<img class="mm_be" src="'), F.col("image_url"), F.lit('">'))))
    parts = F.split("additional_badges", r" \| ")
    badges = (F.when(F.col("additional_badges") == "N/A", F.lit(""))
              .when(k % 2 == 0, F.concat(F.lit('<div class="jr_ae">'), F.array_join(
                  F.transform(parts, lambda p: F.concat(F.lit('<span class="jr_ae">'), p, F.lit("</span>"))), ""),
                  F.lit("</div>")))
              .otherwise(F.array_join(F.transform(parts, lambda p: F.concat(
                  F.lit('<div class="jr_k2"><img class="ms_mv" title="'), p, F.lit('"></div>'))), "")))
    card = F.concat(
        F.lit('<div class="hm_bu search-item-card-wrapper-gallery">'), link, img, name, F.lit("</a>"), price,
        opt("original_price", '<div class="jr_ks">', "</div>"),
        opt("discount_percentage", '<span class="jr_kt">', "</span>"),
        opt("rating", '<span class="jr_kf">', "</span>"), sales, badges, F.lit("</div>"))
    card = F.when(k % 50 == 7, F.concat(F.lit('<div class="wrap">'), card, F.lit("</div>"))).otherwise(card)
    # decoys: other orders of the class attribute, further classes, and text in a long unclosed nesting
    card = F.when(k % 50 == 3, F.concat(card, F.lit('<div class="search-item-card-wrapper-gallery hm_bu"><h3 class="jr_kp">no</h3></div>'),
                                        F.lit('<div class="hm_bu search-item-card-wrapper-gallery sold"><h3 class="jr_kp">no</h3></div>'))).otherwise(card)
    # a page holds at most CARDS_PER_PAGE cards: a bounded group
    pages = lr.groupBy("page_number").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_seq", card.alias("c")))),
                                 lambda s: s["c"]), "").alias("cards"))
    body = F.when(F.col("page_number") % 7 == 0, F.concat(F.lit('<div id="results">'), F.col("cards"), F.lit("</div>"))) \
        .otherwise(F.concat(F.lit('<div id="card-list">'), F.col("cards"), F.lit("</div>")))
    deep = F.when(F.col("page_number") % 3 == 0, F.repeat(F.lit("<div><i>"), 3000)).otherwise(F.lit(""))
    return pages.select("page_number", F.concat(F.lit("<html><body><h1>Top</h1>"), body, deep,
                                                F.lit("</body></html>")).alias("html"))


def detail_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retail product pages rendered from ``part`` (one row per part).

    Some pages lack the alt name, the tax label, the rating or the review
    count; some carry the review count only in the fallback block; pages with
    ``p_partkey % 41 == 0`` have no title heading at all.
    """
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    p = p.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")  # the table is one row group; rows are small before rendering
    k = F.col("p_partkey")
    url = F.concat(F.lit("https://retail.example.com/p/"), k.cast("string"))
    alt = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit('<span class="ProductName-alt"> '),
                                                             F.lower("p_type"), F.lit(" </span>")))
    h1 = F.when(k % 41 == 0, F.lit('<h2>no title</h2>')).otherwise(F.concat(
        F.lit('<h1 id="pageTitle"><span class="ProductName-primary">'), F.col("p_name"), F.lit("</span>"), alt,
        F.lit("</h1>")))
    price_txt = F.concat(F.lit("$"), F.expr("CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS STRING)"))
    tax = F.when(k % 4 == 0, F.lit("")).otherwise(F.lit('<span class="ProductPrice-taxLabel">incl. VAT</span>'))
    price = F.concat(F.lit('<div class="ProductDetails-form__price"><div class="ProductPrice">'
                           '<span class="was">$0</span><span class="big '), F.when(k % 2 == 0, F.lit("ProductPrice-price--sale"))
                     .otherwise(F.lit("ProductPrice-finalPrice")), F.lit('">'), price_txt, F.lit("</span>"), tax,
                     F.lit("</div></div>"))
    rating = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(
        F.lit('<div class="bv_avgRating_component_container notranslate">'),
        F.expr("CAST(CAST(1 + p_size * 0.08 AS DECIMAL(3,1)) AS STRING)"), F.lit("</div>")))
    reviews = (F.when(k % 6 == 0, F.lit(""))
               .when(k % 6 == 1, F.concat(F.lit('<div class="ProductDetails-header-V2-metadata">'
                                                '<div class="bv_numReviews_text">('), k.cast("string"),
                                          F.lit(")</div></div>")))
               .when(k % 12 == 2, F.concat(F.lit('<div class="ProductDetails-header-V2-metadata"><b class="bv_numReviews_text">('),
                                           (k * 7).cast("string"), F.lit(")</b></div>"),  # first in the page
                                           F.lit('<button class="bv_main_container_row_flex"><div class="bv_numReviews_text">('),
                                           (k * 3).cast("string"), F.lit(")</div></button>")))
               .otherwise(F.concat(F.lit('<button class="bv_main_container_row_flex"><div class="bv_numReviews_text">('),
                                   (k * 3).cast("string"), F.lit(")</div></button>"))))
    html = F.concat(F.lit("<html><body>"), h1, price, rating, reviews, F.lit("</body></html>"))
    html = F.when(k % 47 != 0, html)  # pages that did not load
    return p.select(k.alias("part_key"), url.alias("url"), html.alias("html"))


PRODUCTS_PER_PAGE = 40


def product_list_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retail listing pages rendered from ``part``: one card per part, links in all forms of an address.

    Parts with ``p_partkey % 13 == 0`` have no product link; those with
    ``% 10 == 9`` have two cards; links outside cards and other links inside
    them must not be taken.
    """
    p = read_table(spark, sf_dir, "part").select("p_partkey")
    k = F.col("p_partkey")
    text = k.cast("string")
    forms = ["href=\"/p/{0}\"", "HREF='../p/{0}'", "href=\"//cdn.example.com/p/{0}\"",
             "href='https://other.example.com/p/{0}?a=1&amp;b=2'", "Href={0}.html", "href=\"?p={0}\""]
    href = F.lit("")
    for n, form in enumerate(forms):
        href = F.when(k % len(forms) == n, F.replace(F.lit(form), F.lit("{0}"), text)).otherwise(href)
    link = F.when(k % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("<a class='big ProductCard-link' "), href, F.lit(">x</a>")))
    card = F.concat(F.lit('<li class="ProductCard new"><a href="/no">n</a>'), link, F.lit("</li>"))
    card = F.when(k % 10 == 9, F.concat(card, card)).otherwise(card)
    page = F.floor(k / PRODUCTS_PER_PAGE)
    # a page holds at most PRODUCTS_PER_PAGE parts: a bounded group
    pages = p.groupBy(page.alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k, card.alias("c")))),
                                                                          lambda s: s["c"]), "").alias("cards"))
    head = F.lit("<html><body><a class='ProductCard-link' href='/outside'>o</a><ul class='ProductCardListing-grid'>")
    return pages.select("page_id", F.concat(F.lit("https://retail.example.com/list/p"), F.col("page_id").cast("string"),
                                            F.lit("/index.html?page=1")).alias("url"),
                        F.concat(head, F.col("cards"), F.lit("</ul></body></html>")).alias("html"))
