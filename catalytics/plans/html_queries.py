"""Registered HTML extraction queries and their DuckDB oracles."""

from __future__ import annotations

from ..functions import fixed
from ..session import read_table
from ..sources import html as H
from . import fixtures
from . import sql as S

SHOP_BASE = "https://shop.example.com"


def q_card_extract(spark, sf):
    cards = H.extract_cards(fixtures.cards_html(spark, sf), base=SHOP_BASE)
    return cards.select("page_number", "url", "name", "price", "original_price", "discount_percentage", "rating",
                        "sales_info", "image_url", "additional_badges")


def q_detail_extract(spark, sf):
    return H.extract_details(fixtures.detail_html(spark, sf))


def q_page_links(spark, sf):
    pages = read_table(spark, sf, "pages").select("page_id", "url", "html")
    return H.page_links(pages.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "page_id"))  # the table is one row group


def q_product_links(spark, sf):
    return H.page_links(fixtures.product_list_html(spark, sf), cards=H.product_cards, link=fixed.PRODUCT_LINK)


QUERIES = {
    "q_card_extract": q_card_extract,
    "q_detail_extract": q_detail_extract,
    "q_page_links": q_page_links,
    "q_product_links": q_product_links,
}

ORACLE = {
    "q_card_extract": S.with_ctes(S.LISTINGS_RAW, """
SELECT page_number, url, name, price, original_price, discount_percentage, rating, sales_info, image_url,
       additional_badges
FROM listings_raw WHERE page_number % 7 <> 0 AND row_seq % 50 <> 7"""),
    "q_detail_extract": """
SELECT 'https://retail.example.com/p/' || CAST(p_partkey AS VARCHAR) AS url,
  CASE WHEN p_partkey % 47 = 0 THEN 'Error processing page' WHEN p_partkey % 41 = 0 THEN 'N/A (pageTitle H1 not found)'
       WHEN p_partkey % 3 = 0 THEN p_name ELSE p_name || ' ' || lower(p_type) END AS name,
  CASE WHEN p_partkey % 47 = 0 THEN 'N/A' ELSE '$' || CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR)
      || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ' (incl. VAT)' END END AS price,
  CASE WHEN p_partkey % 47 = 0 OR p_partkey % 5 = 0 THEN 'N/A' ELSE CAST(CAST(1 + p_size * 0.08 AS DECIMAL(3,1)) AS VARCHAR) END AS rating,
  CASE WHEN p_partkey % 47 = 0 OR p_partkey % 6 = 0 THEN 'N/A' WHEN p_partkey % 6 = 1 THEN CAST(p_partkey AS VARCHAR)
       WHEN p_partkey % 12 = 2 THEN CAST(p_partkey * 7 AS VARCHAR) ELSE CAST(p_partkey * 3 AS VARCHAR) END AS reviews_count
FROM part""",
    # the pages' links are all root-relative
    "q_page_links": """
WITH a AS (SELECT page_id, url, string_split(html, '<a href="') AS arr FROM pages),
l AS (SELECT page_id, url, pos, string_split(arr[pos], '"')[1] AS href
      FROM (SELECT page_id, url, arr, unnest(range(2, len(arr) + 1)) AS pos FROM a)),
r AS (SELECT page_id, pos, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)
        || replace(replace(replace(replace(replace(href, '&quot;', '"'), '&#x27;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS link
      FROM l),
f AS (SELECT page_id, link, min(pos) AS first_pos FROM r GROUP BY page_id, link)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY first_pos) AS INTEGER) AS rank, link FROM f""",
    "q_product_links": """
WITH l AS (SELECT p_partkey // 40 AS page_id, p_partkey AS k, CAST(p_partkey AS VARCHAR) AS t,
                  'https://retail.example.com/list/p' || CAST(p_partkey // 40 AS VARCHAR) || '/' AS dir
           FROM part WHERE p_partkey % 13 <> 0)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INTEGER) AS rank,
  CASE k % 6 WHEN 0 THEN 'https://retail.example.com/p/' || t WHEN 1 THEN 'https://retail.example.com/list/p/' || t
       WHEN 2 THEN 'https://cdn.example.com/p/' || t WHEN 3 THEN 'https://other.example.com/p/' || t || '?a=1&b=2'
       WHEN 4 THEN dir || t || '.html' ELSE dir || 'index.html?p=' || t END AS link
FROM l""",
}
