"""Nested storefront documents -> flat variant table.

A page is a JSON object ``{"products": [...]}``; many pages (files or rows)
are simply a bigger input: ``explode`` runs per row, so flattening is a
narrow, fully parallel map with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VARIANT_STRUCT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("sku", T.StringType()), T.StructField("price", T.StringType()),
    T.StructField("compare_at_price", T.StringType()), T.StructField("available", T.BooleanType()),
    T.StructField("created_at", T.StringType()), T.StructField("updated_at", T.StringType()),
])
PRODUCT_STRUCT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("handle", T.StringType()), T.StructField("vendor", T.StringType()),
    T.StructField("product_type", T.StringType()), T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()), T.StructField("published_at", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("body_html", T.StringType()),
    T.StructField("images", T.ArrayType(T.StructType([T.StructField("src", T.StringType())]))),
    T.StructField("variants", T.ArrayType(VARIANT_STRUCT)),
])
PAGE_SCHEMA = T.StructType([T.StructField("products", T.ArrayType(PRODUCT_STRUCT))])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """S4 from files: one JSON page per line (or per file with ``multiLine``)."""
    return spark.read.schema(PAGE_SCHEMA).json(path)


def parse_pages(df: DataFrame, text_col: str = "value") -> DataFrame:
    """S4 from a text column: parse each page with the fixed schema."""
    return df.withColumn("_page", F.from_json(F.col(text_col), PAGE_SCHEMA)).select("*", "_page.products")


def flatten(pages: DataFrame, store_col: str = "store_domain") -> DataFrame:
    """One row per variant; a product without variants keeps one row of nulls.

    Pages without ``products`` (or with an empty list) contribute nothing.
    """
    # an inner explode would infer a filter on its array, and that filter would parse every page once more
    p = (pages.select(F.col(store_col).alias("store_domain"), F.posexplode_outer("products").alias("place", "p"))
         .where(F.col("place").isNotNull()).drop("place"))
    srcs = F.col("p.images.src")
    v = p.select(
        "store_domain",
        F.col("p.id").alias("product_id"), F.col("p.title").alias("title"), F.col("p.handle").alias("handle"),
        F.col("p.vendor").alias("vendor"), F.col("p.product_type").alias("product_type"),
        F.col("p.created_at").alias("created_at"), F.col("p.updated_at").alias("updated_at"),
        F.col("p.published_at").alias("published_at"),
        F.coalesce(F.array_join("p.tags", ", "), F.lit("")).alias("tags"),          # E16
        F.col("p.body_html").alias("body_html"),
        F.get(F.col("p.images"), 0).getField("src").alias("image_src"),             # E15
        F.coalesce(F.array_join(F.filter(srcs, lambda x: x.isNotNull() & (x != "")), "|"),
                   F.lit("")).alias("all_image_srcs"),
        F.explode_outer("p.variants").alias("v"),
    )
    return v.select(
        "store_domain", "product_id", "title", "handle", "vendor", "product_type", "created_at", "updated_at",
        "published_at", "tags", "body_html",
        F.col("v.id").alias("variant_id"), F.col("v.title").alias("variant_title"), F.col("v.sku").alias("sku"),
        F.col("v.price").alias("price"), F.col("v.compare_at_price").alias("compare_at_price"),
        F.col("v.available").alias("available"), F.col("v.created_at").alias("variant_created_at"),
        F.col("v.updated_at").alias("variant_updated_at"), "image_src", "all_image_srcs",
    )
