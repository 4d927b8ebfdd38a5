"""Registered file source / sink queries (S1, S2, S6, S7, S8) and their oracles.

Each query writes its input under the shared folder named by
``spark.checkpoint.dir`` and reads it back, so the whole table goes through
the sink and the source.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import listings as L
from ..operators import variants as V
from ..sources import files
from ..sources import quoted_csv
from ..streaming import kpi_state
from ..streaming.refresh import refresh
from ..session import materialise, scratch_path, shuffles_end_with_queries
from . import fixtures
from . import sql as S
from .variant_queries import VARIANTS

#: Parts of a table that one task writes into one file.
TASKS_PER_FILE = 8

#: Rows of a compressed landing file, some 60 MB of text.
DROP_ROWS = 100_000

LISTING_CSV_COLUMNS = ["row_seq"] + files.LISTING_COLUMNS


def _listing_csv(spark, sf) -> str:
    path = scratch_path(spark, "listings-csv")
    raw = fixtures.listings_raw(spark, sf).select(*LISTING_CSV_COLUMNS)
    files.write_csv(raw, path)                                   # S6
    return path


def q_csv_roundtrip(spark, sf):
    back = files.read_csv(spark, _listing_csv(spark, sf), LISTING_CSV_COLUMNS)   # S1
    return back.withColumn("row_seq", F.col("row_seq").cast("bigint"))


def q_csv_positional(spark, sf):
    cols = ["row_seq"] + files.POSITIONAL_COLUMNS
    pos = files.read_csv(spark, _listing_csv(spark, sf), cols, header=False)       # S2
    pos = pos.withColumn("row_seq", F.col("row_seq").try_cast("bigint"))
    return L.filter_grid(L.clean_c(pos)).select("row_seq", "Title", "Price_MAD", "Rating", "Sales_Num")


def _refreshed(spark, sf, state=None) -> str:
    """The folder of a typed variant table after two drops of landed CSV files."""
    base = scratch_path(spark, "refresh")
    landing, table, ckpt = f"{base}/landing", f"{base}/table", f"{base}/_checkpoint"
    cols = fixtures.VARIANT_COLUMNS + ["supplier_key"]
    schema = files.string_schema(cols)

    def typed(df):
        return V.clean_variants(df).withColumns({
            "variant_id": F.col("variant_id").cast("bigint"), "product_id": F.col("product_id").cast("bigint"),
            "supplier_key": F.col("supplier_key").cast("bigint")})

    sources, even = fixtures.variant_sources(spark, sf), F.expr(fixtures.VARIANT_ID) % 2 == 0
    with shuffles_end_with_queries(spark):
        # a copy for each drop, so that the joins of one only are in shuffle files at a time
        for drop in [materialise(sources.where(part), "refresh-input", compression="zstd") for part in (even, ~even)]:
            files.write_csv(fixtures.variant_texts(drop).select(*cols), landing, mode="append", rows_per_gzip=DROP_ROWS)    # a drop (S7)
            refresh(spark, landing, table, ckpt, schema, typed, multi_line=True, state=state)  # S8: reads that drop only (body_html has line breaks)
    return table


def q_incremental_refresh(spark, sf):
    return spark.read.parquet(_refreshed(spark, sf)).select("variant_id", "product_id", "supplier_key", "store_domain", "vendor",
                                                            "price", "available")


def q_incremental_kpis(spark, sf):
    """KPIs per store after two drops, from the state that each refresh adds for its new rows."""
    state = scratch_path(spark, "kpi-state")
    _refreshed(spark, sf, lambda rows, number: kpi_state.add(rows, state, number))
    return kpi_state.read(spark, state)


def write_long_csv(rows, path: str) -> None:
    """CSV files of many splits each: a task writes ``TASKS_PER_FILE`` parts of a written copy one after the other.

    ``coalesce`` on the rows themselves would run the joins above them in the writing task too, with the memory of all their parts.
    """
    copy = materialise(rows, "multiline-input")
    files.write_csv(copy.coalesce(max(1, copy.rdd.getNumPartitions() // TASKS_PER_FILE)), path)


def q_csv_multiline(spark, sf):
    """Fields with line breaks and quotes, from long CSV files that are read in splits."""
    path = scratch_path(spark, "multiline-csv")
    cols = ["variant_id", "supplier_key", "title", "body_html", "price"]
    write_long_csv(fixtures.variants_raw(spark, sf).select(*cols), path)
    back = quoted_csv.read(spark, path, files.string_schema(cols))
    return back.select(F.col("variant_id").cast("bigint").alias("variant_id"), F.col("supplier_key").cast("bigint").alias("supplier_key"), "title",
                       "body_html", "price")


QUERIES = {
    "q_csv_roundtrip": q_csv_roundtrip,
    "q_csv_positional": q_csv_positional,
    "q_incremental_refresh": q_incremental_refresh,
    "q_incremental_kpis": q_incremental_kpis,
    "q_csv_multiline": q_csv_multiline,
}

_NA_COLS = ", ".join(f"{S.na(c)} AS {c}" for c in files.LISTING_COLUMNS if c != "page_number")

ORACLE = {
    "q_csv_roundtrip": S.with_ctes(S.LISTINGS_RAW, f"""
SELECT row_seq, CAST(page_number AS VARCHAR) AS page_number, {_NA_COLS} FROM listings_raw"""),
    "q_csv_positional": S.with_ctes(S.LISTINGS_C, """
SELECT row_seq, "Title", "Price_MAD", "Rating", "Sales_Num" FROM grid"""),
    "q_incremental_refresh": "WITH " + VARIANTS.strip() + """
SELECT variant_id, product_id, supplier_key, store_domain, vendor, price, available FROM vclean""",
    "q_incremental_kpis": "WITH " + VARIANTS.strip() + """
SELECT store_domain, count(*) AS variants, count(*) FILTER (WHERE available) AS available_variants,
  count(*) FILTER (WHERE available IS DISTINCT FROM true) AS unavailable_variants, count(DISTINCT product_id) AS unique_products,
  count(DISTINCT vendor) AS vendors, count(DISTINCT product_type) AS product_types, round(avg(price), 6) AS avg_price,
  min(price) AS min_price, max(price) AS max_price FROM vclean GROUP BY store_domain""",
    "q_csv_multiline": "WITH " + VARIANTS.strip() + """
SELECT variant_id, supplier_key, title, '<p>' || title || '</p>' || chr(10) || '<p>"' || product_type || '"</p>' AS body_html, price FROM variants_raw""",
}
