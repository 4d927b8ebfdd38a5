"""File sources and sinks: listing / variant CSV, positional CSV, artefacts.

CSV is the interchange format of the original application; at scale the
landed data should be Parquet (pushdown, pruning), so every reader here can
be followed by ``write_table`` and later reads use Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed

LISTING_COLUMNS = ["page_number", "url", "name", "price", "original_price", "discount_percentage",
                   "rating", "sales_info", "image_url", "additional_badges"]
POSITIONAL_COLUMNS = ["Index", "URL", "Title", "Price_MAD", "Unknown1", "Unknown2",
                      "Rating", "Sales", "Image_URL", "Highlight"]


def string_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


def normalise_na(df: DataFrame, columns: list[str] | None = None,
                 tokens: list[str] | None = None) -> DataFrame:
    """Turn the NA tokens of a pandas CSV read into nulls (string columns)."""
    toks = tokens or fixed.NA_TOKENS
    cols = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(toks), F.col(c)) for c in cols})


def read_csv(spark: SparkSession, path: str, columns: list[str], header: bool = True,
             na_tokens: bool = True, multi_line: bool = False) -> DataFrame:
    """Read a CSV with an explicit all-text schema.

    ``header=False`` reads by position (S2): the header line stays a data row.
    ``multi_line`` is for files whose quoted fields hold line breaks (``body_html``);
    such a file can't be split, so it is off by default.
    """
    df = (spark.read.schema(string_schema(columns))
          .option("header", header).option("multiLine", multi_line).option("escape", '"')
          .option("mode", "PERMISSIVE").csv(path))
    return normalise_na(df, columns) if na_tokens else df


def ensure_columns(df: DataFrame, defaults: dict[str, str | tuple]) -> DataFrame:
    """S3: add absent columns as typed literals (schema check only, no job).

    ``defaults`` maps a column to a type name (null default) or to
    ``(type, value)``.
    """
    add = {}
    for c, spec in defaults.items():
        if c in df.columns:
            continue
        typ, val = (spec, None) if isinstance(spec, str) else spec
        add[c] = F.lit(val).cast(typ)
    return df.withColumns(add) if add else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", rows_per_gzip: int | None = None) -> None:
    """CSV with a header; ``mode='append'`` adds files, the header is per file.

    ``rows_per_gzip``: files are compressed, and have at most so many rows each, because a compressed file is read by one task.
    """
    w = df.write.mode(mode).option("header", True).option("escape", '"')
    if rows_per_gzip:
        w = w.options(**{"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": rows_per_gzip})
    w.csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Land a table as Parquet (optionally partitioned, e.g. by store)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
