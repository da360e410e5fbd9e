"""Raw pages: JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.schemas import PAGES, PAGES_RAW


def read_pages(spark: SparkSession, path: str, schema: str = PAGES) -> DataFrame:
    """Read JSON lines with a declared schema. A missing field and null are the same."""
    return spark.read.schema(schema).json(path)


def read_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_pages(spark, path, PAGES_RAW)


def normalize_pages(raw: DataFrame) -> DataFrame:
    """Settle the id (id, else pageid, else title) and default the url to ''."""
    page_id = F.coalesce(
        F.nullif("id", F.lit("")), F.nullif("pageid", F.lit("")), F.col("title")
    )
    return raw.select(
        page_id.alias("id"), "title", "text", F.coalesce("url", F.lit("")).alias("url")
    )


def write_pages(pages: DataFrame, path: str, mode: str = "error") -> None:
    """Write JSON lines with all fields, null or not."""
    pages.write.mode(mode).option("ignoreNullFields", "false").json(path)
