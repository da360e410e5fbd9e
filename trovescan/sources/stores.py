"""Stored vectors, metadata, manifests and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trovescan.schemas import DOC_META, MANIFEST, PRICES, RESULTS, VECTORS, columns
from trovescan.sources.tables import conform


def write_vectors(vectors: DataFrame, path: str, mode: str = "error") -> None:
    """Store (faiss_id, shard, embedding), one folder per shard."""
    conform(vectors, VECTORS).write.mode(mode).partitionBy("shard").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """All shards; a filter on ``shard`` reads only its folder."""
    return spark.read.schema(VECTORS).parquet(path)


def write_meta(meta: DataFrame, path: str, mode: str = "error") -> None:
    meta.write.mode(mode).parquet(path)


def read_meta(spark: SparkSession, path: str, schema: str = DOC_META) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_manifest(shards: DataFrame, path: str) -> None:
    """Add the rows of new shards, in one file, so that a run's shards appear together or not at all."""
    conform(shards, MANIFEST).coalesce(1).write.mode("append").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each shard of the index; none when there is no index."""
    try:
        return spark.read.schema(MANIFEST).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def append_results(results: DataFrame, path: str) -> None:
    """Add result rows, by column name, one folder per run."""
    conform(results, RESULTS).write.mode("append").partitionBy("run_id").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULTS).parquet(path).select(*columns(RESULTS))


# The price list, per million tokens in and out.
_PRICES = [
    ("cheap", "openai/gpt-oss-120b:exact", 0.04, 0.40),
    ("mid", "grok/grok-4-fast", 0.20, 0.50),
    ("strong", "openai/gpt-5", 1.25, 10.00),
]


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_PRICES, PRICES)
