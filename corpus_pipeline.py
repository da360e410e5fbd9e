"""A training corpus from raw documents: filter, deduplicate, mask, mix, pack.

Every stage takes all rows that the one before it kept, and is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.llm.jaccard import jaccard_components
from trovescan.llm.mixing import mix
from trovescan.llm.packing import pack
from trovescan.llm.pii import find_personal_data, mask
from trovescan.llm.quality import keep_good, trusted_ids
from trovescan.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity of trusted text does not reject. Null and empty texts go."""
    return keep_good(docs, trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a similarity of 0.8 on five-word shingles connects: the smallest id.

    Documents without words are no group and all stay; so do those with a null id. Rows that share an id
    are reduced to one only if they are wholly equal.
    """
    groups = jaccard_components(docs, size=5, percent=80)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates().select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by their kinds in brackets, and n_chars anew."""
    found = find_personal_data(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("at"), "version", "spans")
    found = found.dropDuplicates(["at", "version"]).alias("found")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("key"), F.xxhash64(text).alias("digest"))
    joined = rows.join(found, F.col("key").eqNullSafe(F.col("at")) & (F.col("digest") == F.col("version")), "left")
    masked = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(mask(F.col("row.text"), F.col("spans")))
    changed = joined.select("row", masked.alias("masked"))
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return changed.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it whole, up to twice."""
    whole = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))
    taken = mix(whole, keep=["row"]).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its ids and its place in a sequence."""
    return pack(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]

#: SQL has neither the model nor the tokenizer. tests/llm hold the operators against plain versions, and the stages against planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
