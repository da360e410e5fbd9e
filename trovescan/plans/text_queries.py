"""Registered queries: text expressions, chunks, embedding, quantisation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.functions import text as text_of
from trovescan.functions import vectors as vector_of
from trovescan.operators import embed as embedding
from trovescan.operators.chunks import chunk_documents as chunk
from trovescan.operators.hits import qrels_unique
from trovescan.operators.ids import MAX_BROADCAST_KEYS
from trovescan.operators.quantize import sq8_vectors as quantize
from trovescan.plans import views
from trovescan.plans.registry import query
from trovescan.plans.views import read


@query("docs doc_texts", "SELECT doc_id, full_text AS text FROM doc_texts")
def doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of.doc_text(F.col("title"), F.col("text"))
    return views.docs(spark, sf_dir).select("doc_id", text.alias("text"))


@query(
    "docs doc_texts",
    """
    SELECT doc_id, CASE WHEN length(full_text) > 220 THEN concat(left(full_text, 220), '…')
                        ELSE full_text END AS snippet FROM doc_texts""",
)
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of.doc_text(F.col("title"), F.col("text"))
    return views.docs(spark, sf_dir).select("doc_id", text_of.snippet(text).alias("snippet"))


@query("docs words", "SELECT doc_id, CAST(len(w) AS INT) AS n, array_to_string(w, '|') AS words FROM words")
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = views.docs(spark, sf_dir).select("doc_id", text_of.words(F.col("text")).alias("w"))
    return split.select("doc_id", F.size("w").alias("n"), F.array_join("w", "|").alias("words"))


@query("docs words chunks", "SELECT doc_id, title, chunk_no, text FROM chunks")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk(views.docs(spark, sf_dir).select("doc_id", "title", "text"))


@query(
    "",
    """
    SELECT vec_id, CAST(pos AS INT) AS pos, round(value / sqrt(sum(value * value) OVER (PARTITION BY vec_id)), 6) AS value
    FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos,
                 unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id % 7 + 1))) AS value
          FROM embeddings)""",
)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, stretched by different factors, at unit length again."""
    factor = (F.col("vec_id") % 7 + 1).cast("double")
    stretched = F.transform("embedding", lambda x: x.cast("double") * factor)
    unit = vector_of.l2_normalize(stretched)
    return (
        read(spark, sf_dir, "embeddings")
        .select("vec_id", F.posexplode(unit).alias("pos", "value"))
        .withColumn("value", F.round("value", 6))
    )


@query(
    "qrels qrels_unique",
    """
    SELECT query_id, doc_id, round(list_sum(list_transform(
             list_zip(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])),
             lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS distance
    FROM qrels_unique JOIN embeddings q ON query_id = CAST(q.vec_id AS STRING)
    JOIN embeddings d ON doc_id = CAST(d.vec_id AS STRING)""",
)
def l2_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance between query and document of every judged pair that has vectors."""
    vectors = views.query_vectors(spark, sf_dir)
    asked = vectors.withColumnRenamed("embedding", "asked")
    held = vectors.select(F.col("query_id").alias("doc_id"), F.col("embedding").alias("held"))
    distance = vector_of.squared_distance(F.col("asked"), F.col("held"))
    # Pairs without vectors go before anything is grouped, by ids alone, so that no vector travels with them.
    judged = views.qrels(spark, sf_dir)
    for key in ("doc_id", "query_id"):
        known = vectors.select(F.col("query_id").alias(key))
        few = known.count() <= MAX_BROADCAST_KEYS
        judged = judged.join(F.broadcast(known) if few else known, key, "left_semi")
    return (
        qrels_unique(judged)
        .join(asked, "query_id")
        .join(held, "doc_id")
        .select("query_id", "doc_id", F.round(distance, 6).alias("distance"))
    )


@query(
    "docs words",
    """
    , counts AS (
      SELECT doc_id, bucket, count(*) AS n
      FROM (SELECT doc_id, CAST(concat('0x', left(md5(word), 6)) AS BIGINT) % 64 AS bucket
            FROM (SELECT doc_id, unnest(w) AS word FROM words))
      GROUP BY doc_id, bucket)
    SELECT doc_id, CAST(bucket AS INT) AS bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value
    FROM counts""",
)
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashed unit vector of every document, without its zeros."""
    docs = views.docs(spark, sf_dir).select("doc_id", "text")
    return (
        embedding.hash_embed(docs)
        .select("doc_id", F.posexplode_outer("embedding").alias("bucket", "value"))
        .where(F.col("value") > 0)
        .withColumn("value", F.round("value", 6))
    )


def letter_encoder():
    """A user's encoder for the checks: how often five letters occur."""
    return lambda texts: np.array([[t.count(letter) for letter in "aeinr"] for t in texts])


@query(
    "docs",
    """
    , counts AS (
      SELECT doc_id, list_transform(['a', 'e', 'i', 'n', 'r'],
               lambda c: CAST(length(text) - length(replace(text, c, '')) AS DOUBLE)) AS n FROM docs),
    norms AS (
      SELECT *, sqrt(list_sum(list_transform(n, lambda x: x * x))) AS norm FROM counts)
    SELECT doc_id, CAST(unnest(range(5)) AS INT) AS pos,
           round(CAST(CAST(unnest(list_transform(n, lambda x: CASE WHEN norm > 0 THEN x / norm ELSE 0 END)) AS FLOAT) AS DOUBLE), 6) AS value
    FROM norms""",
)
def embed_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors from a user's encoder, in Arrow batches."""
    docs = views.docs(spark, sf_dir).select("doc_id", "text")
    vectors = embedding.embed_with(docs, letter_encoder)
    return vectors.select("doc_id", F.posexplode_outer("embedding").alias("pos", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6)
    )


@query(
    "",
    """
    WITH flat AS (
      SELECT vec_id, unnest(range(len(embedding))) AS pos,
             unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
    ranged AS (
      SELECT *, min(x) OVER (PARTITION BY pos) AS low, max(x) OVER (PARTITION BY pos) AS high FROM flat),
    coded AS (
      SELECT *, CASE WHEN high > low THEN CAST(floor((x - low) / (high - low) * 255) AS INT) ELSE 0 END AS code
      FROM ranged)
    SELECT vec_id, array_to_string(list(code ORDER BY pos), ' ') AS codes,
           round(max(abs(x - (low + (code + 0.5::DOUBLE) / 255 * (high - low)))), 6) AS error
    FROM coded GROUP BY vec_id""",
)
def sq8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as 8-bit codes, with the largest error of each."""
    coded = quantize(read(spark, sf_dir, "embeddings"))
    codes = F.array_join(F.transform("codes", lambda c: c.cast("string")), " ")
    return coded.select("vec_id", codes.alias("codes"), F.round("error", 6).alias("error"))
