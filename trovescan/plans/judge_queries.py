"""Registered queries: judgements, metrics, picking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.operators import hits as hits_of
from trovescan.operators import metrics
from trovescan.plans import views
from trovescan.plans.registry import query

_JUDGED = "qrels qrels_unique pairs ranked hits judged"
_NDCG = """
    , placed AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS best FROM judged),
    gains AS (
      SELECT query_id, sum((2 ** relevance - 1) / log2(rank + 1)) AS dcg,
             sum((2 ** relevance - 1) / log2(best + 1)) AS idcg,
             count(*) FILTER (relevance > 0) AS relevant
      FROM placed GROUP BY query_id),
    totals AS (
      SELECT query_id, count(*) FILTER (relevance > 0) AS total FROM qrels_unique GROUP BY query_id),
    asked AS (SELECT CAST(vec_id AS STRING) AS query_id FROM embeddings)"""


@query("qrels qrels_unique", "SELECT query_id, doc_id, relevance FROM qrels_unique")
def qrels_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of.qrels_unique(views.qrels(spark, sf_dir))


@query("qrels", "SELECT doc_id, relevance FROM qrels WHERE query_id = '7'")
def qrels_of_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits_of.qrels_of_query(views.qrels_as_stored(spark, sf_dir), 7)
    return found.withColumn("doc_id", F.col("doc_id").cast("string"))


@query("queries", "SELECT query_id, text FROM queries WHERE query_id = '7'")
def query_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits_of.query_by_id(views.queries_as_stored(spark, sf_dir), 7)
    return found.withColumn("query_id", F.col("query_id").cast("string"))


@query("queries", "SELECT query_id, text FROM queries ORDER BY query_id LIMIT 1 OFFSET 42")
def query_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of.query_by_offset(views.queries(spark, sf_dir), 42)


@query("queries", "SELECT query_id, text FROM queries ORDER BY query_id LIMIT 20")
def sample_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of.sample_queries(views.queries(spark, sf_dir), 20)


@query(
    _JUDGED,
    _NDCG
    + """
    SELECT a.query_id, CAST(coalesce(relevant, 0) AS INT) AS relevant, coalesce(total, 0) AS total_relevant,
           round(coalesce(relevant, 0) / 10.0::DOUBLE, 4) AS precision,
           round(coalesce(relevant, 0) / CAST(greatest(coalesce(total, 0), 1) AS DOUBLE), 4) AS recall,
           round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 4) AS ndcg
    FROM asked a LEFT JOIN gains g ON a.query_id = g.query_id LEFT JOIN totals t ON a.query_id = t.query_id""",
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and NDCG of every query, from its ten nearest."""
    return metrics.retrieval_metrics(
        views.hits(spark, sf_dir), views.qrels(spark, sf_dir),
        views.query_vectors(spark, sf_dir), 10,
    )


@query(
    _JUDGED,
    _NDCG
    + """
    SELECT a.query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg
    FROM asked a LEFT JOIN gains g ON a.query_id = g.query_id""",
)
def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.ndcg(
        views.hits(spark, sf_dir), views.qrels(spark, sf_dir),
        views.query_vectors(spark, sf_dir), 10,
    )
    return found.withColumn("ndcg", F.round("ndcg", 6))


@query(
    "meta pairs ranked hits",
    """
    , found AS (
      SELECT query_id, score, title, sum(score) OVER (PARTITION BY query_id) + 1e-9 AS total
      FROM hits JOIN meta USING (faiss_id)),
    stats AS (
      SELECT query_id, avg(score) AS mean, stddev_pop(score) AS std,
             -sum(score / total * ln(score / total + 1e-12)) AS entropy, count(DISTINCT title) AS titles
      FROM found GROUP BY query_id)
    SELECT CAST(vec_id AS STRING) AS query_id, round(coalesce(mean, 0), 6) AS score_mean,
           round(coalesce(std, 0), 6) AS score_std, round(coalesce(entropy, 0), 6) AS score_entropy,
           CAST(coalesce(titles, 0) AS INT) AS unique_titles
    FROM embeddings LEFT JOIN stats ON query_id = CAST(vec_id AS STRING)""",
)
def hit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits_of.hits_meta(
        views.hits(spark, sf_dir).drop("doc_id"), views.meta(spark, sf_dir)
    )
    stats = metrics.hit_stats(found, views.query_vectors(spark, sf_dir))
    rounded = [F.round(c, 6).alias(c) for c in ("score_mean", "score_std", "score_entropy")]
    return stats.select("query_id", *rounded, "unique_titles")
