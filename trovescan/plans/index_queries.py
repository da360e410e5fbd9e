"""Registered queries over the stored chunk index, from building it to the requests made of its hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.functions.text import snippet, words
from trovescan.operators import selection
from trovescan.operators.embed import hash_embed
from trovescan.operators.hits import hits_meta
from trovescan.operators.rerank import rerank, word_share
from trovescan.operators.search import knn_exact
from trovescan.plans import views
from trovescan.plans.index_build import append_chunks, read_index, read_index_vectors
from trovescan.plans.registry import query
from trovescan.plans.views import read
from trovescan.session import materialize, scratch_path

_PROMPT = selection.PROMPT.replace("'", "''").split("{{ query }}")


def _embed(texts: DataFrame) -> DataFrame:
    return hash_embed(texts, "text", 64)


@query(
    "docs words chunks",
    rf"""
    , stored AS (
      SELECT row_number() OVER (ORDER BY CAST(doc_id AS BIGINT) NOT IN (SELECT doc_id FROM labels), doc_id, chunk_no) AS faiss_id,
             doc_id, coalesce(title, '') AS title, chunk_no, text FROM chunks),
    asked AS (SELECT concat('b', item_id) AS query_id, text FROM benchmark),
    texts AS (
      SELECT CAST(faiss_id AS VARCHAR) AS id, text FROM stored UNION ALL SELECT query_id, text FROM asked),
    split AS (SELECT id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM texts),
    counts AS (
      SELECT id, CAST(concat('0x', left(md5(word), 6)) AS BIGINT) % 64 AS bucket, count(*) AS n
      FROM (SELECT id, unnest(w) AS word FROM split) GROUP BY ALL),
    unit AS (
      SELECT id, list(CAST(CAST(coalesce(n, 0) / norm AS FLOAT) AS DOUBLE) ORDER BY bucket) AS v
      FROM (SELECT id, sqrt(sum(n * n)) AS norm, unnest(range(64)) AS bucket FROM counts GROUP BY id)
      LEFT JOIN counts USING (id, bucket) GROUP BY id),
    near AS (
      SELECT q.id AS query_id, CAST(d.id AS BIGINT) AS faiss_id, list_reduce(list_transform(list_zip(q.v, d.v),
               lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b) AS score,
             row_number() OVER (PARTITION BY q.id ORDER BY score, CAST(d.id AS BIGINT)) AS rank
      FROM unit q JOIN unit d ON q.id LIKE 'b%' AND d.id NOT LIKE 'b%'),
    better AS (
      SELECT query_id, faiss_id, row_number() OVER (PARTITION BY query_id ORDER BY
               CAST(len(list_intersect(list_distinct(q.w), list_distinct(d.w))) AS DOUBLE) / len(list_distinct(q.w)) DESC, faiss_id) AS place
      FROM near JOIN split q ON q.id = query_id JOIN split d ON d.id = CAST(faiss_id AS VARCHAR) WHERE rank <= 20),
    payloads AS (
      SELECT query_id, CAST(to_json(list({{'index': place - 1, 'title': left(title, 200), 'doc_id': doc_id,
               'snippet': CASE WHEN length(text) > 220 THEN concat(left(text, 220), '…') ELSE text END}} ORDER BY place)) AS STRING) AS documents_json
      FROM better JOIN stored USING (faiss_id) WHERE place <= 5 GROUP BY query_id)
    SELECT query_id, concat('{_PROMPT[0]}', text, '{_PROMPT[1].replace("{{ documents_json }}", "")}', coalesce(documents_json, '[]')) AS "user"
    FROM asked LEFT JOIN payloads USING (query_id)""",
)
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for every benchmark passage, from an index built in two runs.

    The labelled documents are indexed first, then all others are added. The twenty nearest chunks of
    a passage come from the stored vectors, their texts from the stored chunks; the five with the most of
    its words are shown.
    """
    path = scratch_path(spark, "index")
    documents = views.pages_of_docs(spark, sf_dir)
    labelled = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"))
    append_chunks(documents, path, _embed, "hash", 64, rows_per_shard=1000, only=labelled)
    append_chunks(documents, path, _embed, "hash", 64, rows_per_shard=1000)

    asked = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id")).alias("query_id"), "text")
    vector = F.col("embedding").cast("array<float>").alias("embedding")
    near = materialize(knn_exact(_embed(asked).select("query_id", vector), read_index_vectors(spark, path), 20), "near")
    chunks = read_index(spark, path).join(near.select("faiss_id").distinct(), "faiss_id", "left_semi")
    found = hits_meta(near, chunks.select("faiss_id", "doc_id", F.coalesce("title", F.lit("")).alias("title"), "text"))
    query_words = asked.select("query_id", F.array_distinct(words(F.col("text"))).alias("_asked"))
    share = word_share(F.col("_asked"), F.array_distinct(words(F.col("text"))))
    best = rerank(found.join(query_words, "query_id"), share, 5, candidates=20)
    shown = best.withColumn("snippet", snippet(F.col("text")))
    return selection.selection_requests(asked, shown, model="model-a", run_id="run-1").select("query_id", "user")
