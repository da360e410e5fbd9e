"""Registered queries: nearest neighbours, their metadata, texts and reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.operators import hits as hits_of
from trovescan.operators import rerank
from trovescan.operators import search
from trovescan.operators.embed import hash_embed
from trovescan.plans import views
from trovescan.plans.registry import query
from trovescan.plans.views import read
from trovescan.session import materialize, scratch_path

_HITS = "SELECT query_id, faiss_id, rank, round(score, 6) AS score FROM hits"


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "faiss_id", "rank", F.round("score", 6).alias("score"))


@query("pairs ranked hits", _HITS)
def knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest others of every vector; the queries are broadcast if they fit."""
    return _shown(views.hits(spark, sf_dir))


@query("pairs ranked hits", _HITS)
def knn_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from tiles of both sides, the form for queries too large to broadcast."""
    found = search.knn_exact(
        views.query_vectors(spark, sf_dir), views.vectors(spark, sf_dir), 11,
        max_broadcast_bytes=0, tile_bytes=256 << 10,
    )
    return _shown(views.without_self(found, 10))


_stored: dict[tuple[str, str, str], str] = {}


def _index_path(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Where this session keeps its index of these vectors; it is written on first use."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = scratch_path(spark, name)
        write(views.vectors(spark, sf_dir), path)
        _stored[key] = path
    return _stored[key]


def _clusters(spark: SparkSession, sf_dir: str) -> search.Clusters:
    write = lambda vectors, path: search.write_clusters(vectors, path, cells=16)
    return search.read_clusters(spark, _index_path(spark, sf_dir, "clusters", write))


def _hashed(spark: SparkSession, sf_dir: str) -> search.Hashed:
    write = lambda vectors, path: search.write_hashed(vectors, path, dim=64, width=0.25)
    return search.read_hashed(spark, _index_path(spark, sf_dir, "hashed", write))


@query("pairs ranked hits", _HITS)
def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through stored clusters: the nearest four first, then all within reach."""
    found = search.knn_clusters(views.query_vectors(spark, sf_dir), _clusters(spark, sf_dir), 11, probes=4)
    return _shown(views.without_self(found, 10))


@query("pairs ranked hits", _HITS)
def knn_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through an index of every third vector, to which the others are added in two runs."""
    path, held = scratch_path(spark, "grown"), views.vectors(spark, sf_dir)
    search.write_clusters(held.where("faiss_id % 3 = 0"), path, cells=8)
    for rest in (1, 2):
        search.append_clusters(held.where(f"faiss_id % 3 = {rest}"), path)
    found = search.knn_clusters(views.query_vectors(spark, sf_dir), search.read_clusters(spark, path), 11, probes=2)
    return _shown(views.without_self(found, 10))


@query("pairs ranked hits", _HITS)
def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through stored hash tables: shared buckets first, then all within reach."""
    found = search.knn_hashed(views.query_vectors(spark, sf_dir), _hashed(spark, sf_dir), 11)
    return _shown(views.without_self(found, 10))


def _shares(recalls: DataFrame, compared: DataFrame, rows: int) -> DataFrame:
    return recalls.join(compared, "query_id").withColumn("share", F.col("compared") / F.lit(rows))


@query(
    "",
    """
    SELECT CAST(vec_id AS STRING) AS query_id, least(10, n) AS wanted, least(10, n) AS found,
           CAST(1 AS DOUBLE) AS recall, n AS compared, CAST(1 AS DOUBLE) AS share
    FROM embeddings, (SELECT count(*) AS n FROM embeddings)""",
)
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and share of pairs compared when every cluster is probed and nothing is completed."""
    asked, held = views.query_vectors(spark, sf_dir), views.vectors(spark, sf_dir)
    index = _clusters(spark, sf_dir)
    found = search.knn_clusters(asked, index, 10, probes=16, complete=False)
    recalls = search.recall(found, search.knn_exact(asked, held, 10))
    return _shares(recalls, search.compared_in_clusters(asked, index, 16), held.count())


@query()
def ann_recall_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for four clusters, and for the hash tables; how much these find is up to the data."""
    asked, held = views.query_vectors(spark, sf_dir), views.vectors(spark, sf_dir)
    rows, exact = held.count(), materialize(search.knn_exact(asked, held, 10), "exact")
    clusters, hashed = _clusters(spark, sf_dir), _hashed(spark, sf_dir)
    near = search.recall(search.knn_clusters(asked, clusters, 10, probes=4, complete=False), exact)
    shared = search.recall(search.knn_hashed(asked, hashed, 10, complete=False), exact)
    return (
        _shares(near, search.compared_in_clusters(asked, clusters, 4), rows)
        .withColumn("method", F.lit("clusters"))
        .unionByName(
            _shares(shared, search.compared_in_tables(asked, hashed), rows).withColumn("method", F.lit("hashed"))
        )
    )


@query(
    "docs words",
    """
    , counts AS (
      SELECT doc_id, bucket, count(*) AS n
      FROM (SELECT doc_id, CAST(concat('0x', left(md5(word), 6)) AS BIGINT) % 64 AS bucket
            FROM (SELECT doc_id, unnest(w) AS word FROM words
                  UNION ALL SELECT concat('b', item_id),
                    unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) FROM benchmark))
      GROUP BY doc_id, bucket),
    dense AS (
      SELECT doc_id, list(CAST(coalesce(n, 0) AS DOUBLE) ORDER BY bucket) AS n, sqrt(sum(n * n)) AS norm
      FROM (SELECT doc_id, unnest(range(64)) AS bucket FROM (SELECT DISTINCT doc_id FROM counts))
      LEFT JOIN counts USING (doc_id, bucket) GROUP BY doc_id),
    unit AS (
      SELECT doc_id, CAST(list_transform(n, lambda x: CAST(x / norm AS FLOAT)) AS DOUBLE[]) AS v FROM dense),
    ranked AS (
      SELECT q.doc_id AS query_id, d.doc_id, list_reduce(list_transform(list_zip(q.v, d.v),
               lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b) AS score,
             CAST(row_number() OVER (PARTITION BY q.doc_id ORDER BY score, CAST(d.doc_id AS BIGINT)) AS INT) AS rank
      FROM unit q JOIN unit d ON q.doc_id LIKE 'b%' AND d.doc_id NOT LIKE 'b%')
    SELECT query_id, r.doc_id, title, rank, round(score, 6) AS score
    FROM ranked r JOIN docs USING (doc_id) WHERE rank <= 8""",
)
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From texts to hits: the eight documents nearest to every benchmark passage."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("faiss_id"), "text")
    vector = F.col("embedding").cast("array<float>").alias("embedding")
    held = materialize(hash_embed(docs).select("faiss_id", vector), "text-vectors")
    asked = hash_embed(read(spark, sf_dir, "benchmark")).select(
        F.concat(F.lit("b"), F.col("item_id")).alias("query_id"), vector
    )
    named = views.docs(spark, sf_dir).select(
        F.col("doc_id").cast("bigint").alias("faiss_id"), "doc_id", "title"
    )
    found = hits_of.hits_meta(search.knn_exact(asked, held, 8), named)
    return found.select("query_id", "doc_id", "title", "rank", F.round("score", 6).alias("score"))


# --- joins with hits ---------------------------------------------------------


@query("pairs ranked hits", "SELECT query_id, faiss_id, rank FROM ranked WHERE rank <= 3")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits_of.top_k(views.hits(spark, sf_dir), 3).select("query_id", "faiss_id", "rank")


@query(
    "meta pairs ranked hits",
    """
    SELECT query_id, rank, faiss_id, m.doc_id, title, year FROM hits JOIN meta m USING (faiss_id)""",
)
def hits_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = views.hits(spark, sf_dir).drop("doc_id")
    joined = hits_of.hits_meta(found, views.meta(spark, sf_dir))
    return joined.select("query_id", "rank", "faiss_id", "doc_id", "title", "year")


@query(
    "qrels qrels_unique pairs ranked hits judged",
    "SELECT query_id, doc_id, rank, relevance FROM judged",
)
def judge_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = hits_of.judge_hits(views.hits(spark, sf_dir), views.qrels(spark, sf_dir))
    return judged.select("query_id", "doc_id", "rank", "relevance")


_SNIPPET = """CASE WHEN length(full_text) > 220 THEN concat(left(full_text, 220), '…')
              ELSE full_text END"""


@query(
    "docs pairs ranked hits doc_texts",
    f"""
    SELECT query_id, doc_id, rank, CAST(length(coalesce(full_text, '')) AS INT) AS length,
           coalesce({_SNIPPET}, '') AS snippet
    FROM hits LEFT JOIN doc_texts USING (doc_id)""",
)
def hits_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for the ten hits of every vector."""
    found = hits_of.hits_text(views.hits(spark, sf_dir), views.docs(spark, sf_dir))
    return found.select("query_id", "doc_id", "rank", F.length("full_text").alias("length"), "snippet")


@query(
    "docs pairs ranked hits doc_texts",
    f"""
    SELECT doc_id, {_SNIPPET} AS text FROM doc_texts WHERE doc_id IN (SELECT doc_id FROM hits)""",
)
def fetch_doc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of all documents that occur among the hits."""
    return hits_of.fetch_doc_texts(
        views.docs(spark, sf_dir), views.hits(spark, sf_dir), snippet_len=220
    )


# --- reranking ---------------------------------------------------------------


def _pairs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The fifty candidates of every query with both texts, some queries at a time."""
    near = materialize(views.hits(spark, sf_dir, hits_of.search_depth(10, rerank=True)), "candidates", release=True)
    asked = views.queries(spark, sf_dir).select("query_id", F.col("text").alias("query_text"))
    attach = lambda listed: hits_of.hits_text(listed, views.docs(spark, sf_dir)).drop("snippet")
    return rerank.pair_rounds(near, asked, attach)


@query(
    "docs queries pairs ranked doc_texts",
    r"""
    , asked AS (
      SELECT query_id, list_distinct(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS qw
      FROM queries),
    held AS (
      SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(full_text, '\s+'), lambda x: x <> '')) AS dw
      FROM doc_texts),
    scored AS (
      SELECT query_id, faiss_id, score, CASE WHEN len(qw) > 0
               THEN CAST(len(list_intersect(qw, coalesce(dw, []))) AS DOUBLE) / len(qw) ELSE 0 END AS rerank_score
      FROM ranked JOIN asked USING (query_id) LEFT JOIN held USING (doc_id) WHERE rank <= 50)
    SELECT * FROM (
      SELECT query_id, faiss_id, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score,
             CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, faiss_id) AS INT) AS rank
      FROM scored) WHERE rank <= 10""",
)
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = hits_of.search_depth(10, rerank=True)
    best = rerank.rerank_lexical(
        views.hits(spark, sf_dir, depth), views.queries(spark, sf_dir), views.docs(spark, sf_dir), 10
    )
    return best.select(
        "query_id", "faiss_id", "rank", F.round("score", 6).alias("score"),
        F.round("rerank_score", 6).alias("rerank_score"),
    )


def length_scorer():
    """A user's scorer for the checks: long texts, less for long queries."""
    return lambda pairs: [len(text) - 3 * len(asked) for asked, text in pairs]


@query(
    "docs queries pairs ranked doc_texts",
    """
    SELECT * FROM (
      SELECT query_id, faiss_id, CAST(length(coalesce(full_text, '')) - 3 * length(coalesce(text, '')) AS DOUBLE) AS rerank_score,
             CAST(row_number() OVER (PARTITION BY query_id ORDER BY length(coalesce(full_text, '')) DESC, faiss_id) AS INT) AS rank
      FROM ranked JOIN queries USING (query_id) LEFT JOIN doc_texts USING (doc_id) WHERE rank <= 50)
    WHERE rank <= 10""",
)
def rerank_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranking by a user's scorer, in Arrow batches."""
    best = rerank.rerank_with(_pairs(spark, sf_dir), length_scorer, 10, keep=["query_id", "faiss_id", "rank"])
    return best.select("query_id", "faiss_id", "rank", "rerank_score")
