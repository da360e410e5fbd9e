"""The library's tables as views of the given test tables.

Each view is a list of SQL expressions over one given table (or one join), so
that the same text serves Spark and the SQL check. Queries are all vectors of
``embeddings``; the document of a vector is the one with its number; judgements
come from ``lineitem``, whose supplier and part numbers name query and document.
The pairings are artificial: they exercise the arithmetic, not the relevance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.operators.ids import MAX_BROADCAST_KEYS
from trovescan.operators.search import knn_exact, top_hits

TITLE = "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE split_part(text, chr(10), 1) END"
DOCS = [
    "CAST(doc_id AS STRING) AS doc_id",
    f"{TITLE} AS title",
    "text",
    "CASE WHEN doc_id % 10 = 0 THEN NULL ELSE CAST(2000 + doc_id % 25 AS INT) END AS year",
]
META = [
    "doc_id AS faiss_id",
    "CAST(doc_id AS STRING) AS doc_id",
    f"coalesce({TITLE}, '') AS title",
    "CASE WHEN doc_id % 10 = 0 THEN 0 ELSE CAST(2000 + doc_id % 25 AS INT) END AS year",
]
QUERIES = ["CAST(vec_id AS STRING) AS query_id", "text"]
QRELS = [
    "CAST(l_suppkey AS STRING) AS query_id",
    "CAST(l_partkey AS STRING) AS doc_id",
    "CAST(floor(l_quantity / 18) AS INT) AS relevance",
    "'0' AS iteration",
]
# Two runs over all queries, whose answers differ by a shift; every seventh answer is missing.
RUNS = [
    [f"'{run}' AS run_id", f"'{model}' AS model", "CAST(vec_id AS STRING) AS query_id", f"vec_id + {shift} AS answer"]
    for run, model, shift in (("run-1", "openai/gpt-5", 0), ("run-2", "model-a", 5))
]
ANSWERED = "answer % 7 <> 6"
RESPONSES = [
    "run_id",
    "model",
    "query_id",
    """CASE WHEN answer % 20 = 19 THEN NULL ELSE CASE answer % 13
         WHEN 0 THEN '{"index": 0}' WHEN 1 THEN '{"index": 3}' WHEN 2 THEN '{"index": null}'
         WHEN 3 THEN 'not json' WHEN 4 THEN '{"index": 99}' WHEN 5 THEN '{"index": "2"}'
         WHEN 6 THEN '{"index": 2.7}' WHEN 7 THEN '{"index": true}' WHEN 8 THEN '{"index": -1}'
         WHEN 9 THEN '{}' WHEN 10 THEN '[1]' WHEN 11 THEN '{"index": 3} x' ELSE '' END
       END AS response_text""",
    "CAST(100 + answer % 1000 AS INT) AS prompt_tokens",
    "CASE WHEN answer % 5 = 0 THEN CAST(NULL AS INT) ELSE 7 END AS reasoning_tokens",
    "CAST(12 AS INT) AS completion_tokens",
    "CAST(answer AS DOUBLE) AS latency_ms",
    "CASE WHEN answer % 20 = 19 THEN 'timed out' ELSE CAST(NULL AS STRING) END AS request_error",
]
PAGES = [
    "CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS STRING) WHEN page_id % 3 = 1 THEN '' ELSE NULL END AS id",
    "CASE WHEN page_id % 2 = 0 THEN concat('p', CAST(page_id AS STRING)) ELSE NULL END AS pageid",
    "regexp_extract(html, '<title>([^<]*)</title>', 1) AS title",
    "html AS text",
    "CASE WHEN page_id % 5 = 0 THEN NULL ELSE url END AS url",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(*DOCS)


def pages_of_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in the form of pages."""
    return docs(spark, sf_dir).select(
        F.col("doc_id").alias("id"), "title", "text", F.lit("").alias("url")
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").selectExpr(*META)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id")
    texts = read(spark, sf_dir, "documents").select("doc_id", "text")
    if vectors.count() <= MAX_BROADCAST_KEYS:  # else the texts of all documents are shuffled
        texts = texts.join(F.broadcast(vectors.select(F.col("vec_id").alias("doc_id")).distinct()), "doc_id", "left_semi")
    return vectors.join(texts, vectors["vec_id"] == texts["doc_id"], "left").selectExpr(*QUERIES)


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*QRELS)


def queries_as_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries with their ids as the files have them, for a filter that the scan should see."""
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"))
    texts = read(spark, sf_dir, "documents").select("doc_id", "text")
    return vectors.join(texts, vectors["query_id"] == texts["doc_id"], "left").select("query_id", "text")


def qrels_as_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = read(spark, sf_dir, "lineitem")
    return judged.selectExpr("l_suppkey AS query_id", "l_partkey AS doc_id", QRELS[2])


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of two runs, each over all queries."""
    asked = read(spark, sf_dir, "embeddings")
    first, second = (asked.selectExpr(*run) for run in RUNS)
    return first.union(second)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).where(ANSWERED).selectExpr(*RESPONSES)


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").selectExpr(*PAGES)


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("query_id"), "embedding"
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("faiss_id"), "embedding")


def without_self(hits: DataFrame, k: int) -> DataFrame:
    """Every query is itself a stored vector: take it out of its own hits."""
    others = hits.where(F.col("query_id") != F.col("faiss_id").cast("string"))
    return top_hits(others.drop("rank"), k)


def hits(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """The k nearest other vectors of every vector, with their document ids."""
    found = knn_exact(query_vectors(spark, sf_dir), vectors(spark, sf_dir), k + 1)
    return without_self(found, k).withColumn("doc_id", F.col("faiss_id").cast("string"))


# --- the same in SQL, as WITH clauses ---------------------------------------


def _select(columns: list[str], source: str) -> str:
    return f"SELECT {', '.join(columns)} FROM {source}"


SQL_VIEWS = {
    "docs": _select(DOCS, "documents"),
    "meta": _select(META, "documents"),
    "queries": _select(QUERIES, "embeddings LEFT JOIN documents ON vec_id = doc_id"),
    "qrels": _select(QRELS, "lineitem"),
    "requests": " UNION ALL ".join(_select(run, "embeddings") for run in RUNS),
    "responses": _select(RESPONSES, "requests") + f" WHERE {ANSWERED}",
    "raw_pages": _select(PAGES, "pages"),
    # Summed one dimension after another, as the library does.
    "pairs": """
        SELECT q.vec_id AS qid, v.vec_id AS faiss_id, list_reduce(list_transform(
                 list_zip(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])),
                 lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda a, b: a + b) AS score
        FROM embeddings q, embeddings v WHERE q.vec_id <> v.vec_id""",
    "ranked": """
        SELECT CAST(qid AS STRING) AS query_id, faiss_id, CAST(faiss_id AS STRING) AS doc_id, score,
               CAST(row_number() OVER (PARTITION BY qid ORDER BY score, faiss_id) AS INT) AS rank
        FROM pairs""",
    "hits": "SELECT * FROM ranked WHERE rank <= 10",
    "words": r"""
        SELECT doc_id, title, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w
        FROM docs""",
    "chunks": """
        SELECT doc_id, title, CAST(i AS INT) AS chunk_no,
               array_to_string(list_slice(w, i * 160 + 1, i * 160 + 240), ' ') AS text
        FROM (SELECT *, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 240 THEN 1
                ELSE CAST(ceil((len(w) - 240) / 160.0) AS BIGINT) + 1 END)) AS i FROM words)""",
    "numbered": """
        SELECT row_number() OVER (ORDER BY doc_id, chunk_no) AS faiss_id, doc_id, title,
               '' AS url, text, chunk_no
        FROM chunks""",
    "sharded": """
        SELECT *, printf('shard_%04d', (faiss_id - 1) // 1000 + 1) AS shard FROM numbered""",
    "qrels_unique": """
        SELECT query_id, doc_id, max(relevance) AS relevance FROM qrels GROUP BY query_id, doc_id""",
    "judged": """
        SELECT h.query_id, h.doc_id, h.faiss_id, h.score, h.rank, coalesce(r.relevance, 0) AS relevance
        FROM hits h LEFT JOIN qrels_unique r ON h.query_id = r.query_id AND h.doc_id = r.doc_id""",
    "doc_texts": r"""
        SELECT doc_id, trim(concat(coalesce(title, ''), chr(10), chr(10), coalesce(text, '')),
                            concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS full_text
        FROM docs""",
}


def with_views(names: str, query: str) -> str:
    """``query`` after WITH clauses for the views named (in order of dependence)."""
    clauses = ", ".join(f"{name} AS ({SQL_VIEWS[name]})" for name in names.split())
    return f"WITH {clauses} {query}"
