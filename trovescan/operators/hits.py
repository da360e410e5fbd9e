"""Joining ranked hits with metadata, judgements and texts; picking from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.functions.text import doc_text, snippet
from trovescan.operators.ids import MAX_BROADCAST_KEYS, attach_ids
from trovescan.session import materialize

#: So many rows may be sorted in one task.
FEW_ROWS = 10_000
CANDIDATES = 50  # reranking looks at no fewer candidates per query, unless told so


def search_depth(k: int, rerank: bool = False) -> int:
    """How many neighbours to ask for."""
    return max(k, CANDIDATES) if rerank else k


def rerank_depth(k: int, candidates: int | None) -> int:
    """How many candidates are reranked: as many as asked for, but never fewer than ``k``."""
    if candidates is not None and candidates < k:
        raise ValueError(f"{candidates} candidates cannot give {k} hits")
    return candidates or search_depth(k, rerank=True)


def hits_meta(hits: DataFrame, meta: DataFrame) -> DataFrame:
    """Attach metadata by id; hits without metadata are dropped."""
    return hits.join(meta, "faiss_id")


def qrels_unique(qrels: DataFrame) -> DataFrame:
    """One relevance per (query, document); repeats keep the highest."""
    return qrels.groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))


def judge_hits(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Attach the relevance of each hit, 0 where it was not judged.

    Judgements are collapsed on the join key first; the join needs no further
    shuffle of them, and a query or document that fills the table is spread
    over its pairs.
    """
    return judge_by(hits, qrels_unique(qrels))


def judge_by(hits: DataFrame, unique: DataFrame) -> DataFrame:
    """``judge_hits`` by judgements that are collapsed already."""
    judged = hits.join(unique, ["query_id", "doc_id"], "left")
    return judged.withColumn("relevance", F.coalesce("relevance", F.lit(0)))


def qrels_of_query(qrels: DataFrame, query_id: str | int) -> DataFrame:
    """Judgements of one query, whose id is compared in the type it is stored in."""
    return qrels.where(F.col("query_id") == F.lit(query_id)).select("doc_id", "relevance")


def fetch_doc_texts(docs: DataFrame, ids: DataFrame, snippet_len: int = 0) -> DataFrame:
    """Texts of the documents whose ids are given; repeated ids count once."""
    text = doc_text(F.col("title"), F.col("text"))
    return (
        docs.select("doc_id", "title", "text")
        .join(ids.select("doc_id"), "doc_id", "left_semi")
        .select("doc_id", snippet(text, snippet_len).alias("text"))
    )


def listed_ids(ids: DataFrame, max_broadcast_keys: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """The different ``doc_id`` of a stored table, to be broadcast if they are few.

    Documents are then chosen by them where they lie, and no text is shuffled for it.
    """
    ids = ids.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    return F.broadcast(ids) if ids.count() <= max_broadcast_keys else ids


def hits_text(
    hits: DataFrame,
    docs: DataFrame,
    snippet_len: int = 220,
    candidates: int | None = None,
    full: bool = True,
) -> DataFrame:
    """Attach ``full_text`` (if ``full``) and ``snippet`` to the hits of each query.

    The hits are stored once; the documents are reduced to those that occur
    among them before any text travels, and without ``full`` only snippets do.
    Documents that are missing give ''. With ``candidates``, hits beyond so
    many of a query keep null.
    """
    hits = materialize(hits, "hits")
    wanted = F.lit(True) if candidates is None else F.col("rank") <= candidates
    texts = fetch_doc_texts(docs, listed_ids(hits.where(wanted)))
    texts = texts.select(
        F.col("doc_id").alias("_doc_id"),
        *([F.col("text").alias("full_text")] if full else []),
        snippet(F.col("text"), snippet_len).alias("snippet"),
    )
    joined = hits.join(texts, (F.col("doc_id") == F.col("_doc_id")) & wanted, "left").drop("_doc_id")
    filled = {c: F.when(wanted, F.coalesce(c, F.lit(""))) for c in texts.columns[1:]}
    return joined.withColumns(filled)


def top_k(hits: DataFrame, k: int) -> DataFrame:
    """The first k of the ranked hits of each query."""
    return hits.where(F.col("rank") <= k)


def _one(df: DataFrame, message: str) -> DataFrame:
    """The only row of ``df``; reading the result fails with the message if there is none."""
    row = df.agg(F.first(F.struct(*df.columns)).alias("row"))
    found = F.when(F.col("row").isNotNull(), F.col("row")).otherwise(F.raise_error(F.lit(message)))
    return row.select(found.alias("row")).select("row.*")


def query_by_id(queries: DataFrame, query_id: str | int) -> DataFrame:
    """The query with this id; fails if there is none.

    The id is compared in the type it is stored in, so that the comparison reaches the files.
    """
    found = queries.where(F.col("query_id") == F.lit(query_id)).select("query_id", "text")
    return _one(found, f"query_id {query_id} not found")


def query_by_offset(queries: DataFrame, offset: int, few: int = FEW_ROWS) -> DataFrame:
    """The query at this position in id order; fails beyond the end.

    Beyond ``few`` rows the ids are numbered, and the row is picked by its number.
    """
    texts = queries.select("query_id", "text")
    if offset < few:
        found = texts.orderBy("query_id").offset(offset).limit(1)
    else:
        found = attach_ids(texts, ["query_id"], 0).where(F.col("faiss_id") == offset).drop("faiss_id")
    return _one(found, f"query offset {offset} beyond the end")


def query_of_text(spark: SparkSession, text: str, query_id: str = "free text") -> DataFrame:
    """A free-form query; its id joins with its own hits and answers, but with no judgement."""
    return spark.createDataFrame([(query_id, text)], "query_id string, text string")


def sample_queries(queries: DataFrame, n: int | None = None, few: int = FEW_ROWS) -> DataFrame:
    """The first n queries in id order; all of them for None or 0.

    Up to ``few`` they are sorted in one task. More are picked by their numbers where they lie, and not sorted.
    """
    if not n:
        return queries
    if n <= few:
        return queries.orderBy("query_id").limit(n)
    return attach_ids(queries, ["query_id"], 0).where(F.col("faiss_id") < n).drop("faiss_id")
