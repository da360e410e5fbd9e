"""Registered queries: sources, sinks, loads, ids and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.operators.chunks import chunk_documents
from trovescan.operators.embed import hash_embed
from trovescan.operators.ids import (
    assign_ids as number,
    assign_shards as name_shards,
    index_state as state_of,
    index_totals as totals_of,
    manifest as describe,
    resume_chunks as not_indexed,
)
from trovescan.plans import views
from trovescan.plans.index_build import (
    append_chunks as append_to_index,
    document_index,
    number_chunks,
    read_index,
    read_index_vectors,
)
from trovescan.plans.registry import query
from trovescan.plans.views import read
from trovescan.session import scratch_path
from trovescan.sources import pages, stores, tables, versions

_NORMALIZED = """
    SELECT coalesce(nullif(id, ''), nullif(pageid, ''), title) AS id, title, text,
           coalesce(url, '') AS url
    FROM raw_pages"""


@query("raw_pages", "SELECT id, pageid, title, text, url FROM raw_pages")
def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages as JSON lines, read back with the declared schema."""
    path = scratch_path(spark, "raw-pages")
    pages.write_pages(views.raw_pages(spark, sf_dir), path)
    return pages.read_raw_pages(spark, path)


@query("raw_pages", _NORMALIZED)
def normalize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.normalize_pages(views.raw_pages(spark, sf_dir))


@query("raw_pages", _NORMALIZED)
def write_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised pages, written as JSON lines and read back."""
    path = scratch_path(spark, "pages")
    pages.write_pages(pages.normalize_pages(views.raw_pages(spark, sf_dir)), path)
    return pages.read_pages(spark, path)


def _doc_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of every labelled document, and one new document for each."""
    labels = read(spark, sf_dir, "labels")
    nothing = F.lit(None)
    first = labels.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("title"),
        nothing.cast("string").alias("text"),
        nothing.cast("int").alias("year"),
        F.lit(1).alias("seq"),
    )
    second = labels.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("toxic "), F.col("toxic").cast("string")).alias("title"),
        F.lit("relabelled").alias("text"),
        F.lit(2030).alias("year"),
        F.lit(2).alias("seq"),
    )
    new = labels.select(
        F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("doc_id"),
        nothing.cast("string").alias("title"),
        F.lit("new").alias("text"),
        nothing.cast("int").alias("year"),
        F.lit(3).alias("seq"),
    )
    return first.unionByName(second).unionByName(new)


@query(
    "docs",
    """
    SELECT d.doc_id, d.title, d.text, d.year, NULL::INT AS authors
    FROM docs d WHERE d.doc_id NOT IN (SELECT CAST(doc_id AS STRING) FROM labels)
    UNION ALL
    SELECT CAST(doc_id AS STRING), concat('toxic ', toxic), 'relabelled', 2030, 0 FROM labels
    UNION ALL SELECT concat('n', doc_id), '', 'new', 0, 0 FROM labels""",
)
def upsert_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tables.upsert_docs(views.docs(spark, sf_dir), _doc_load(spark, sf_dir))
    size = F.when(F.col("authors").isNotNull(), F.size("authors"))
    return done.select("doc_id", "title", "text", "year", size.alias("authors"))


@query(
    "queries",
    """
    SELECT query_id, text, NULL::INT AS year FROM queries
    WHERE query_id NOT IN (SELECT CAST(item_id AS STRING) FROM benchmark)
    UNION ALL SELECT CAST(item_id AS STRING), concat('updated ', text), 0 FROM benchmark
    UNION ALL SELECT concat('b', item_id), text, 0 FROM benchmark""",
)
def upsert_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "benchmark")
    key = F.col("item_id").cast("string")
    load = (
        items.select(key.alias("query_id"), "text", F.lit(1).alias("seq"))
        .unionByName(items.select(key.alias("query_id"), F.concat(F.lit("updated "), "text").alias("text"), F.lit(2).alias("seq")))
        .unionByName(
            items.select(F.concat(F.lit("b"), key).alias("query_id"), "text", F.lit(3).alias("seq"))
        )
    )
    return tables.upsert_queries(views.queries(spark, sf_dir), load).select(
        "query_id", "text", "year"
    )


@query(
    "qrels",
    """
    SELECT query_id, doc_id, relevance, iteration, 2 * count(*) AS n
    FROM qrels GROUP BY query_id, doc_id, relevance, iteration""",
)
def append_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All judgements loaded twice, and the second load tried again: every row is there twice."""
    judged, path = views.qrels(spark, sf_dir), scratch_path(spark, "judgements")
    for batch in ("first", "second", "second"):
        tables.append_qrels(judged, path, batch)
    return (
        tables.read_qrels(spark, path)
        .groupBy("query_id", "doc_id", "relevance", "iteration")
        .agg(F.count("*").alias("n"))
    )


@query(
    "docs queries qrels",
    """
    SELECT 2::BIGINT AS version, 'docs' AS name, doc_id AS key, 1::BIGINT AS n,
           md5(concat_ws('|', coalesce(title, ''), coalesce(text, 'null'), CAST(coalesce(year, 0) AS STRING))) AS content FROM docs
    UNION ALL SELECT 2, 'queries', query_id, 1, md5(coalesce(text, 'null')) FROM queries
    UNION ALL SELECT 2, 'qrels', query_id, 2 * count(*), md5(concat_ws('|', doc_id, CAST(relevance AS STRING), iteration))
    FROM qrels GROUP BY query_id, doc_id, relevance, iteration""",
)
def load_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of three tables; all rows of the current one, the second."""
    root = scratch_path(spark, "versions")
    judged = tables.clean_qrels(views.qrels(spark, sf_dir))
    loads = {
        "docs": tables.clean_docs(views.docs(spark, sf_dir)),
        "queries": tables.clean_queries(views.queries(spark, sf_dir)),
        "qrels": judged,
    }
    versions.load_version(spark, root, loads)
    versions.load_version(spark, root, {**loads, "qrels": judged.unionByName(judged)})
    version, _ = versions.current_version(spark, root)
    held = {name: versions.read_version(spark, root, name) for name in loads}
    text = F.coalesce("text", F.lit("null"))
    one = F.lit(1).cast("bigint").alias("n")
    pairs = held["qrels"].groupBy("query_id", "doc_id", "relevance", "iteration").agg(F.count("*").alias("n"))
    shown = {
        "docs": held["docs"].select(F.col("doc_id").alias("key"), one, F.concat_ws("|", "title", text, "year").alias("row")),
        "queries": held["queries"].select(F.col("query_id").alias("key"), one, text.alias("row")),
        "qrels": pairs.select(F.col("query_id").alias("key"), "n", F.concat_ws("|", "doc_id", "relevance", "iteration").alias("row")),
    }
    parts = [df.select(F.lit(name).alias("name"), "key", "n", F.md5("row").alias("content")) for name, df in shown.items()]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.withColumn("version", F.lit(version).cast("bigint"))


@query("docs", "SELECT doc_id, title, text, year FROM docs")
def scan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_docs(views.docs(spark, sf_dir))


@query("queries", "SELECT query_id, text FROM queries")
def scan_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan_queries(views.queries(spark, sf_dir))


@query("", "SELECT count(*) AS docs FROM documents")
def count_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.count_docs(views.docs(spark, sf_dir))


@query(
    "docs",
    """
    SELECT doc_id, coalesce(title, '') AS title, text, coalesce(year, 0) AS year,
           concat('a|', doc_id) AS authors, '' AS cited_by FROM docs""",
)
def clean_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.docs(spark, sf_dir).withColumn("authors", F.array(F.lit("a"), F.col("doc_id")))
    lists = [F.array_join(c, "|").alias(c) for c in ("authors", "cited_by")]
    return tables.clean_docs(raw).select("doc_id", "title", "text", "year", *lists)


_DOC_META = """
    SELECT row_number() OVER (ORDER BY doc_id) AS faiss_id, doc_id, coalesce(title, '') AS title,
           coalesce(year, 0) AS year
    FROM docs"""


@query("docs", _DOC_META)
def doc_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_index(views.docs(spark, sf_dir))


@query("docs", _DOC_META)
def read_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document metadata, stored and read back."""
    path = scratch_path(spark, "meta")
    stores.write_meta(document_index(views.docs(spark, sf_dir)), path)
    return stores.read_meta(spark, path)


@query("docs", "SELECT doc_id, row_number() OVER (ORDER BY doc_id) + 100 AS faiss_id FROM docs")
def assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents, going on after 100."""
    return number(views.docs(spark, sf_dir).select("doc_id"), ["doc_id"], 101)


@query("docs words chunks numbered", "SELECT * FROM numbered")
def chunk_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.chunk_meta(number_chunks(views.pages_of_docs(spark, sf_dir)))


def _sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_shards(number_chunks(views.pages_of_docs(spark, sf_dir)), rows_per_shard=1000)


@query("docs words chunks numbered sharded", "SELECT faiss_id, doc_id, chunk_no, shard FROM sharded")
def assign_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharded(spark, sf_dir).select("faiss_id", "doc_id", "chunk_no", "shard")


@query(
    "docs words chunks numbered sharded",
    """
    SELECT 'hash' AS embedding_model, 64 AS dim, (SELECT max(faiss_id) + 1 FROM sharded) AS next_global_id,
           shard AS name, count(*) AS n
    FROM sharded GROUP BY shard""",
)
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all chunks, one row per shard, written and read back."""
    path = scratch_path(spark, "manifest")
    stores.write_manifest(describe(_sharded(spark, sf_dir), "hash", 64), path)
    shards = stores.read_manifest(spark, path)
    state = state_of(shards).first()
    return shards.select(
        "embedding_model", "dim", F.lit(state["next_global_id"]).cast("bigint").alias("next_global_id"),
        F.col("shard").alias("name"), F.col("count").alias("n"),
    )


@query(
    "docs words chunks numbered sharded",
    """
    SELECT count(DISTINCT doc_id) AS docs, count(*) AS chunks, count(DISTINCT shard) AS shards
    FROM sharded""",
)
def index_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals_of(_sharded(spark, sf_dir))


@query(
    "docs words chunks",
    r"""
    , old AS (SELECT row_number() OVER (ORDER BY doc_id, chunk_no) AS faiss_id, doc_id, chunk_no, text FROM chunks),
    turns AS (SELECT concat('t', conv_id, '-', turn) AS doc_id,
                     list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w
              FROM conversations),
    fresh AS (SELECT doc_id, CAST(i AS INT) AS chunk_no, array_to_string(list_slice(w, i * 160 + 1, i * 160 + 240), ' ') AS text
              FROM (SELECT *, unnest(range(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 240 THEN 1
                ELSE CAST(ceil((len(w) - 240) / 160.0) AS BIGINT) + 1 END)) AS i FROM turns)),
    bounds AS (SELECT count(*) AS n, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS shards FROM old),
    stored AS (
      SELECT faiss_id, doc_id, chunk_no, text, printf('shard_%04d', (faiss_id - 1) // 1000 + 1) AS shard FROM old
      UNION ALL
      SELECT n + p, doc_id, chunk_no, text, printf('shard_%04d', (p - 1) // 1000 + 1 + shards)
      FROM (SELECT row_number() OVER (ORDER BY doc_id, chunk_no) AS p, * FROM fresh), bounds),
    counts AS (
      SELECT faiss_id, CAST(concat('0x', left(md5(word), 6)) AS BIGINT) % 16 AS bucket, count(*) AS n
      FROM (SELECT faiss_id, unnest(string_split(text, ' ')) AS word FROM stored) GROUP BY ALL),
    vectors AS (
      SELECT faiss_id, string_agg(CAST(CAST(floor(CAST(CAST(coalesce(n, 0) / norm AS FLOAT) AS DOUBLE) * 10000 + 0.5) AS BIGINT) AS VARCHAR), ' ' ORDER BY bucket) AS vector
      FROM (SELECT faiss_id, sqrt(sum(n * n)) AS norm, unnest(range(16)) AS bucket FROM counts GROUP BY faiss_id)
      LEFT JOIN counts USING (faiss_id, bucket) GROUP BY faiss_id)
    SELECT faiss_id, doc_id, chunk_no, shard, md5(text) AS text, vector FROM stored JOIN vectors USING (faiss_id)""",
)
def append_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of all documents, then a second run over these and all conversation turns."""
    path = scratch_path(spark, "index")
    documents = views.pages_of_docs(spark, sf_dir)
    turn = F.concat_ws("-", F.concat(F.lit("t"), F.col("conv_id")), "turn").alias("id")
    turns = read(spark, sf_dir, "conversations").select(
        turn, F.lit(None).cast("string").alias("title"), "text", F.lit("").alias("url")
    )

    def embed(chunks: DataFrame) -> DataFrame:
        return hash_embed(chunks, "text", 16)

    append_to_index(documents, path, embed, "hash", 16, rows_per_shard=1000)
    append_to_index(
        documents.unionByName(turns), path, embed, "hash", 16, rows_per_shard=1000
    )
    chunks = read_index(spark, path).select("faiss_id", "doc_id", "chunk_no", "shard", F.md5("text").alias("text"))
    vectors = read_index_vectors(spark, path).select("faiss_id", "shard", _shown(F.col("embedding")).alias("vector"))
    return chunks.join(vectors, ["faiss_id", "shard"])


def _shown(vector: Column) -> Column:
    """All components, in ten-thousandths."""
    parts = F.transform(vector, lambda x: F.floor(x.cast("double") * 10000 + 0.5).cast("string"))
    return F.array_join(parts, " ")


@query(
    "docs",
    "SELECT doc_id FROM docs WHERE doc_id NOT IN (SELECT CAST(doc_id AS STRING) FROM labels)",
)
def resume_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents still to index when the labelled ones are done."""
    done = read(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    return not_indexed(views.docs(spark, sf_dir), done).select("doc_id")


@query(
    "",
    """
    SELECT vec_id AS faiss_id, printf('shard_%04d', label + 1) AS shard, array_to_string(list_transform(embedding,
             lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 10000 + 0.5) AS BIGINT) AS VARCHAR)), ' ') AS vector
    FROM embeddings""",
)
def write_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, stored by shard (here: by label) and read back."""
    path = scratch_path(spark, "vectors")
    stored = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("faiss_id"),
        F.format_string("shard_%04d", F.col("label") + 1).alias("shard"),
        "embedding",
    )
    stores.write_vectors(stored, path)
    return stores.read_vectors(spark, path).select("faiss_id", "shard", _shown(F.col("embedding")).alias("vector"))
