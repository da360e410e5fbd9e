"""Documents, queries and judgements: cleaning, keyed upsert, append, scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.schemas import DOC_META, DOCS, QRELS, QUERIES, columns, struct
from trovescan.session import materialize


def conform(df: DataFrame, schema: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the declared columns, in order and type; absent ones are null."""

    def declared(field):
        column = F.col(field.name) if field.name in df.columns else F.lit(None)
        return column.cast(field.dataType).alias(field.name)

    return df.select(*[declared(f) for f in struct(schema)], *extra)


def _defaults(df: DataFrame, schema: str, keep: set[str], extra: tuple[str, ...]) -> DataFrame:
    empty = {"string": F.lit(""), "int": F.lit(0)}

    def settle(field):
        column = F.col(field.name)
        if field.name in keep:
            return column
        default = empty.get(field.dataType.simpleString(), F.array().cast(field.dataType))
        return F.coalesce(column, default).alias(field.name)

    return conform(df, schema, extra).select(*[settle(f) for f in struct(schema)], *extra)


def clean_docs(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Null title, text, year and lists become '', 0 and empty lists."""
    return _defaults(docs, DOCS, {"doc_id"}, extra)


def clean_queries(queries: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """As for documents, but the text of a query stays as it is."""
    return _defaults(queries, QUERIES, {"query_id", "text"}, extra)


def clean_qrels(qrels: DataFrame) -> DataFrame:
    """A missing iteration becomes ''."""
    return conform(qrels, QRELS).withColumn("iteration", F.coalesce("iteration", F.lit("")))


def last_rows(load: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key, in the order of ``seq``.

    An aggregate, so a key that fills the load is reduced before the shuffle.
    """
    rest = [c for c in load.columns if c not in (key, seq)]
    return (
        load.groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
        .select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )


def upsert(table: DataFrame, load: DataFrame, key: str, seq: str) -> DataFrame:
    """The table with the rows of ``load`` put in, replacing equal keys; later rows win.

    ``table`` has one row per key. Only the load is grouped; the table passes
    through one anti join, which moves none of it when the load is small. The
    newest rows are stored, as both the join and the result need them.
    """
    newest = materialize(last_rows(load, key, seq).select(*table.columns), "load")
    return table.join(newest.select(key), key, "left_anti").select(*table.columns).unionByName(newest)


def upsert_docs(docs: DataFrame, load: DataFrame, seq: str = "seq") -> DataFrame:
    return upsert(conform(docs, DOCS), clean_docs(load, (seq,)), "doc_id", seq)


def upsert_queries(queries: DataFrame, load: DataFrame, seq: str = "seq") -> DataFrame:
    return upsert(conform(queries, QUERIES), clean_queries(load, (seq,)), "query_id", seq)


def append_qrels(load: DataFrame, path: str, batch: str) -> None:
    """Add a batch of judgements to the table at ``path``.

    Judgements have no key, so a second load of the same rows repeats them. Each
    load has a token of its own, which names its folder: a load that is tried
    again under the same token replaces what it wrote, and adds nothing twice.
    """
    if not batch:
        raise ValueError("a load of judgements needs a token")
    rows = clean_qrels(load).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """All judgements loaded so far."""
    return spark.read.schema(QRELS + ", batch string").parquet(path).select(*columns(QRELS))


def scan_docs(docs: DataFrame) -> DataFrame:
    """The columns an index needs."""
    return docs.select("doc_id", "title", "text", "year")


def scan_queries(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "text")


def count_docs(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("docs"))


def doc_meta(numbered: DataFrame) -> DataFrame:
    """Metadata of numbered documents; a missing title is '', a missing year 0."""
    return numbered.select(
        "faiss_id",
        "doc_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("year", F.lit(0)).alias("year"),
    ).select(*columns(DOC_META))


def chunk_meta(chunks: DataFrame) -> DataFrame:
    """Metadata of numbered chunks."""
    return chunks.select("faiss_id", "doc_id", "title", "url", "text", "chunk_no")
