"""Building and extending an index: pages or documents to ids, shards and vectors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.operators.chunks import chunk_count, chunk_documents
from trovescan.operators.ids import (
    MAX_BROADCAST_KEYS,
    assign_shards,
    attach_ids,
    index_state,
    manifest,
    resume_chunks,
)
from trovescan.schemas import VECTORS, columns
from trovescan.session import materialize
from trovescan.sources.stores import read_manifest, read_meta, read_vectors, write_manifest
from trovescan.sources.tables import conform, doc_meta

Embed = Callable[[DataFrame], DataFrame]

FILE_ROWS = 65_536
CHUNKS = (
    "faiss_id bigint, doc_id string, title string, url string, chunk_no int, text string, "
    "run string, shard string"
)


def number_chunks(
    pages: DataFrame, first_id: int = 1, size: int = 240, stride: int = 160, done: DataFrame | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Chunk pages and number the chunks in (document, chunk) order.

    Pages whose doc_id is in ``done`` are left out, and those whose doc_id is not in ``only``.
    """
    docs = pages.select(F.col("id").alias("doc_id"), "title", "url", "text")
    return attach_ids(
        docs,
        ["doc_id"],
        first_id,
        count=chunk_count(F.col("text"), size, stride),
        expand=lambda d: chunk_documents(d, "text", size, stride),
        place="chunk_no",
        done=done,
        only=only,
    )


def document_index(docs: DataFrame) -> DataFrame:
    """Metadata of the whole-document index, numbered in the order of the ids. No text is read."""
    return doc_meta(attach_ids(docs.select("doc_id", "title", "year"), ["doc_id"]))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of the index at ``path``; none before the first run.

    Only ids below the manifest's next one belong to it: shards of a run that
    failed before its manifest are not seen, and later runs overwrite them.
    """
    return _indexed(spark, path, lambda: read_meta(spark, f"{path}/chunks", CHUNKS), CHUNKS)


def read_index_vectors(spark: SparkSession, path: str) -> DataFrame:
    """The vectors of the index at ``path``, over all shards."""
    return _indexed(spark, path, lambda: read_vectors(spark, f"{path}/vectors"), VECTORS)


def _indexed(spark: SparkSession, path: str, read: Callable[[], DataFrame], schema: str) -> DataFrame:
    state = index_state(read_manifest(spark, f"{path}/manifest")).first()
    if not state["shards"]:
        return spark.createDataFrame([], schema)
    return read().where(F.col("faiss_id") < state["next_global_id"])


def _replace_shards(rows: DataFrame, path: str) -> None:
    """Write shard folders, replacing those of the same name and no others.

    Rows are dealt out by blocks of ids, which lie in one shard or two, so that
    a task writes few files and a shard is written by many tasks.
    """
    block = F.floor(F.col("faiss_id") / F.lit(FILE_ROWS))
    rows.repartition("shard", block).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("shard").parquet(path)


def append_chunks(
    pages: DataFrame,
    path: str,
    embed: Embed,
    model: str,
    dim: int,
    rows_per_shard: int = 500_000,
    resume: bool = True,
    size: int = 240,
    stride: int = 160,
    max_broadcast_keys: int = MAX_BROADCAST_KEYS,
    only: DataFrame | None = None,
) -> DataFrame:
    """Add pages to the index at ``path`` and return its manifest, one row for each shard.

    Ids and shard names continue where the manifest ends; shards that exist
    stay as they are. With ``resume``, pages already indexed are left out: by their broadcast ids, or, beyond
    ``max_broadcast_keys`` of these, when the new ones are numbered, which sorts keys and no texts. With ``only``, a
    column of page ids that may repeat, all other pages are left out in the same way.
    Vectors are made from the chunks as stored. The manifest is written last,
    so it lists complete shards only. One run at a time.
    """
    spark = pages.sparkSession
    state = index_state(read_manifest(spark, f"{path}/manifest")).first()
    if state["embedding_model"] not in (None, model) or state["dim"] not in (None, dim):
        raise ValueError(
            f"index holds {state['embedding_model']} with {state['dim']} dimensions, "
            f"not {model} with {dim}"
        )
    first_id, existing = state["next_global_id"], state["shards"]
    if only is not None:
        only = materialize(only.toDF("doc_id").distinct(), "only")
        if only.count() <= max_broadcast_keys:
            pages, only = pages.join(F.broadcast(only.toDF("id")), "id", "left_semi"), None
    done = None
    if resume and existing:
        done = materialize(read_index(spark, path).select("doc_id").distinct(), "indexed")
        if done.count() <= max_broadcast_keys:
            pages, done = resume_chunks(pages, done.toDF("id"), "id", few=True), None
    run = uuid.uuid4().hex
    chunks = assign_shards(
        number_chunks(pages, first_id, size, stride, done, only), first_id, rows_per_shard, existing
    ).withColumn("run", F.lit(run))
    _replace_shards(chunks.select(*columns(CHUNKS)), f"{path}/chunks")
    # A failed run may have left shards that this one did not need.
    written = read_meta(spark, f"{path}/chunks", CHUNKS).where(F.col("run") == run)
    if not written.isEmpty():
        vectors = embed(written.select("faiss_id", "shard", "text"))
        _replace_shards(conform(vectors, VECTORS), f"{path}/vectors")
        write_manifest(manifest(written, model, dim), f"{path}/manifest")
    return read_manifest(spark, f"{path}/manifest")

