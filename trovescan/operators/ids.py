"""Gapless ids, shards, and what an append run has to skip."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovescan.session import materialize

MAX_BROADCAST_KEYS = 1_000_000  # 40 bytes each
MAX_REPEATED = 100_000
_BLOCK = 1000  # copies of a row made by one task
_ROW_BITS = 33  # monotonically_increasing_id: partition above, row within it below


def assign_ids(
    df: DataFrame, order_by: list[str], first_id: int = 1, id_column: str = "faiss_id"
) -> DataFrame:
    """Number rows without texts from ``first_id``, without gaps, in the order of ``order_by``.

    One range shuffle, and no window over the data: each partition numbers its
    own rows, the numbered rows are stored (which fixes the numbering for good),
    and the running total of the partition sizes, one row per partition, gives
    where each partition starts. ``order_by`` should identify a row; then no
    range can become too large. For rows with texts see ``attach_ids``.
    """
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    stored = materialize(ordered.withColumn("_place", F.monotonically_increasing_id()), "ids")
    part = F.shiftright("_place", _ROW_BITS)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    row = F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(_starts(sizes)), "_part")  # one row per partition of the shuffle
        .select((F.col("_start") + row + first_id).alias(id_column), *ordered.columns)
    )


def _starts(sizes: DataFrame) -> DataFrame:
    """(_part, _start): how many rows all earlier partitions have. One row per partition."""
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))


def key_histogram(keys: DataFrame, order_by: list[str], first_id: int = 1) -> DataFrame:
    """Where each key begins if every key takes ``_n`` ids for each of its ``_copies``: adds ``_first``.

    The keys are range-shuffled; each partition adds up its own rows, and the
    running total over the partitions gives where each of them starts.
    """
    ordered = keys.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    ordered = ordered.select(*keys.columns, F.spark_partition_id().alias("_part"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            taken = batch.column("_n").to_numpy().astype(np.int64) * batch.column("_copies").to_numpy()
            upto = total + np.cumsum(taken)
            if len(upto):
                total = int(upto[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - taken), pa.array(upto)], names=names)

    names = [*ordered.columns, "_before", "_upto"]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema] + ["_before long", "_upto long"]
    stored = materialize(ordered.mapInArrow(add_up, ", ".join(kinds)), "key-histogram")
    sizes = stored.groupBy("_part").agg(F.max("_upto").alias("_rows"))
    first = F.col("_start") + F.col("_before") + first_id
    return stored.join(F.broadcast(_starts(sizes)), "_part").select(*keys.columns, first.alias("_first"))


def attach_ids(
    docs: DataFrame,
    order_by: list[str],
    first_id: int = 1,
    id_column: str = "faiss_id",
    count: Column | None = None,
    expand: Callable[[DataFrame], DataFrame] | None = None,
    place: str | None = None,
    max_broadcast_keys: int = MAX_BROADCAST_KEYS,
    done: DataFrame | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Number documents, or what ``expand`` makes of each, without gaps and without sorting their texts.

    Documents are in the order of ``order_by``, those that agree there in that of
    a digest of all their columns. ``expand`` is a narrow step, such as chunking,
    that makes ``count`` rows of a document, numbered by ``place`` from 0.

    Only a histogram of keys is sorted: for each digest its order columns, how
    many ids it takes and how often it occurs. Its running total, joined back by
    digest, gives every document its first id. Up to ``max_broadcast_keys`` keys
    are broadcast, and the texts stay where they lie; beyond, both sides are
    hashed by digest. Equal rows are interchangeable: one of them stands for all
    and is repeated with the ids of all, so that a row that fills the table does
    not meet in one task. A null in any column is a value of its own.

    Documents named in ``done``, whose columns are some of ``order_by``, get no ids and are left out; so are, with
    ``only``, all that it does not name. Only the histogram meets them, so this moves no text either.
    """
    parts = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    digests = {"_x": F.xxhash64(*parts), "_y": F.xxhash64(F.lit(1), *parts)}
    marked = docs.withColumns(digests)
    takes = F.lit(1) if count is None else count
    keys = marked.select(*order_by, "_x", "_y", takes.cast("long").alias("_n")).groupBy(*order_by, "_x", "_y")
    keys = keys.agg(F.first("_n").alias("_n"), F.count("*").alias("_copies")).where(F.col("_n") > 0)
    if only is not None:
        keys = keys.join(only, only.columns, "left_semi")
    if done is not None:
        keys = keys.join(done, done.columns, "left_anti")
    keys = key_histogram(keys, [*order_by, "_x", "_y"], first_id).select("_x", "_y", "_n", "_copies", "_first")
    n_keys, n_rows = keys.agg(F.count("*"), F.coalesce(F.sum("_copies"), F.lit(0))).first()
    often = max(2, n_rows // MAX_REPEATED + 1)  # at most MAX_REPEATED keys occur so often
    repeated = keys.where(F.col("_copies") >= often)
    parted = not repeated.isEmpty()
    digest = ["_x", "_y"]
    rest = marked.join(F.broadcast(repeated.select(*digest)), digest, "left_anti") if parted else marked
    found = rest.join(F.broadcast(keys) if n_keys <= max_broadcast_keys else keys.hint("shuffle_hash"), digest)
    numbered = found.where(F.col("_copies") == 1).withColumn("_copy", F.lit(0).cast("long"))
    if often > 2:
        numbered = numbered.unionByName(_copied(found.where(F.col("_copies") > 1)))
    if parted:
        numbered = numbered.unionByName(_copied(marked.join(F.broadcast(repeated), digest)))
    rows = expand(numbered) if expand else numbered
    at = F.col(place) if place else F.lit(0)
    ids = (F.col("_first") + F.col("_copy") * F.col("_n") + at).cast("long").alias(id_column)
    return rows.select(ids, *[F.col(f"`{c}`") for c in rows.columns if c not in ("_x", "_y", "_n", "_copies", "_first", "_copy")])


def _copied(rows: DataFrame) -> DataFrame:
    """One row of each digest, reduced in each task first, as often as it occurs; dealt out by blocks of copies."""
    one = rows.dropDuplicates(["_x", "_y"])
    last = F.col("_copies") - 1
    blocks = one.withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor(last / _BLOCK))))
    blocks = blocks.repartition("_x", "_y", "_block")
    low = F.col("_block") * _BLOCK
    copies = F.sequence(low, F.least(low + _BLOCK - 1, last))
    return blocks.withColumn("_copy", F.explode(copies)).drop("_block")


def assign_shards(
    df: DataFrame,
    first_id: int = 1,
    rows_per_shard: int = 500_000,
    existing: int = 0,
    id_column: str = "faiss_id",
) -> DataFrame:
    """Name the shard of each row: consecutive ids, ``rows_per_shard`` to a shard."""
    number = F.floor((F.col(id_column) - first_id) / F.lit(rows_per_shard)) + 1 + existing
    return df.withColumn("shard", F.format_string("shard_%04d", number))


def resume_chunks(docs: DataFrame, indexed: DataFrame, key: str = "doc_id", few: bool = False) -> DataFrame:
    """The documents that the index does not hold yet. With ``few`` its ids are broadcast, and no text is shuffled."""
    held = indexed.select(key)
    return docs.join(F.broadcast(held) if few else held.distinct(), key, "left_anti")


def manifest(chunks: DataFrame, model: str, dim: int) -> DataFrame:
    """One row for each shard: the model and dimension it was made with, its ids and its size."""
    return chunks.groupBy("shard").agg(
        F.lit(model).alias("embedding_model"),
        F.lit(dim).cast("int").alias("dim"),
        F.min("faiss_id").alias("first_id"),
        (F.max("faiss_id") + 1).alias("next_id"),
        F.count("*").alias("count"),
    )


def index_state(shards: DataFrame, first_id: int = 1) -> DataFrame:
    """One row from the manifest: model, dimension, the next free id, and how many shards there are."""
    return shards.agg(
        F.max("embedding_model").alias("embedding_model"),
        F.max("dim").alias("dim"),
        F.coalesce(F.max("next_id"), F.lit(first_id)).cast("bigint").alias("next_global_id"),
        F.count("*").alias("shards"),
    )


def index_totals(chunks: DataFrame) -> DataFrame:
    """Documents and chunks held, and shards they are in."""
    return chunks.agg(
        F.countDistinct("doc_id").alias("docs"),
        F.count("*").alias("chunks"),
        F.countDistinct("shard").alias("shards"),
    )
