"""Nearest-neighbour search as Spark jobs. No pair of rows is ever emitted.

Every search compares blocks: vectors lie in cells, each query lists the cells
it asks for, and each block yields at most k rows per query. Exhaustive search
over few queries is the case of one cell.

Two physical forms, chosen by the measured size of the query side:

* small: the queries are broadcast once, with the rows that each cell is asked
  by, and the vectors are scanned in place, without any shuffle of the vectors;
* otherwise: queries are dealt into bounded parts, cells into bounded bundles, and
  each part meets each bundle that it asks for something, so that neither side has to
  fit anywhere as a whole and a hot cell is spread over several bundles.

An index deals vectors into tiles by nearness: each has a centre and lies
between two distances from it. A first step finds k near vectors of each query;
their farthest one bounds which other tiles can matter, by the triangle
inequality, and only those are searched, by queries that carry that bound.
Exhaustive search of two large sides makes such an index for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trovescan.operators.nearest import Nearest, cross_distance, matrix, steps
from trovescan.schemas import HITS
from trovescan.session import materialize, scratch_path

MAX_BROADCAST_BYTES = 64 << 20
TILE_BYTES = 32 << 20
#: Vectors that one task of a search through tiles holds, and into how many parts two large sides are cut at least.
TASK_BYTES = 32 << 20
SPREAD = 8
LISTED_CELLS = 10_000
#: A kept hit counts so many times when hits are cut into batches.
HIT_WIDTH = 16
#: Vectors in a tile of a stored index, so that its table of tiles is small enough for the driver.
TILE_ROWS = 65_536
#: Centres are fitted on a random sample of about so many vectors; every vector is then indexed.
FIT_ROWS = 100_000
_ASKED = ["query_id", "embedding", "cells", "bound"]


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query with ``rank`` from 1; ties go to the lower id."""
    order = Window.partitionBy("query_id").orderBy("score", "faiss_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- search inside cells -------------------------------------------------


def _query_side(asked: DataFrame) -> tuple[int, int, int]:
    """Row count, dimension and bytes of all ids and cell lists of the query side."""
    size = F.size("embedding")
    other = F.coalesce(F.sum(F.octet_length("query_id") + 12 * F.size("cells")), F.lit(0))
    rows, low, high, listed = asked.agg(F.count("*"), F.min(size), F.max(size), other).first()
    if low != high:
        raise ValueError(f"query vectors of different dimensions: {low} to {high}")
    return rows, low or 0, listed


def _hit_batches(names: pa.Array, found: Nearest) -> Iterator[pa.RecordBatch]:
    """Everything kept, some queries at a time."""
    for part in steps(len(names), HIT_WIDTH * found.k):
        row, ids, scores = found.hits(part)
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(row)), pa.array(ids), pa.array(scores)],
            names=["query_id", "faiss_id", "score"],
        )


def _by_value(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, positions) for each different value."""
    order = np.argsort(values, kind="stable")
    each, starts = np.unique(values[order], return_index=True)
    yield from zip(each.tolist(), np.split(order, starts[1:]), strict=False)


def _bounds(column) -> np.ndarray:
    """Scores beyond which a query needs nothing; null means that it has no bound."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(np.inf).to_numpy(zero_copy_only=False)


def _scan_search(asked: DataFrame, vectors: DataFrame, k: int, distinct: bool) -> DataFrame:
    """Broadcast the (checked) queries once and keep one top-k state per task.

    Only the cells that some query asks for are read, while they are few enough to list in a
    filter; with more of them the tasks skip the others.
    """
    table = asked.select(*_ASKED).toArrow()
    lists = table.column("cells").combine_chunks()
    row = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    asking = {cell: row[at] for cell, at in _by_value(lists.flatten().to_numpy(zero_copy_only=False))}
    shared = asked.sparkSession.sparkContext.broadcast(
        (table.column("query_id").combine_chunks(), matrix(table.column("embedding")), _bounds(table.column("bound")), asking)
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, queries, bounds, rows = shared.value
        state = Nearest(queries, k, bounds, distinct)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, block = batch.column("faiss_id").to_numpy(), matrix(batch.column("embedding"))
            for cell, at in _by_value(batch.column("cell").to_numpy()):
                if cell in rows:
                    state.offer(ids[at], block[at], rows[cell])
        yield from _hit_batches(names, state)

    held = vectors.select("cell", "faiss_id", "embedding")
    if len(asking) <= LISTED_CELLS:
        held = held.where(F.col("cell").isin(list(asking)))
    return held.mapInArrow(scan, HITS)


def _place_of(cell, shift):
    """Where the pieces of a cell begin among the bundles; the same sum in numpy and in Spark."""
    return cell + shift(cell, 24) * 7 + shift(cell, 32) * 13


def _tile_search(asked: DataFrame, vectors: DataFrame, k: int, dim: int, tile_bytes: int, distinct: bool):
    """Deal queries into parts and the cells asked for into bundles, and cogroup each part with each bundle.

    A query goes once to each bundle in which it asks for something, with the cells it lists there, so that small
    cells do not multiply the copies. Parts and bundles take up to ``TASK_BYTES``; a cell too large for its share is
    cut into pieces of different bundles. Fewer than ``SPREAD`` of each are only made of less than so many tiles.
    """
    # One row per cell that both sides have, counted without vectors.
    wanted = asked.select(F.explode("cells").alias("cell")).distinct()
    grid = materialize(vectors.groupBy("cell").agg(F.count("*").alias("_rows")).join(wanted, "cell"), "tiles")
    rows, _, listed = _query_side(asked)
    many = grid.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    tile_rows = max(1, tile_bytes // (4 * max(1, dim)))
    n = max(1, -(-many * 4 * dim // TASK_BYTES), min(SPREAD, -(-many // tile_rows)))
    taken = rows * (4 * dim + 16 * k) + listed // n
    parts = max(1, -(-taken // (2 * TASK_BYTES)), min(SPREAD, -(-rows // tile_rows)))
    piece_rows = max(1, many // (4 * n))
    # At most 4 n + 4 cells have so many rows.
    large = grid.where(F.col("_rows") > piece_rows).collect()
    pieces = {r["cell"]: min(n, -(-r["_rows"] // piece_rows)) for r in large}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cells").value_lengths().to_numpy(zero_copy_only=False)
            for part in steps(batch.num_rows, int(lists.max()) if len(lists) else 1):
                own = batch.slice(part.start, part.stop - part.start)
                cell = own.column("cells").flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(own.num_rows), lists[part])
                into = np.ones(len(cell), np.int64)
                for one, cut in pieces.items():
                    into[cell == one] = cut
                at = np.repeat(np.arange(len(cell)), into)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(into) - into, into)
                bundle = (_place_of(cell, np.right_shift)[at] + piece) % n
                order = np.lexsort((bundle, row[at]))
                row, bundle, cell = row[at][order], bundle[order], cell[at][order]
                new = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(bundle, prepend=-1) != 0))
                ends = np.append(new, len(row)).astype(np.int32)
                took = pa.array(row[new])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bundle[new], pa.int64()), own.column("query_id").take(took), own.column("embedding").take(took),
                        pa.ListArray.from_arrays(ends, pa.array(cell, pa.int64())), own.column("bound").take(took),
                    ],
                    names=["bundle", "query_id", "asked", "cells", "bound"],
                )

    kinds = "bundle bigint, query_id string, asked array<float>, cells array<bigint>, bound double"
    left = asked.select(*_ASKED).mapInArrow(deal, kinds)
    left = left.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    cut = F.lit(1)
    if pieces:
        listed_pieces = F.create_map(*[F.lit(x).cast("bigint") for pair in pieces.items() for x in pair])
        cut = F.coalesce(F.element_at(listed_pieces, F.col("cell")), F.lit(1))
    piece = F.pmod(F.xxhash64("faiss_id"), cut)
    right = vectors.join(grid.select("cell"), "cell", "left_semi").select(
        F.pmod(_place_of(F.col("cell"), F.shiftright) + piece, F.lit(n)).cast("bigint").alias("bundle"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        "cell", "faiss_id", F.col("embedding").alias("held"),
    )

    def compare(queries: pa.Table, held: pa.Table) -> pa.Table:
        state = Nearest(matrix(queries.column("asked")), k, _bounds(queries.column("bound")), distinct)
        if queries.num_rows and held.num_rows:
            lists = queries.column("cells").combine_chunks()
            row = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
            asking = {cell: row[at] for cell, at in _by_value(lists.flatten().to_numpy(zero_copy_only=False))}
            ids, block = held.column("faiss_id").to_numpy(), matrix(held.column("held"))
            for cell, at in _by_value(held.column("cell").to_numpy()):
                if cell in asking:
                    state.offer(ids[at], block[at], asking[cell])
        names = queries.column("query_id").combine_chunks()
        kinds = pa.schema([("query_id", names.type), ("faiss_id", pa.int64()), ("score", pa.float64())])
        return pa.Table.from_batches(_hit_batches(names, state), kinds)

    keys = ["part", "bundle"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, HITS)


def search_cells(
    asked: DataFrame,
    vectors: DataFrame,
    k: int,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    tile_bytes: int = TILE_BYTES,
    distinct: bool = False,
) -> DataFrame:
    """Compare queries with the vectors (cell, faiss_id, embedding) of the cells that they list.

    ``asked`` has query_id, embedding, cells, and bound: the score beyond which the query needs no hit, or null.
    With ``distinct``, a vector may be in several cells of a query. The queries are broadcast if their
    vectors, ids, lists and the k hits that each task keeps for each of them take at most
    ``max_broadcast_bytes`` together.

    Returns hits that contain the k best of each query among those cells and within its bound, not yet merged.
    """
    vectors = vectors.where(F.col("embedding").isNotNull())
    asked = asked.where(F.col("embedding").isNotNull() & (F.size("cells") > 0))
    rows, dim, listed = _query_side(asked)
    if not rows:
        return asked.sparkSession.createDataFrame([], HITS)
    if rows * (4 * dim + 16 * k) + listed <= max_broadcast_bytes:
        return _scan_search(asked, vectors, k, distinct)
    return _tile_search(asked, vectors, k, dim, tile_bytes, distinct)


def knn_exact(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """Exhaustive top-k: (query_id, faiss_id, score, rank), score = squared distance.

    Queries too large to broadcast are searched through tiles of the vectors, made for this search.
    """
    queries = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    everywhere = queries.select(*_ASKED[:2], F.array(F.lit(0).cast("bigint")).alias("cells"), _unbounded())
    rows, dim, listed = _query_side(everywhere)
    if rows * (4 * dim + 16 * k) + listed <= max_broadcast_bytes:
        held = vectors.select(F.lit(0).cast("bigint").alias("cell"), "faiss_id", "embedding")
        return top_hits(search_cells(everywhere, held, k, max_broadcast_bytes, tile_bytes), k)
    tile_rows = max(1, tile_bytes // (4 * dim))
    many = vectors.count()
    cells = min(1024, max(1, round(many**0.5 / 4)))
    index = build_clusters(vectors, cells, max_iter=5, tile_rows=tile_rows)
    return knn_clusters(queries, index, k, 1, True, max_broadcast_bytes, tile_bytes)


def _unbounded() -> Column:
    return F.lit(None).cast("double").alias("bound")


# --- two-step exact search over an index ----------------------------------


def _kth_distance(queries: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """Queries with ``bound``: no vector with a higher score can be among the k best. Null without k hits so far."""
    found = first.groupBy("query_id").agg(F.max("score").alias("worst"), F.count("*").alias("n"))
    bound = F.when(F.col("n") >= k, F.col("worst")).alias("bound")
    return queries.join(found.select("query_id", bound), "query_id", "left")


# --- clustered index ------------------------------------------------------


@dataclass(frozen=True)
class Clusters:
    """Vectors stored in tiles (column ``cell``), the centres, and a table of the tiles."""

    vectors: DataFrame
    centres: np.ndarray
    tiles: np.ndarray  # the number of each tile
    centre_of: np.ndarray  # of each tile
    rows: np.ndarray  # in each tile
    nearest: np.ndarray  # distance of its nearest vector from the centre
    farthest: np.ndarray


_PLACED = "faiss_id bigint, embedding array<float>, centre bigint, gap double"
_STORED = "faiss_id bigint, embedding array<float>, cell bigint, gap double, generation int"
_TILES = "generation int, cell bigint, centre bigint, rows bigint, nearest double, farthest double, gaps double"


def write_clusters(
    vectors: DataFrame, path: str, cells: int = 16, seed: int = 7, max_iter: int = 10, init_steps: int = 2,
    tile_rows: int = TILE_ROWS, fit_rows: int = FIT_ROWS,
) -> None:
    """Fit centres on a sample of the vectors, and store every vector in a tile of its nearest one.

    A tile holds at most ``tile_rows`` vectors of about the same distance from their centre. Its centre and its two
    distances are a table beside the vectors, as are the centres.
    """
    vectors = vectors.select("faiss_id", "embedding").where(F.col("embedding").isNotNull())
    features = vectors.select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    rows = vectors.count()
    if rows > fit_rows:
        features = features.sample(fit_rows / rows, seed)
    model = KMeans(k=cells, seed=seed, maxIter=max_iter, initSteps=init_steps).fit(features)
    places = [(i, c.tolist()) for i, c in enumerate(model.clusterCenters())]
    spark = vectors.sparkSession
    spark.createDataFrame(places, "centre bigint, place array<double>").write.parquet(f"{path}/centres")
    _add_generation(vectors, path, 0, tile_rows)


def append_clusters(vectors: DataFrame, path: str, tile_rows: int = TILE_ROWS) -> None:
    """Add vectors to a stored index, as a generation of tiles around the centres it has.

    Earlier generations stay as they are. The tiles of a generation are listed after its vectors are stored, in one
    file, so a run that fails before leaves nothing that a search reads, and the next one overwrites it. One
    run at a time.
    """
    spark = vectors.sparkSession
    last = spark.read.schema(_TILES).parquet(f"{path}/tiles").agg(F.max("generation")).first()[0]
    held = vectors.select("faiss_id", "embedding").where(F.col("embedding").isNotNull())
    _add_generation(held, path, 0 if last is None else last + 1, tile_rows)


def cluster_growth(spark: SparkSession, path: str) -> DataFrame:
    """For each generation: vectors, mean distance from their centres, and whether fitting anew pays.

    It does once as many vectors were added as the centres were fitted for, or if those added lie half as far
    again from the centres as the first ones.
    """
    tiles = spark.read.schema(_TILES).parquet(f"{path}/tiles")
    each = tiles.groupBy("generation").agg(F.sum("rows").alias("rows"), (F.sum("gaps") / F.sum("rows")).alias("mean_gap"))
    first = tiles.where("generation = 0").agg(F.sum("rows"), F.sum("gaps")).first()  # one row
    rows, gaps = first[0] or 0, first[1] or 0.0
    upto = Window.orderBy("generation").rowsBetween(Window.unboundedPreceding, 0)  # one row for each append
    added = F.sum(F.when(F.col("generation") > 0, F.col("rows")).otherwise(0)).over(upto)
    far = (F.col("generation") > 0) & (F.col("mean_gap") * rows > 1.5 * gaps)
    return each.withColumn("refit", (added >= F.lit(max(rows, 1))) | far)


def _read_centres(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centres").collect()  # as many as were asked for
    return np.array([r["place"] for r in sorted(rows, key=lambda r: r["centre"])])


def _add_generation(vectors: DataFrame, path: str, generation: int, tile_rows: int) -> None:
    spark = vectors.sparkSession
    centres = _read_centres(spark, path)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block = matrix(batch.column("embedding"))
                for part in steps(len(block), len(centres)):
                    gaps = cross_distance(block[part], centres)
                    centre = gaps.argmin(1)
                    rows = batch.slice(part.start, len(centre))
                    yield pa.RecordBatch.from_arrays(
                        [*rows.columns, pa.array(centre.astype(np.int64)), pa.array(gaps.min(1))],
                        names=["faiss_id", "embedding", "centre", "gap"],
                    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, tile, held = None, -1, 0
        for batch in batches:
            centres, out = batch.column("centre").to_numpy(), np.empty(batch.num_rows, np.int64)
            starts = np.flatnonzero(np.diff(centres, prepend=centres[:1] - 1)).tolist()
            for at, to in zip(starts, [*starts[1:], len(centres)], strict=False):
                while at < to:
                    if centres[at] != centre or held == tile_rows:
                        centre, tile, held = centres[at], tile + 1, 0
                    upto = min(to, at + tile_rows - held)
                    out[at:upto], held, at = tile, held + upto - at, upto
            if batch.num_rows:
                first = (generation << 44) + (batch.column("part")[0].as_py() << 24)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("faiss_id", "embedding", "centre", "gap")], pa.array(out + first)],
                    names=["faiss_id", "embedding", "centre", "gap", "cell"],
                )

    order = ["centre", "gap", "faiss_id"]
    placed = vectors.mapInArrow(place, _PLACED).repartitionByRange(*order).sortWithinPartitions(*order)
    tiled = placed.withColumn("part", F.spark_partition_id()).mapInArrow(number, _PLACED + ", cell bigint")
    folder = f"{path}/vectors/generation={generation}"
    tiled.write.mode("overwrite").parquet(folder)
    stored = spark.read.schema(_PLACED + ", cell bigint").parquet(folder)
    tiles = stored.groupBy("cell").agg(
        F.min("centre").alias("centre"), F.count("*").alias("rows"), F.min("gap").alias("nearest"),
        F.max("gap").alias("farthest"), F.sum("gap").alias("gaps"),
    )
    listed = tiles.select(F.lit(generation).alias("generation"), "cell", "centre", "rows", "nearest", "farthest", "gaps")
    listed.coalesce(1).write.mode("append").parquet(f"{path}/tiles")


def read_clusters(spark: SparkSession, path: str) -> Clusters:
    """The stored index of all generations. A search reads only the row groups of the tiles that it probes."""
    tiles = spark.read.schema(_TILES).parquet(f"{path}/tiles").orderBy("cell").toArrow()  # one row for each tile
    vectors = spark.read.schema(_STORED).parquet(f"{path}/vectors")
    generations = sorted(set(tiles.column("generation").to_pylist()))
    listed = vectors.where(F.col("generation").isin(generations)).drop("generation")
    column = lambda name: tiles.column(name).to_numpy()
    return Clusters(
        listed, _read_centres(spark, path), *map(column, ("cell", "centre", "rows", "nearest", "farthest"))
    )


def build_clusters(vectors: DataFrame, cells: int = 16, seed: int = 7, **fit) -> Clusters:
    """``write_clusters`` into the shared folder, and ``read_clusters`` from there."""
    path = scratch_path(vectors.sparkSession, "clusters")
    write_clusters(vectors, path, cells, seed, **fit)
    return read_clusters(vectors.sparkSession, path)


def _cluster_probes(queries: DataFrame, index: Clusters, probes: int, rest: bool) -> DataFrame:
    """List, once per query, the tiles around its ``probes`` nearest centres, or all other tiles within its bound."""
    centres, centre_of, tiles = index.centres, index.centre_of, index.tiles
    nearest, farthest = index.nearest, index.farthest
    used = np.zeros(len(centres), bool)
    used[centre_of] = True
    # Distances come from a difference of squares; its rounding error grows with the lengths, not the distance.
    error = 1e-7 * max(1, centres.shape[1]) ** 0.5 if centres.size else 0.0
    longest = np.sqrt((centres**2).sum(1).max()) if centres.size else 0.0

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, bounds = matrix(batch.column("embedding")), _bounds(batch.column("bound"))
            for part in steps(len(block), max(len(centres), len(tiles))):
                gaps = cross_distance(block[part], centres)
                ranked = np.where(used, gaps, np.inf)
                near = np.zeros(gaps.shape, dtype=bool)
                np.put_along_axis(near, np.argsort(ranked, axis=1, kind="stable")[:, :probes], True, axis=1)
                chosen = near[:, centre_of]
                if rest:
                    away = gaps[:, centre_of]
                    least = np.maximum(np.maximum(nearest - away, away - farthest), 0.0)
                    slack = error * (np.sqrt((block[part].astype(np.float64) ** 2).sum(1)) + longest)
                    reach = np.sqrt(bounds[part]) * (1 + 1e-6) + slack
                    chosen = ~chosen & (least <= reach[:, None])
                row, tile = np.nonzero(chosen)
                ends = np.searchsorted(row, np.arange(len(gaps) + 1)).astype(np.int32)
                own = batch.slice(part.start, len(gaps))
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("query_id"), own.column("embedding"),
                        pa.ListArray.from_arrays(ends, pa.array(tiles[tile], pa.int64())), own.column("bound"),
                    ],
                    names=_ASKED,
                )

    return queries.select("query_id", "embedding", "bound").mapInArrow(
        pair, "query_id string, embedding array<float>, cells array<bigint>, bound double"
    )


def knn_clusters(
    queries: DataFrame,
    index: Clusters,
    k: int,
    probes: int = 4,
    complete: bool = True,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """Top-k through the clusters.

    First the tiles of the ``probes`` nearest centres of each query. With ``complete``
    the result is exact: every other tile that can hold a vector within the k-th
    distance found so far is searched as well. Without, it is approximate. A query and
    its vector are stored once in each step, however many tiles it asks for.
    """
    queries = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    sizes = (max_broadcast_bytes, tile_bytes)
    near = materialize(_cluster_probes(queries.select("*", _unbounded()), index, probes, rest=False), "probes")
    first = top_hits(search_cells(near, index.vectors, k, *sizes), k).drop("rank")
    if not complete:
        return top_hits(first, k)
    first = materialize(first, "first-hits")
    far = materialize(_cluster_probes(_kth_distance(queries, first, k), index, probes, rest=True), "probes")
    return top_hits(first.unionByName(search_cells(far, index.vectors, k, *sizes)), k)


# --- hashed index ---------------------------------------------------------


@dataclass(frozen=True)
class Hashed:
    """Vectors stored by the bucket they fall into, once for each hash table."""

    vectors: DataFrame
    model: BucketedRandomProjectionLSHModel
    occupied: DataFrame  # (cell) of the first table
    first_bucket: int  # of the first table
    last_bucket: int


_BUCKETS = 1 << 32  # cell = table number * _BUCKETS + bucket
_HASHED = "cell bigint, faiss_id bigint, embedding array<float>"


def _features(column: str) -> Column:
    return array_to_vector(F.col(column).cast("array<double>")).alias("features")


def _buckets(df: DataFrame, id_column: str, model: BucketedRandomProjectionLSHModel) -> DataFrame:
    """(id, embedding, buckets): the bucket of every vector in each hash table."""
    held = df.select(id_column, "embedding", _features("embedding")).where("embedding is not null")
    tables = [vector_to_array(F.col("hashes")[i])[0].cast("bigint") for i in range(model.getNumHashTables())]
    return model.transform(held).select(id_column, "embedding", F.array(*tables).alias("buckets"))


def _in_tables(df: DataFrame, id_column: str) -> DataFrame:
    """One row per table, in the cell of the table's bucket."""
    return df.select(F.posexplode("buckets").alias("table", "bucket"), id_column, "embedding").select(
        (F.col("table") * F.lit(_BUCKETS) + F.col("bucket")).alias("cell"), id_column, "embedding"
    )


def write_hashed(
    vectors: DataFrame, path: str, dim: int, tables: int = 4, width: float = 0.1, seed: int = 7
) -> None:
    """Store every vector in its bucket of each hash table, and the hashing beside them.

    Rows are range-partitioned and sorted by (cell, id): a bucket that holds much of the data is
    spread over several files, and a filter on cells skips files and row groups by their statistics.
    """
    spark = vectors.sparkSession
    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed
    )
    blank = spark.createDataFrame([([0.0] * dim,)], "embedding array<float>")  # fitting only asks for the dimension
    model = lsh.fit(blank.select(_features("embedding")))
    placed = _in_tables(_buckets(vectors, "faiss_id", model), "faiss_id")
    spread = placed.repartitionByRange("cell", "faiss_id").sortWithinPartitions("cell", "faiss_id")
    spread.write.parquet(f"{path}/vectors")
    stored = spark.read.schema(_HASHED).parquet(f"{path}/vectors").where(F.col("cell") < _BUCKETS // 2)
    stored.select("cell").distinct().write.parquet(f"{path}/occupied")
    model.save(f"{path}/model")


def read_hashed(spark: SparkSession, path: str) -> Hashed:
    """The stored index; a search reads only the buckets that it probes."""
    vectors = spark.read.schema(_HASHED).parquet(f"{path}/vectors")
    occupied = spark.read.schema("cell bigint").parquet(f"{path}/occupied")
    low, high = occupied.agg(F.min("cell"), F.max("cell")).first()
    return Hashed(vectors, BucketedRandomProjectionLSHModel.load(f"{path}/model"), occupied, low or 0, high or 0)


def build_hashed(vectors: DataFrame, dim: int, tables: int = 4, width: float = 0.1, seed: int = 7) -> Hashed:
    """``write_hashed`` into the shared folder, and ``read_hashed`` from there."""
    path = scratch_path(vectors.sparkSession, "hashed")
    write_hashed(vectors, path, dim, tables, width, seed)
    return read_hashed(vectors.sparkSession, path)


def knn_hashed(
    queries: DataFrame,
    index: Hashed,
    k: int,
    complete: bool = True,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    tile_bytes: int = TILE_BYTES,
) -> DataFrame:
    """Top-k through the hash tables.

    First the vectors that share a bucket with the query in some table. With
    ``complete`` the result is exact: a vector within distance r of the query
    also lies within r along the first direction, so the buckets of the first
    table in that range are searched as well. Without, it is approximate.
    """
    sizes = (max_broadcast_bytes, tile_bytes, True)
    hashed = materialize(_buckets(queries, "query_id", index.model), "asked")
    own = F.transform("buckets", lambda b, i: i * F.lit(_BUCKETS) + b).alias("cells")
    found = search_cells(hashed.select("query_id", "embedding", own, _unbounded()), index.vectors, k, *sizes)
    first = top_hits(found.dropDuplicates(["query_id", "faiss_id"]), k).drop("rank")
    if not complete:
        return top_hits(first, k)
    first = materialize(first, "first-hits")
    bounded = _kth_distance(hashed.select("query_id", F.col("buckets")[0].alias("own")), first, k)
    others = buckets_within_reach(bounded, index)
    listed = others.groupBy("query_id").agg(F.collect_list("cell").alias("cells"), F.first("bound").alias("bound"))
    far = materialize(hashed.select("query_id", "embedding").join(listed, "query_id"), "probes")
    both = first.unionByName(search_cells(far, index.vectors, k, *sizes))
    return top_hits(both.dropDuplicates(["query_id", "faiss_id"]), k)


def buckets_within_reach(bounded: DataFrame, index: Hashed, bins: int = 1024) -> DataFrame:
    """Join the interval of buckets that each query can reach with the buckets that hold something.

    ``bounded`` has query_id, own (its bucket in the first table) and bound. The buckets are cut into equal
    ranges, an interval is joined by the ranges it touches, and what lies outside it is dropped. No vector is
    moved. Returns (query_id, cell, bound), without the query's own bucket.
    """
    first, last = index.first_bucket, index.last_bucket
    width = max(1, -(-(last - first + 1) // bins))
    span = (F.sqrt("bound") * (1 + 1e-6) + 1e-6) / F.lit(index.model.getBucketLength())
    low = F.when(F.col("bound").isNull(), F.lit(first)).otherwise(F.greatest(F.floor(F.col("own") - span), F.lit(first)))
    high = F.when(F.col("bound").isNull(), F.lit(last)).otherwise(F.least(F.ceil(F.col("own") + span), F.lit(last)))
    bin_of = lambda bucket: F.floor((bucket - first) / F.lit(width)).cast("bigint")
    asked = bounded.withColumns({"low": low, "high": high}).where(F.col("low") <= F.col("high"))
    asked = asked.withColumn("bin", F.explode(F.sequence(bin_of(F.col("low")), bin_of(F.col("high")))))
    held = index.occupied.withColumn("bin", bin_of(F.col("cell")))
    inside = F.col("cell").between(F.col("low"), F.col("high")) & (F.col("cell") != F.col("own"))
    return asked.join(held, "bin").where(inside).select("query_id", "cell", "bound")


# --- how good an approximate search is ------------------------------------


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, per query."""
    found = approximate.select("query_id", "faiss_id", F.lit(1).alias("found"))
    return (
        exact.select("query_id", "faiss_id")
        .join(found, ["query_id", "faiss_id"], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("wanted"), F.count("found").alias("found"))
        .withColumn("recall", F.col("found") / F.col("wanted"))
    )


def compared_in_clusters(queries: DataFrame, index: Clusters, probes: int) -> DataFrame:
    """How many vectors the ``probes`` nearest clusters of each query hold: (query_id, compared)."""
    asked = _cluster_probes(queries.select("query_id", "embedding", _unbounded()), index, probes, rest=False)
    return _compared(asked.select("query_id", F.explode("cells").alias("cell")), index.vectors)


def compared_in_tables(queries: DataFrame, index: Hashed) -> DataFrame:
    """How many vectors each query meets in its buckets, in every table anew: (query_id, compared)."""
    return _compared(_in_tables(_buckets(queries, "query_id", index.model), "query_id"), index.vectors)


def _compared(asked: DataFrame, held: DataFrame) -> DataFrame:
    sizes = held.groupBy("cell").agg(F.count("*").alias("n"))
    met = asked.select("query_id", "cell").join(sizes, "cell", "left")
    return met.groupBy("query_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
