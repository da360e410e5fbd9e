"""Blocks of vectors: a query set against all vectors, tile by tile."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovescan.operators.ids import attach_ids
from trovescan.session import materialize

#: Rows of a tile. A task holds one tile of each side, and the products of a part of the queries and a strip.
TILE_ROWS = 16_384
QUERY_ROWS = 2_048
STRIP_ROWS = 1_024


def numbered_vectors(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """(row, id, v, n): the vectors that take part, a row for each different (id, vector), and how often it occurs.

    Rows whose vector is null, empty, or holds a null or non-finite component (or, with ``nonzero``, only zeros) take no
    part; a null id does. Rows are numbered in the order of their ids, a null id first, so that ties by id are ties
    by number. The table is stored.
    """
    taken = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    taken = taken.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    if nonzero:
        taken = taken.where(F.exists("v", lambda x: x != 0))
    once = taken.groupBy("id", "v").agg(F.count("*").alias("n"))
    return materialize(attach_ids(materialize(once, "vectors"), ["id"], 0, "row"), "vectors")


def asked_vectors(queries: DataFrame, held: DataFrame) -> DataFrame:
    """Numbered queries with ``own``: the number of the vector they are, if no other row equals it, else -1."""
    same = held.where("n = 1").select(F.col("row").alias("own"), F.xxhash64("id", "v").alias("_at"), F.col("id").alias("_id"), F.col("v").alias("_v"))
    found = queries.withColumn("_digest", F.xxhash64("id", "v")).join(
        same, (F.col("_digest") == F.col("_at")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("v") == F.col("_v")), "left"
    )
    return found.select("row", "v", F.coalesce("own", F.lit(-1)).cast("long").alias("own"))


def told(found: DataFrame, queries: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the numbers found as ids, every row that a number stands for in its place.

    ``found`` has at most k numbers to a query. Equal rows follow each other; a query that occurs more than once, and so
    is a candidate of its own, counts one row less of itself, and is told as often as it occurs.
    """
    names = held.select(F.col("row").alias("vec"), F.col("id").alias("vec_id"), F.col("v").alias("vec_v"), F.col("n").alias("vec_n"))
    asked = queries.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("query_v"), F.col("n").alias("query_n"))
    shown = found.join(names, "vec").join(asked, "query")
    itself = F.col("query_id").eqNullSafe(F.col("vec_id")) & (F.col("query_v") == F.col("vec_v"))
    copies = F.least(F.col("vec_n") - itself.cast("long"), F.lit(k)).cast("int")
    shown = shown.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec", "copy")  # at most k * k rows
    ranked = shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    times = F.explode(F.sequence(F.lit(1), F.col("query_n").cast("int")))
    return ranked.withColumn("_time", times).select("query_id", "rank", "vec_id", "score")


def matrix(table: pa.Table | pa.RecordBatch, name: str = "v") -> np.ndarray:
    """A list column as a matrix; vectors of unequal lengths are an error."""
    column = table.column(name)
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(lists) == 0:
        return np.empty((0, 0))
    lengths = np.diff(lists.offsets.to_numpy())
    if lengths.min() != lengths.max():
        raise ValueError("vectors must have equal lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), int(lengths[0]))


def ids_of(table: pa.Table | pa.RecordBatch, name: str = "row") -> np.ndarray:
    return table.column(name).to_numpy()


def best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, id, score) triples the k best of each query: highest score, then smallest id."""
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    kept = place < k
    return q[kept], ids[kept], scores[kept]


def kth(q: np.ndarray, scores: np.ndarray, n: int, k: int, least: np.ndarray) -> np.ndarray:
    """Per query the k-th score of triples in the order of ``best``, or ``least`` if there are fewer."""
    counts = np.bincount(q, minlength=n)
    full = np.flatnonzero(counts >= k)
    out = least.copy()
    last = np.cumsum(counts)[full] - 1
    out[full] = np.maximum(out[full], scores[last])
    return out


def search_tiles(
    queries: DataFrame,
    vectors: DataFrame,
    k: int,
    search: Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]],
    score_type: str,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """Run ``search`` on every pair of a query tile and a vector tile, and merge the k best.

    Both tables have a ``row`` that is unique in them. Each side is dealt into tiles by a hash of it, so
    tiles have about ``tile_rows`` rows at any size of the tables; a row of one side is copied once for
    each tile of the other, which is what a block product costs. A pair of tiles returns at most k rows
    for a query. Returns query, vec (numbers of rows) and score, k of a query at most.
    """
    n_q = max(1, math.ceil(queries.count() / tile_rows))
    n_v = max(1, math.ceil(vectors.count() / tile_rows))

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        copies = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
        return df.select(F.pmod(F.xxhash64("row"), F.lit(n_own)).cast("int").alias(own), copies, *df.columns)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table({n: pa.array([], t) for n, t in zip(names, kinds, strict=True)})
        out = []
        for at in range(0, left.num_rows, QUERY_ROWS):
            part = left.slice(at, QUERY_ROWS)
            q, ids, scores = search(part, right)
            columns = zip((ids_of(part)[q], ids, scores), kinds, strict=True)
            out.append(pa.table([pa.array(c, kind) for c, kind in columns], names=names))
        return pa.concat_tables(out)

    names = ["query", "vec", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64() if score_type == "long" else pa.float64()]
    left = dealt(queries, "qt", n_q, "vt", n_v)
    right = dealt(vectors, "vt", n_v, "qt", n_q)
    found = (
        left.groupBy("qt", "vt")
        .cogroup(right.groupBy("qt", "vt"))
        .applyInArrow(run, f"query long, vec long, score {score_type}")
    )
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "vec", "score")
