"""Exact top-k inner products with norm order and residual bounds (operator 7)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trovescan.llm.registry import query, table
from trovescan.llm.tiles import (
    STRIP_ROWS,
    TILE_ROWS,
    asked_vectors,
    best,
    ids_of,
    kth,
    matrix,
    numbered_vectors,
    search_tiles,
    told,
)
from trovescan.session import materialize

#: The longest vectors, which give every query a first bound on its k-th score. At most this many rows travel.
SEEDS = 1_024
#: Shares of the dimensions after which partial sums are tested.
STEPS = (0.25, 0.5)
#: Sums of whole numbers below this are exact in double precision.
_EXACT = 2.0**53


def _rotation(vectors: DataFrame) -> np.ndarray | None:
    """Right singular vectors of all vectors, from the sums of their outer products (dim x dim numbers)."""

    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch).astype(float)
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["g"])

    cells = vectors.select("v").mapInArrow(partial, "g array<double>").select(F.posexplode("g").alias("cell", "x"))
    sums = cells.groupBy("cell").agg(F.sum("x").alias("x")).orderBy("cell").toPandas()["x"].to_numpy()
    if not len(sums):
        return None
    dim = int(round(np.sqrt(len(sums))))
    return np.linalg.svd(sums.reshape(dim, dim))[2].T


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole-number inner products, exact: in double precision while the sums stay small enough."""
    if np.sqrt((q * q).sum(1).max() * (c * c).sum(1).max()) < _EXACT / 4:
        return np.rint(q @ c.T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T


def _tail(rotated: np.ndarray, at: int) -> np.ndarray:
    return np.sqrt((rotated[:, at:] ** 2).sum(1))


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float | None = None,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """The k vectors with the largest inner products for every query, exactly, without its own id.

    ``scale`` turns components into whole numbers, floor(scale * x); without it they must be whole.
    Vectors are rotated onto the singular vectors of the whole table, so that the first dimensions hold
    most of each product. Tiles of vectors are processed by descending length, in strips: a query leaves
    a tile when its length times the strip's greatest length cannot reach its k-th score so far, and a
    strip when its partial sum plus the product of the residual lengths (Cauchy-Schwarz) cannot. What
    remains is computed from the whole numbers themselves. The longest vectors (a fixed number) give every query its first bound.

    Every row but the query's own is a candidate, also rows that share its id or equal it. Returns query_id, rank,
    vec_id, score (long); all candidates if there are fewer than k; ties go to the smaller id, a null id first.
    Vectors that are null, empty or hold null or non-finite components take no part; vectors of unequal lengths are an
    error; an empty side gives no rows; other columns are not read.
    """

    def whole(df: DataFrame) -> DataFrame:
        v = numbered_vectors(df, id_col, vector_col)
        return v if scale is None else v.withColumn("v", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))

    stored, asked = whole(vectors), whole(queries)
    rotation = _rotation(stored)
    if rotation is None:
        rotation = np.empty((0, 0))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    longest = stored.orderBy(length.desc(), "row").limit(SEEDS).toArrow()
    seed_ids, seeds = ids_of(longest), matrix(longest).astype(float)

    def first_bounds(batches):
        for batch in batches:
            own, q = ids_of(batch, "own"), matrix(batch).astype(float)
            bound = np.full(len(own), np.iinfo(np.int64).min)
            if len(own) and len(seed_ids) > k:
                scores = _products(q, seeds)
                scores[own[:, None] == seed_ids[None, :]] = np.iinfo(np.int64).min
                bound = np.partition(scores, -k, axis=1)[:, -k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bound, pa.int64())], names=["row", "v", "own", "bound"])

    known = asked_vectors(asked, stored)
    bounded = materialize(known.mapInArrow(first_bounds, "row long, v array<double>, own long, bound long"), "queries")

    def search(left: pa.Table, right: pa.Table):
        own, q, bound = ids_of(left, "own"), matrix(left).astype(float), ids_of(left, "bound")
        c_ids, c = ids_of(right), matrix(right).astype(float)
        if q.shape[1] != c.shape[1]:
            raise ValueError("vectors must have equal lengths")
        order = np.argsort(-(c * c).sum(1), kind="stable")
        c_ids, c = c_ids[order], c[order]
        q_rot, c_rot, dim = q @ rotation, c @ rotation, c.shape[1]
        q_len, c_len = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
        steps = [max(1, int(dim * s)) for s in STEPS]
        q_tails = [_tail(q_rot, s) for s in steps]
        held = (np.empty(0, int), np.empty(0, np.int64), np.empty(0, np.int64))
        for at in range(0, len(c), STRIP_ROWS):
            strip = slice(at, at + STRIP_ROWS)
            slack = 1e-9 * (q_len * c_len[at] + 1)
            rows = np.flatnonzero(q_len * c_len[at] + slack >= bound)
            if not len(rows):
                break
            done = 0
            sums = np.zeros((len(rows), len(c[strip])))
            for step, tails in zip(steps, q_tails, strict=True):
                sums += q_rot[rows, done:step] @ c_rot[strip, done:step].T
                done = step
                reach = sums + tails[rows][:, None] * _tail(c_rot[strip], step)[None, :] + slack[rows][:, None]
                left_over = (reach >= bound[rows][:, None]).any(1)
                rows, sums = rows[left_over], sums[left_over]
                if not len(rows):
                    break
            if not len(rows):
                continue
            scores = _products(q[rows], c[strip])
            alive = (scores >= bound[rows][:, None]) & (own[rows][:, None] != c_ids[strip][None, :])
            i, j = np.nonzero(alive)
            parts = (rows[i], c_ids[strip][j], scores[i, j])
            held = best(*[np.concatenate(pair) for pair in zip(held, parts, strict=True)], k)
            bound = kth(held[0], held[2], len(q), k, bound)
        return held

    found = search_tiles(bounded, stored.select("row", "v"), k, search, "long", tile_rows)
    return told(found, asked, stored, k)


@query(
    """
    WITH v AS (
      SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) = len([x FOR x IN embedding IF isfinite(x)])
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
    ), r AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
    )
    SELECT * FROM r WHERE rank <= 20
    """
)
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer inner products of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), 20, scale=64.0)
