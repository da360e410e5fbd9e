"""Nearest neighbours by a block product in eight bits (operator 9)."""

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

#: Pairs whose scores are computed at once.
_PAIRS = 65_536


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scales, lengths of the error) of the unit vectors: unit = scale * code + error."""
    unit = vectors / np.sqrt((vectors * vectors).sum(1))[:, None]
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - scale[:, None] * codes) ** 2).sum(1))
    return codes, scale, error


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of row pairs in double precision, summed in the order of the components."""
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for i in range(a.shape[1]):
        x, y = a[:, i], b[:, i]
        dot += x * y
        aa += x * x
        bb += y * y
    return np.clip(dot / (np.sqrt(aa) * np.sqrt(bb)), -1.0, 1.0)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """The k vectors of largest cosine for every query, without its own id.

    Tiles of both sides are turned into 8-bit codes, and the products of the codes (exact: their sums
    stay below 2 ** 24 up to 1040 dimensions, and are taken in double precision beyond) estimate every
    cosine with a proven error. A pair survives if its estimate plus the error reaches the k-th score so
    far, or the k-th lower bound of its strip. Survivors are scored again from the original vectors, so
    the result is exact; the best of all tiles are merged per query.

    Every row but the query's own is a candidate, also rows that share its id or equal it. Returns query_id, rank,
    vec_id, score (double); all candidates if there are fewer than k; ties go to the smaller id, a null id first.
    Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of unequal lengths
    are an error; an empty side gives no rows; other columns are not read.
    """
    held = numbered_vectors(vectors, id_col, vector_col, nonzero=True)
    asked = numbered_vectors(queries, id_col, vector_col, nonzero=True)

    def search(left: pa.Table, right: pa.Table):
        own, q, c_ids, c = ids_of(left, "own"), matrix(left).astype(float), ids_of(right), matrix(right).astype(float)
        if q.shape[1] != c.shape[1]:
            raise ValueError("vectors must have equal lengths")
        exact = np.float32 if q.shape[1] <= 1040 else np.float64
        q_codes, q_scale, q_error = quantise(q)
        c_codes, c_scale, c_error = quantise(c)
        bound = np.full(len(q), -np.inf)
        kept = (np.empty(0, int), np.empty(0, np.int64), np.empty(0))
        for at in range(0, len(c), STRIP_ROWS):
            s = slice(at, at + STRIP_ROWS)
            product = q_codes.astype(exact) @ c_codes[s].astype(exact).T
            estimate = product * q_scale[:, None] * c_scale[s][None, :]
            error = q_error[:, None] + c_error[s][None, :] + q_error[:, None] * c_error[s][None, :] + 1e-6
            estimate[own[:, None] == c_ids[s][None, :]] = -np.inf
            least = bound
            if estimate.shape[1] > k:
                least = np.maximum(bound, np.partition(estimate - error, -k, axis=1)[:, -k])
            i, j = np.nonzero((estimate + error >= least[:, None]) & (estimate > -np.inf))
            scores = [cosines(q[i[p : p + _PAIRS]], c[s][j[p : p + _PAIRS]]) for p in range(0, len(i), _PAIRS)]
            parts = (i, c_ids[s][j], np.concatenate(scores) if scores else np.empty(0))
            kept = best(*[np.concatenate(pair) for pair in zip(kept, parts, strict=True)], k)
            bound = kth(kept[0], kept[2], len(q), k, bound)
        return kept

    known = materialize(asked_vectors(asked, held), "queries")
    found = search_tiles(known, held.select("row", "v"), k, search, "double", tile_rows)
    return told(found, asked, held, k)


@query(
    """
    WITH v AS (
      SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(embedding) = len([x FOR x IN embedding IF isfinite(x)])
        AND len([x FOR x IN embedding IF x <> 0]) > 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
    ), r AS (
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
    )
    SELECT * FROM r WHERE rank <= 5
    """
)
def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every fiftieth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)
