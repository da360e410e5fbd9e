"""Exact top-k of one block of queries against a stream of vector batches.

Runs inside Spark tasks. Candidates are found with a float32 product whose
rounding error is bounded, and every candidate within that bound is scored
again in double precision, dimension by dimension, so that the scores and the
order equal those of ``functions.vectors.squared_distance``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CELLS_PER_STEP = 2_000_000
_NO_ID = np.iinfo(np.int64).max


def matrix(column) -> np.ndarray:
    """An Arrow list column as a (rows, dim) float32 matrix.

    Fails on null vectors, unequal lengths and components that are null or not finite: one of them would
    spoil the error bound of a whole block, or shift the values of others.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count or len(pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("vectors must not be null and must have equal lengths")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    if not np.isfinite(flat).all():
        raise ValueError("vectors must have finite components only")
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def steps(rows: int, width: int) -> Iterator[slice]:
    """Slices of so many rows that a matrix of ``width`` columns stays small."""
    step = max(1, _CELLS_PER_STEP // max(1, width))
    return (slice(low, min(low + step, rows)) for low in range(0, rows, step))


def cross_distance(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of two small matrices, in double precision."""
    left, right = left.astype(np.float64), right.astype(np.float64)
    squares = (left**2).sum(1)[:, None] + (right**2).sum(1)[None, :] - 2 * left @ right.T
    return np.sqrt(np.maximum(squares, 0.0))


class Nearest:
    """The k nearest vectors seen so far for each of a block of queries; ties go to the lower id.

    ``bounds`` are scores beyond which a query needs no vector. With ``distinct``, a vector that is offered to a
    query again does not count twice.
    """

    def __init__(self, queries: np.ndarray, k: int, bounds: np.ndarray | None = None, distinct: bool = False):
        self.queries = queries
        self.k = k
        self.distinct = distinct
        self.bounds = np.full(len(queries), np.inf) if bounds is None else bounds
        self.squares = (queries.astype(np.float64) ** 2).sum(1)
        self.scores = np.full((len(queries), k), np.inf)
        self.ids = np.full((len(queries), k), _NO_ID, dtype=np.int64)

    def offer(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Compare vectors with all queries, or with those in ``rows``."""
        rows = np.arange(len(self.queries)) if rows is None else rows
        if not len(ids) or not len(rows):
            return
        squares = (vectors.astype(np.float64) ** 2).sum(1)
        reach = np.sqrt(squares.max()) + np.sqrt(self.squares[rows].max())
        slack = (vectors.shape[1] + 8) * 2.0**-23 * reach**2
        step = max(1, _CELLS_PER_STEP // len(ids))
        for low in range(0, len(rows), step):
            self._offer_rows(rows[low : low + step], ids, vectors, squares, slack)

    def _offer_rows(self, rows, ids, vectors, squares, slack):
        rough = (self.queries[rows] @ vectors.T) * np.float32(-2)
        rough += squares.astype(np.float32)[None, :]
        rough += self.squares[rows].astype(np.float32)[:, None]
        limit = np.minimum(self.scores[rows, -1], self.bounds[rows])
        unfilled = np.isinf(limit)
        if unfilled.any() and len(ids) > self.k:
            kth = np.partition(rough[unfilled], self.k - 1, axis=1)[:, self.k - 1]
            limit[unfilled] = kth + slack
        query, vector = np.nonzero(rough <= (limit + slack)[:, None])
        query = rows[query]
        score = self._exact(query, vectors, vector)
        keep = score <= np.minimum(self.scores[query, -1], self.bounds[query])
        if keep.any():
            self._merge(query[keep], score[keep], ids[vector[keep]])

    def _exact(self, query, vectors, vector):
        total = np.zeros(len(query))
        for dim in range(vectors.shape[1]):
            gap = self.queries[query, dim].astype(np.float64) - vectors[vector, dim]
            total += gap * gap
        return total

    def _merge(self, query, score, ids):
        touched = np.unique(query)
        query = np.concatenate([query, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.scores[touched].ravel()])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((ids, score, query))
        query, score, ids = query[order], score[order], ids[order]
        if self.distinct:
            again = (query[1:] == query[:-1]) & (ids[1:] == ids[:-1]) & (ids[1:] != _NO_ID)
            new = np.concatenate([[True], ~again])
            query, score, ids = query[new], score[new], ids[new]
        first = np.searchsorted(query, touched)
        best = (first[:, None] + np.arange(self.k)[None, :]).ravel()
        self.scores[touched] = score[best].reshape(-1, self.k)
        self.ids[touched] = ids[best].reshape(-1, self.k)

    def hits(self, part: slice = slice(None)):
        """(query row, id, score) of everything kept, or of the queries in ``part``."""
        row, place = np.nonzero(np.isfinite(self.scores[part]))
        row += part.start or 0
        return row, self.ids[row, place], self.scores[row, place]
