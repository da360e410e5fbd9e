"""Texts to unit vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]


def embed_with(
    df: DataFrame, load: Callable[[], Encoder], text: str = "text", batch_rows: int = 256
) -> DataFrame:
    """Add ``embedding``, the unit vector that a user's encoder gives for ``text``.

    ``load`` is called once per task and returns the encoder, so that a model is
    read once per task and not once per batch. Null texts count as empty.
    """
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
        + ["embedding array<float>"]
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for batch in batches:
            for at in range(0, len(batch), batch_rows):
                part = batch.iloc[at : at + batch_rows].copy()
                vectors = np.asarray(encoder(part[text].fillna("").tolist()), dtype=np.float64)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                unit = vectors / np.where(norms > 0, norms, 1.0)
                part["embedding"] = list(unit.astype(np.float32))
                yield part

    return df.mapInPandas(encode, schema)


def hash_embed(df: DataFrame, text: str = "text", dim: int = 64) -> DataFrame:
    """Add ``embedding``: hashed word counts scaled to unit length.

    The stand-in for a neural encoder. A word's bucket is the first 24 bits of its MD5 modulo ``dim``; each task
    hashes the words it meets once, and counts the buckets of a text in one pass. Null texts count as empty,
    and a text without words has only zeros.
    """

    @F.arrow_udf("array<double>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = _Buckets(dim)
        for texts in batches:
            rows = np.zeros((len(texts), dim))
            for row, value in zip(rows, texts, strict=True):
                found = [buckets[word] for word in (value.as_py() or "").split()]
                if found:
                    row += np.bincount(found, minlength=dim)
            norms = np.sqrt((rows * rows).sum(1, keepdims=True))
            unit = rows / np.where(norms > 0, norms, 1.0)
            starts = np.arange(0, unit.size + 1, dim, dtype=np.int32)
            yield pa.ListArray.from_arrays(starts, pa.array(unit.ravel()))

    return df.withColumn("embedding", embed(F.col(text)))


class _Buckets(dict):
    """The bucket of each word met lately."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        if len(self) >= 100_000:
            self.clear()
        digest = hashlib.md5(word.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        self[word] = bucket = int.from_bytes(digest[:3], "big") % self.dim
        return bucket
