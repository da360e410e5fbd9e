"""Cutting texts into overlapping word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovescan.functions.text import NOT_BLANKS, words
from trovescan.functions.vectors import bind


def _windows(n: Column, size: int, stride: int) -> Column:
    """How many windows a text of n words gives, for n > 0."""
    to_the_end = F.ceil((n - size) / F.lit(stride))
    starting_inside = F.ceil(n / F.lit(stride)) - 1  # fewer only if stride > size
    return F.greatest(F.least(to_the_end, starting_inside), F.lit(0)).cast("int") + 1


def chunk_count(text: Column, size: int = 240, stride: int = 160) -> Column:
    """How many rows ``chunk_documents`` makes of a text. Reads the text once."""
    count = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NOT_BLANKS))
    return bind(count, lambda n: F.when(n > 0, _windows(n, size, stride)).otherwise(0))


def chunk_documents(
    docs: DataFrame, text: str = "text", size: int = 240, stride: int = 160
) -> DataFrame:
    """One row per window of ``size`` words, a new one every ``stride`` words.

    The last window is the first that reaches the end of the text, so n words
    give none for n = 0, one up to ``size``, then ceil((n - size) / stride) + 1
    (or as many as start inside the text, if ``stride`` exceeds ``size``).
    Replaces ``text`` by the window and adds ``chunk_no`` from 0. Narrow: keeps
    the partitioning and the order of the rows.
    """
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be positive")
    split = docs.withColumn("_words", words(F.col(text)))
    n = F.size("_words")
    windows = F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), _windows(n, size, stride) - 1),
            lambda i: F.array_join(F.slice("_words", i * stride + 1, F.lit(size)), " "),
        ),
    )
    kept = [c for c in docs.columns if c != text]
    return split.select(*kept, F.posexplode(windows).alias("chunk_no", text))
