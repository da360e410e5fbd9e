"""8-bit scalar quantisation of vectors, one range per dimension."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 255  # fixed value: codes run from 0 to 255


def ranges(vectors: DataFrame) -> DataFrame:
    """One row: the smallest and the largest value of each dimension."""
    features = array_to_vector(F.col("embedding").cast("array<double>"))
    return (
        vectors.where(F.col("embedding").isNotNull())
        .select(Summarizer.metrics("min", "max").summary(features).alias("s"))
        .select(vector_to_array("s.min").alias("low"), vector_to_array("s.max").alias("high"))
    )


def encode(vector: Column, low: Column, high: Column) -> Column:
    span = F.zip_with(low, high, lambda a, b: F.struct(a.alias("low"), (b - a).alias("span")))
    return F.zip_with(
        vector.cast("array<double>"),
        span,
        lambda x, r: F.when(r["span"] > 0, F.floor((x - r["low"]) / r["span"] * LEVELS))
        .otherwise(0)
        .cast("int"),
    )


def decode(codes: Column, low: Column, high: Column) -> Column:
    """The middle of each code's step; the only value where a dimension is constant."""
    span = F.zip_with(low, high, lambda a, b: F.struct(a.alias("low"), (b - a).alias("span")))
    return F.zip_with(
        codes, span, lambda c, r: r["low"] + (c + F.lit(0.5)) / LEVELS * r["span"]
    )


def sq8_vectors(vectors: DataFrame) -> DataFrame:
    """Add ``codes``, and ``error``, the largest deviation after decoding.

    The ranges are one row of 2 x dim numbers, read as a scalar subquery,
    so the vectors are scanned twice and never shuffled.
    """
    found = ranges(vectors).select(F.struct("low", "high")).scalar()
    low, high = F.col("_ranges.low"), F.col("_ranges.high")
    coded = vectors.withColumn("_ranges", found).withColumn(
        "codes", encode(F.col("embedding"), low, high)
    )
    back = decode(F.col("codes"), low, high)
    gaps = F.zip_with(F.col("embedding").cast("array<double>"), back, lambda x, y: F.abs(x - y))
    return coded.withColumn("error", F.array_max(gaps)).drop("_ranges")
