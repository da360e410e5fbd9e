"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovescan.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in ``links`` (a, b: bigint); the component is its smallest node.

    Large-star and small-star steps in turn: every node points its larger neighbours, then its smaller
    ones, at the smallest it knows, until nothing changes. A step is a minimum per node and a join; a
    node with many neighbours is never gathered, and each step is written to the shared folder.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    while True:
        before = edges
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = (
            both.join(least, F.col("a") == F.col("n")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least.withColumnRenamed("a", "n"), F.col("a") == F.col("n"))
        small = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), "m"), F.struct("a", "m"))).alias("e"))
        edges = materialize(small.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct(), "edges")
        if _signature(before) == _signature(edges):
            break
    roots = edges.select(F.col("b").alias("a")).distinct()
    return edges.union(roots.select("a", "a")).toDF("node", "component")


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
