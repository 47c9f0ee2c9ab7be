"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its smallest neighbour, or to itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m"), F.col("a").alias("v"))
    return moved.unionByName(least.select("m", F.col("b").alias("v"))).where("m < v").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``v, component`` for every node of ``edges`` (two columns of longs): the smallest node it reaches.

    Edges with a null end or two equal ends are ignored. The rounds grow with the logarithm of
    the nodes; each is written to the shared folder, and only a count and a sum of its rows reach the driver.
    """
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    now = staged(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    before = None
    while True:
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not row.n:
            break
        if (row.n, row.x) == before:
            break
        before = (row.n, row.x)
        now = staged(_small_star(staged(_large_star(now), "large-star")), "small-star")
    stars = now.select(F.col("b").alias("v"), F.col("a").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("v"), "component").distinct())
