"""Connected components by alternating stars, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import landed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Per vertex of ``edges`` (a, b) its component's smallest vertex: (id, comp).

    Every step is a minimum per vertex, combined before the shuffle, and a join
    back, so a vertex with any number of edges is never in one group. Edges
    become stars around the smallest vertex in a number of steps that grows
    with the logarithm of the vertices. Self edges count as vertices; an empty
    table gives an empty one.
    """
    named = edges.select(F.col("a"), F.col("b"))
    loops = named.filter("a = b").select(F.col("a").alias("id"), F.col("a").alias("comp"))
    cur = landed(named.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while state != (now := _state(cur)):
        state = now
        # Large star: each vertex hands its larger neighbours to its smallest.
        both = cur.union(cur.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = landed(large, "large")
        # Small star: each vertex and its smaller neighbours go to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        cur = landed(small.filter("a <> b").distinct(), "small")
    stars = cur.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    roots = cur.select(F.col("b").alias("id"), F.col("b").alias("comp"))
    return stars.union(roots).union(loops).groupBy("id").agg(F.min("comp").alias("comp"))
