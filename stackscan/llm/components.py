"""Connected components of a graph too large for one machine, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackscan.llm.common import join_hot, kept


def _lowest(edges: DataFrame) -> DataFrame:
    """Each edge (x, y) with ``m``, the lowest of x and all its neighbours y."""
    least = edges.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return join_hot(edges, least, ["x"], "y", salts=64, how="inner")


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) of every vertex of ``edges`` (a, b); a component is named by its lowest vertex.

    Rounds of two steps, until no edge changes: every vertex sends its larger neighbours, then its smaller
    ones, to the lowest vertex it knows. The number of rounds grows with the logarithm of a component's
    diameter. Each round's edges are written to the shared folder. Vertices without an edge to another
    one are left out.
    """
    now = kept(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x != y").distinct())
    seen = _print(now)
    while True:
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        large = _lowest(both).where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = _lowest(large)
        small = low.where("y != m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(low.select("x", F.col("m").alias("y")))
        now = kept(small.distinct())
        last, seen = seen, _print(now)
        if seen == last:
            lowest = now.select(F.col("y").alias("x"), "y")
            return now.union(lowest).distinct().select(F.col("x").alias("vertex"), F.col("y").alias("component"))
