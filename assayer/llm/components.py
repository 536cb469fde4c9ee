"""Connected components of a graph of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end of distinct edges (a, b), a > b, has no other edge."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), where component is the smallest node reachable.

    Alternating star contraction: every node links the larger of its neighbours to its smallest neighbour, then the smaller
    ones, until each node hangs on its component's smallest. A logarithmic number of rounds, each of joins on nodes; the
    edges never grow in number. Each round's edges are cut from their lineage, which deletes those of the round before, and only
    whether all edges are stars yet reaches the driver; edges that are stars from the start need no round.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(now):
        both = now.union(now.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m")).where("a <> b")
        after = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        forget(now)
        now = after
    members = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return members.union(members.select(F.col("component").alias("node"), "component").distinct())
