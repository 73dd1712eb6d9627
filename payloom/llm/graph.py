"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, cut, joined_hot

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges(u, v).

    Each round points nodes at the smallest neighbour: first those above a node (large star), then the rest (small
    star), until each node has one link, to a node that has none upwards. Groups are never gathered: the smallest
    neighbour is an aggregate, and goes back to a node of very many edges by a broadcast, to the others by a shuffle.
    Rounds grow with the logarithm of the longest path.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        by = both.groupBy("u").agg(F.count("*").alias("n"), F.count_if(F.col("v") < F.col("u")).alias("up"))
        n, most, unsettled = by.agg(F.sum("n"), F.max("n"), F.count_if((F.col("up") > 0) & (F.col("n") > 1))).first()
        if not unsettled:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select("v", "v").distinct().toDF("node", "component"))
        large_from = max(256, n // HOT)
        hot = large_from if most > large_from else None
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = joined_hot(both, least, ["u"], hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # a node has no more edges here than it had before
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = joined_hot(large, least, ["u"], hot)
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError("components did not settle")
