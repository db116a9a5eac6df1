"""Connected components of an edge table, by alternating star contraction. Hubs are never gathered: each step is a minimum per node and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import settle


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: u, v (long). Returns node, root (the smallest node reachable) for every node that has a link to another.

    Large star: each node hands its larger neighbours to its smallest neighbour. Small star: each node hands itself and its smaller
    neighbours to the smallest. At the fixed point every edge leads to a root. Both keep what is connected and shorten paths, so
    the number of rounds grows with the logarithm of the longest path. Self-links and repeated rows are allowed.
    """
    big, small = F.greatest("u", "v"), F.least("u", "v")
    edges = settle(edges.where("u <> v").select(big.alias("u"), small.alias("v")).distinct(), "links")
    seen = _signature(edges)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        edges = settle(turned.where("u <> v").select(big.alias("u"), small.alias("v")).distinct(), "links")
        now = _signature(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
