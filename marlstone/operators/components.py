"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is a grouped minimum (partially aggregated, so a hub is no hot task) and one join on the node; O(log n) rounds for any shape.
The loop's tables are written to the shared folder, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of u is linked with the least of u and its neighbours. Small: every smaller or equal one is."""
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    out = near.join(least, "u")
    if large:
        return out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    linked = out.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, component (the least node of it) for all nodes that occur in an edge.

    Self-links count as an edge of the node with itself; links with a null end are left out; repeated and reversed links count once.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    now = pairs.where(F.col("u") != F.col("v"))
    before = None
    for _ in range(rounds):
        last, now = now, cut(_star(_star(now, True), False), "cc")
        release(last)
        # the table has settled when a round leaves its number of rows and its checksum as they were
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == tuple(mark):
            break
        before = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    every = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    return every.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
