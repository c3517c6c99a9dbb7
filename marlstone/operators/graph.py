"""The link graph: edges, degrees, ranks, neighbourhoods. Each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut, release


def edge_build(links: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b) of links resolved by name, without loops. links: node, name; names: name, node (one owner each)."""
    return links.join(names.withColumnRenamed("node", "b"), "name").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """node, rank divided by the largest. Rank of nodes without links out is spread over all nodes.

    Nodes without any link all have one rank, which is carried as a number: the rounds run over linked nodes only.
    """
    edges = cut(edges.select("a", "b").distinct(), "edges")
    out = edges.groupBy("a").agg(F.count("*").alias("out"))
    size = nodes.count()
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().join(nodes.select("node").distinct(), "node", "left_semi")
    now = cut(ends.join(out.withColumnRenamed("a", "node"), "node", "left").withColumn("rank", F.lit(1.0 / max(size, 1))), "rank")
    lone, alone = size - now.count(), 1.0 / max(size, 1)
    for _ in range(rounds if lone < size else 0):
        sent = edges.join(now.select(F.col("node").alias("a"), (F.col("rank") / F.col("out")).alias("share")), "a").groupBy("b").agg(F.sum("share").alias("got"))
        dangling = (now.where(F.col("out").isNull()).agg(F.sum("rank")).first()[0] or 0.0) + lone * alone
        alone = (1 - damping + damping * dangling) / size
        before = now
        # a round reads the one before twice, so each is written once
        now = cut(now.join(sent.withColumnRenamed("b", "node"), "node", "left").select("node", "out", (F.lit(alone) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")), "rank")
        release(before)
    top = max(now.agg(F.max("rank")).first()[0] or 0.0, alone if lone else 0.0) or 1.0
    return nodes.select("node").join(now.select("node", "rank"), "node", "left").select("node", (F.coalesce("rank", F.lit(alone)) / top).alias("rank"))


def hits(nodes: DataFrame, edges: DataFrame, rounds: int = 12) -> DataFrame:
    """node, hub, authority, each divided by its largest; authority first in each round, both of length one."""
    edges = cut(edges.select("a", "b").distinct(), "edges")
    now = cut(nodes.select("node", F.lit(1.0).alias("hub"), F.lit(1.0).alias("authority")), "hits")

    def step(now: DataFrame, from_: str, to: str, give: str, get: str) -> DataFrame:
        got = edges.join(now.select(F.col("node").alias(from_), F.col(give).alias("v")), from_).groupBy(to).agg(F.sum("v").alias("got"))
        raw = cut(now.drop(get).join(got.withColumnRenamed(to, "node"), "node", "left").withColumn(get, F.coalesce("got", F.lit(0.0))).drop("got"), "hits")
        norm = raw.agg(F.sqrt(F.sum(F.col(get) * F.col(get))).alias("_n"))
        return raw.crossJoin(F.broadcast(norm)).withColumn(get, F.when(F.col("_n") > 0, F.col(get) / F.col("_n")).otherwise(F.col(get))).drop("_n")

    for _ in range(rounds):
        now = step(step(now, "a", "b", "hub", "authority"), "b", "a", "authority", "hub")
    top = now.agg(F.max("hub").alias("_h"), F.max("authority").alias("_a"))
    return now.crossJoin(F.broadcast(top)).select("node", (F.col("hub") / F.col("_h")).alias("hub"), (F.col("authority") / F.col("_a")).alias("authority"))


def neighbourhood(edges: DataFrame, roots: DataFrame, hops: int) -> DataFrame:
    """node, hop: the least number of links (either way) from a root, up to hops."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    seen = roots.select("node", F.lit(0).alias("hop")).distinct()
    for k in range(1, hops + 1):
        next_ = seen.where(F.col("hop") == k - 1).join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        seen = cut(seen.union(next_.join(seen, "node", "left_anti").withColumn("hop", F.lit(k))), "seen")
    return seen


def bridges(edges: DataFrame, folders: DataFrame) -> DataFrame:
    """node, folders: distinct folders of a node and its neighbours. folders: node, folder."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(folders.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "folder").union(folders.select("node", "folder"))
    return near.groupBy("node").agg(F.count_distinct("folder").alias("folders"))
