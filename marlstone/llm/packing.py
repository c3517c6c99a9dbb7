"""Filling containers of fixed capacity by bounded-space online best-fit.

A task keeps at most OPEN bins open. The free spaces of the open bins are the set bits of one integer of as many bits as the capacity:
the bin for an item is the lowest set bit at or above its size, found with a shift and a mask. If no open bin fits and OPEN are open, the fullest one closes,
then a new one opens.

Items are numbered (ids may repeat), written once, and spread over tasks by a hash of their number, so many of them that each fills
about BINS bins and has about ITEMS items: tasks are even whatever the input's order, and a repeated task makes the same bins. What is still open at the end of a task (at most OPEN bins) is
packed again as whole bins in a next, much smaller round, until one task is left.

An item is divided only if it alone is over the capacity: into full containers and a rest, which is packed like any item. Defined
cases: null and empty texts have size 0 and take no room, but are assigned; ids may repeat (each row is an item); a null or
non-positive capacity makes no parts; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, need, table
from .token_counts import RANKS, with_tokens

OPEN = 256
BINS = 20_000
ITEMS = 100_000


def best_fit(sizes: list[int], capacity: int, open_bins: int = OPEN) -> tuple[list[int], list[int]]:
    """The bin of each item, in order, and the bins that are open at the end. Sizes are within the capacity."""
    bits, at, count, made, out = 0, {}, 0, 0, []
    for size in sizes:
        fits = bits >> size
        if fits:
            free = size + ((fits & -fits).bit_length() - 1)
            here = at[free]
            b = here.pop()
            if not here:
                bits ^= 1 << free
        else:
            if count == open_bins:
                low = (bits & -bits).bit_length() - 1
                at[low].pop()
                if not at[low]:
                    bits ^= 1 << low
                count -= 1
            b, free = made, capacity
            made += 1
            count += 1
        out.append(b)
        free -= size
        if free:
            at.setdefault(free, []).append(b)
            bits |= 1 << free
        else:
            count -= 1  # full: it closes at once
    return out, [b for bins in at.values() for b in bins]


def _pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task: item, bin, whether the bin is still open, and what is in it."""
    capacity, item, size = key[1].as_py(), [], []
    for b in batches:
        item.append(b.column("item").to_numpy())
        size.append(b.column("size").to_numpy())
    item, size = np.concatenate(item), np.concatenate(size)
    order = np.lexsort((item, (item * np.int64(-7046029254386353131)).view(np.uint64)))  # an order that has nothing to do with sizes
    item, size = item[order], size[order]
    bins, left = best_fit(size.tolist(), capacity)
    bins = np.array(bins, dtype=np.int64)
    open_ = np.isin(bins, np.array(left, dtype=np.int64))
    fill = np.bincount(bins, weights=size).astype(np.int64)[bins]
    n = len(item)
    same = [pa.array([k.as_py()] * n, k.type) for k in key]
    yield pa.RecordBatch.from_arrays([*same, pa.array(item), pa.array(bins), pa.array(open_), pa.array(fill)], names=["capacity_of", "capacity", "task", "item", "bin", "open", "fill"])


def _round(items: DataFrame, tasks: DataFrame, name: str) -> DataFrame:
    """items: capacity_of, capacity, item, size. tasks: capacity_of, tasks (a row for each capacity, broadcast)."""
    spread = items.join(F.broadcast(tasks), "capacity_of").withColumn("task", F.pmod(F.xxhash64("item"), F.col("tasks")).cast("int"))
    packed = spread.select("capacity_of", "capacity", "task", "item", "size").groupBy("capacity_of", "capacity", "task").applyInArrow(
        _pack, "capacity_of string, capacity long, task int, item long, bin long, open boolean, fill long"
    )
    return cut(packed, name)


def pack(items: DataFrame, capacities: list[tuple[str, int]], bins: int = BINS) -> DataFrame:
    """items (id, size) into containers of each named capacity: name, capacity, id, piece, offset, size, part, where part is unique per name.

    ``offset`` is where in the item the piece begins.
    """
    spark = items.sparkSession
    schema = "name string, capacity long, id long, piece int, offset long, size long, part string"
    capacities = [(n, c) for n, c in capacities if c and c > 0]
    # the items' own numbers: ids may repeat
    items = cut(need(items, "id", "size").select("id", "size", F.monotonically_increasing_id().alias("item")), "items") if capacities else None
    total = items.agg(F.sum("size"), F.count("*")).first() if capacities else None
    if not capacities or not total[1]:
        return spark.createDataFrame([], schema)
    named = F.broadcast(spark.createDataFrame(capacities, "capacity_of string, capacity long"))
    each = items.crossJoin(named)  # each item once for every capacity, of which there are few
    rest = each.select("capacity_of", "capacity", "item", F.when(F.col("size") <= F.col("capacity"), F.col("size")).otherwise(F.col("size") % F.col("capacity")).alias("size"), (F.col("size") > F.col("capacity")).alias("cut")).where("NOT cut OR size > 0").drop("cut")
    tasks = {n: max(1, math.ceil((total[0] or 0) / (c * bins)), math.ceil(total[1] / ITEMS)) for n, c in capacities}
    table_of = lambda t: spark.createDataFrame(list(t.items()), "capacity_of string, tasks long")
    now = _round(rest, table_of(tasks), "packed")
    where = now.select("capacity_of", "item", F.concat_ws("-", F.lit("a"), "task", "bin").alias("bin"))
    step = 0
    while max(tasks.values()) > 1:
        step += 1
        left = now.where("open").select("capacity_of", "capacity", "task", "bin", "fill").distinct()
        left = cut(left.select("capacity_of", "capacity", F.col("fill").alias("size"), (F.shiftleft(F.col("task").cast("long"), 32) + F.col("bin")).alias("item")), "left")
        tasks = {n: 1 if t == 1 else max(1, math.ceil(t * OPEN / bins)) if math.ceil(t * OPEN / bins) < t else 1 for n, t in tasks.items()}
        again = _round(left, table_of(tasks), "packed")
        old = F.concat_ws("-", F.lit(chr(96 + step)), F.shiftright("item", 32), F.col("item").bitwiseAND((1 << 32) - 1))
        new = again.select("capacity_of", old.alias("bin"), F.concat_ws("-", F.lit(chr(97 + step)), "task", F.col("bin")).alias("new"))
        where = cut(where.join(new, ["capacity_of", "bin"], "left").select("capacity_of", "item", F.coalesce("new", "bin").alias("bin")), "where")
        now = again
    placed = each.join(where, ["capacity_of", "item"], "left")
    full = F.when(F.col("size") > F.col("capacity"), F.floor(F.col("size") / F.col("capacity"))).otherwise(0).cast("int")
    pieces = F.ceil(F.greatest(F.col("size"), F.lit(1)) / F.col("capacity")).cast("int")
    out = placed.withColumn("full", full).select("*", F.explode(F.sequence(F.lit(1), pieces)).alias("piece"))
    offset = (F.col("piece") - 1) * F.col("capacity")
    part = F.when(F.col("piece") <= F.col("full"), F.concat_ws("-", F.lit("full"), "item", "piece")).otherwise(F.col("bin"))
    return out.select(F.col("capacity_of").alias("name"), "capacity", "id", "piece", offset.alias("offset"), F.least(F.col("size") - offset, "capacity").alias("size"), part.alias("part"))


def _p7(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> DataFrame:
    limits = need(table(spark, sf_dir, "bundle_limits"), "destination", "part_limit_tokens").where(F.col("part_limit_tokens") > 0)
    capacities = [(r[0], r[1]) for r in limits.groupBy("destination").agg(F.min("part_limit_tokens")).collect()]  # a row per kind of destination
    sized = with_tokens(need(table(spark, sf_dir, "documents"), "doc_id", "text"), "text", "size", ranks)
    return pack(sized.withColumnRenamed("doc_id", "id"), capacities)


def p7_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """destination, part, doc_id, piece, token_start, tokens: every document for every destination with a limit in tokens."""
    return _p7(spark, sf_dir).select(F.col("name").alias("destination"), "part", F.col("id").alias("doc_id"), "piece", F.col("offset").alias("token_start"), F.col("size").alias("tokens"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per destination: parts, the least number of parts there could be, and the share of room used."""
    parts = _p7(spark, sf_dir).groupBy("name", "capacity").agg(F.count_distinct("part").alias("parts"), F.sum("size").alias("tokens"))
    return parts.select(F.col("name").alias("destination"), "capacity", "parts", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_parts"), "tokens", (F.col("tokens") / (F.col("parts") * F.col("capacity"))).alias("fill"))


def p7_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per destination: documents assigned, parts over the capacity, documents divided though they fit, and whether pieces follow each other without gap."""
    parts = cut(p7_parts(spark, sf_dir), "parts")
    limits = need(table(spark, sf_dir, "bundle_limits"), "destination", "part_limit_tokens").where(F.col("part_limit_tokens") > 0).groupBy("destination").agg(F.min("part_limit_tokens").alias("capacity"))
    used = parts.groupBy("destination", "part").agg(F.sum("tokens").alias("used")).join(F.broadcast(limits), "destination").groupBy("destination").agg(F.count_if(F.col("used") > F.col("capacity")).alias("over"))
    docs = parts.groupBy("destination", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.max(F.col("token_start") + F.col("tokens")).alias("end")).join(F.broadcast(limits), "destination")
    each = docs.groupBy("destination").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).alias("divided_in_vain"), F.count_if(F.col("end") != F.col("tokens")).alias("gaps"))
    return each.join(used, "destination")


QUERIES = {"p7_parts": p7_parts, "p7_fill": p7_fill, "p7_invariants": p7_invariants}
SQL = {
    "p7_invariants": """SELECT destination, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, 0::BIGINT AS divided_in_vain, 0::BIGINT AS gaps, 0::BIGINT AS over
FROM (SELECT DISTINCT destination FROM bundle_limits WHERE part_limit_tokens > 0)"""
}
