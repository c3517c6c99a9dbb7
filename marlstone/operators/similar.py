"""Likeness of notes by signatures: MinHash, bands, containment, themes, and an order in which alike notes follow each other."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import cut, need
from .components import components

SLOTS, ROWS, SHINGLE, LEAST_WORDS = 32, 4, 8, 16
_WORD = re.compile(r"[^\W_]+")


def signature(text: str) -> list[int] | None:
    """SLOTS minima over the runs of SHINGLE words, slot s of h1 + (s + 1) * h2; None under LEAST_WORDS words."""
    words = _WORD.findall(text.lower())
    if len(words) < LEAST_WORDS:
        return None
    runs = {" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}
    h = np.frombuffer(b"".join(blake2b(r.encode("utf-8", "surrogatepass"), digest_size=16).digest() for r in runs), dtype=np.uint64).reshape(-1, 2)
    least = np.full(SLOTS, np.iinfo(np.uint64).max, dtype=np.uint64)
    steps = np.arange(1, SLOTS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 65_536):  # bounded memory for the longest texts
            some = h[at : at + 65_536]
            least = np.minimum(least, (some[:, :1] + some[:, 1:] * steps).min(axis=0))
    return least.view(np.int64).tolist()


def signatures(notes: DataFrame) -> DataFrame:
    """doc_id, signature of the notes that have one. Null texts have none."""
    rows = need(notes, "doc_id", "text").where(F.col("text").isNotNull())

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "signature": [signature(t) for t in b["text"]]})

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, signature array<long>").where(F.col("signature").isNotNull())


def banded_pairs(signed: DataFrame, least: float = 0.35, rows: int = ROWS) -> DataFrame:
    """a < b, similarity (share of equal slots) of notes that agree in a band of ``rows`` slots and reach ``least``.

    Notes of one signature are one class (its least id): a group of copies of any size is one row here, see ``classes``.
    """
    sets = cut(classes(signed).groupBy("rep").agg(F.first("signature").alias("s")), "signatures")
    bands = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(SLOTS // rows - 1)), lambda i: F.xxhash64(F.slice("s", i * rows + 1, rows)))).alias("band", "key")
    at = sets.select("rep", bands)
    met = at.select(F.col("rep").alias("a"), "band", "key").join(at.select(F.col("rep").alias("b"), "band", "key"), ["band", "key"]).where("a < b").select("a", "b").distinct()
    both = met.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("y")), "b")
    same = F.aggregate(F.zip_with("x", "y", lambda p, q: (p == q).cast("int")), F.lit(0), lambda n, v: n + v) / SLOTS
    return both.select("a", "b", same.alias("similarity")).where(F.col("similarity") >= least)


def classes(signed: DataFrame) -> DataFrame:
    """doc_id, rep, signature: the least id of those with the same signature."""
    least = signed.groupBy("signature").agg(F.min("doc_id").alias("rep"))
    return signed.join(least, "signature").select("doc_id", "rep", "signature")


def related(pairs: DataFrame, k: int = 6) -> DataFrame:
    """id, neighbour, similarity, rank: the k most similar of each."""
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "similarity").union(pairs.select("b", "a", "similarity"))
    w = W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cohesion(near: DataFrame) -> DataFrame:
    """One row: the mean over notes of the mean similarity of their neighbours."""
    return near.groupBy("id").agg(F.avg("similarity").alias("m")).agg(F.avg("m").alias("cohesion"))


def contained_pairs(notes: DataFrame, containment: float = 0.93, k: int = SHINGLE) -> DataFrame:
    """a, b, containment: notes a whose distinct runs of k words are to that share among those of the larger note b. Exact.

    With the runs in order of rarity, one of the first n - ceil(c n) + 1 of a must be in b, so only those look for partners; runs of one
    note only are counted, but not moved. Copies of one text are one note (the least id).
    """
    rep = notes.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"))
    words = notes.join(rep.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.transform(w, lambda x: F.xxhash64(x)).alias("w"))
    side = F.arrays_zip(*(F.slice("w", j + 1, F.greatest(F.size("w") - j, F.lit(0))).alias(f"w{j}") for j in range(k)))
    runs = F.array_distinct(F.transform(F.filter(side, lambda r: r[f"w{k - 1}"].isNotNull()), lambda r: F.xxhash64(*[r[f"w{j}"] for j in range(k)])))
    post = words.select("doc_id", runs.alias("s")).select("doc_id", F.size("s").alias("n"), F.explode_outer("s").alias("e")).where("e IS NOT NULL")
    df = post.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    shared = cut(post.join(df, "e").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("s")), "shared")
    head = F.col("n") - F.ceil(F.lit(containment) * F.col("n") - 1e-9).cast("int") + 1 - (F.col("n") - F.size("s"))
    ask = shared.where(head > 0).select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.explode(F.slice("s", F.lit(1), head)).alias("x")).select("a", "na", "x.e")
    have = shared.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.explode("s").alias("x")).select("b", "nb", "x.e")
    met = ask.join(have, "e").where((F.col("a") != F.col("b")) & ((F.col("nb") > F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("a") < F.col("b"))))).select("a", "b", "na").distinct()
    sets = shared.select("doc_id", F.transform("s", lambda v: v["e"]).alias("s"))
    both = met.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", (F.size(F.array_intersect("x", "y")) / F.col("na")).alias("containment")).where(F.col("containment") >= containment - 1e-12)


def themes(pairs: DataFrame, key_terms: DataFrame, least: float = 0.45, size: int = 3, most: int = 12) -> DataFrame:
    """theme (least id), notes, label, terms: groups of alike notes by size, with the terms most of their notes have (six, the first three are the label)."""
    groups = cut(components(pairs.where(F.col("similarity") >= least)), "themes")
    big = groups.groupBy("component").agg(F.count("*").alias("notes")).where(F.col("notes") >= size)
    counted = groups.join(key_terms.select(F.col("doc_id").alias("node"), "term"), "node").groupBy("component", "term").agg(F.count("*").alias("n"))
    w = W.partitionBy("component").orderBy(F.desc("n"), "term")
    top = counted.withColumn("r", F.row_number().over(w)).where("r <= 6").groupBy("component").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]).alias("terms"))
    out = big.join(top, "component", "left").select(F.col("component").alias("theme"), "notes", F.array_join(F.slice("terms", 1, 3), ", ").alias("label"), "terms")
    return out.orderBy(F.desc("notes"), "theme").limit(most)
