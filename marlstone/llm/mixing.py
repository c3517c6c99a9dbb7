"""Mixing sources to target shares of all tokens, by iterative proportional fitting.

Tokens are summed by cell (source, language, topic). The cells' weights are raked in turn to the marginals of topic, language and
source until the source marginal holds: the source marginal is each source's target share of the whole, as far as its tokens times its
max_repeats go; what a source can't give is given by the others in proportion to their targets. Language and topic marginals are the
collection's own shares unless others are given, so a mix keeps them as far as the sources allow. No cell may be repeated more often
than its source's max_repeats. A document's expected copies are its cell's raked tokens over the tokens there are. Few cells are raked
in the driver's memory, more of them as a table by the same steps: which way is taken changes no result.

The size of the mix, unless given, is the largest at which every source with documents can give its whole share: a larger one would take
more from the others and move all shares away from their targets, a smaller one comes no nearer.

Copies are drawn by systematic sampling with the expected copies: within a source, documents are spread over buckets by hash (so a
source with a third of all rows is many tasks), ordered by size, and a document gets as many copies as whole numbers lie in its
stretch of the running sum of expected copies. So copies never exceed max_repeats. Then each source is brought to its tokens: in at most
MENDS rounds one document of it, whose size is nearest to what is missing (or too much), gets a copy more (or less).

Defined cases: a source without documents reaches 0; a source without a target, a null source and documents without tokens are not
selected; targets are divided by their sum; a null or negative target is 0; a null max_repeats is 1; a repeated target row counts once
(the larger); languages are compared lower-cased and null is "und"; repeated ids are documents of their own.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import cut, lookup, need, release, small, table
from .token_counts import RANKS, with_tokens

#: Documents of a bucket in which copies are drawn one after the other.
BUCKET = 20_000
SWEEPS = 200
TOLERANCE = 1e-6
#: Cells raked in the driver's memory (24 MB of numbers); more are raked as a table.
CELLS = 1_000_000
MENDS = 3


def fill(want: float, share: np.ndarray, most: np.ndarray) -> np.ndarray:
    """want in proportion to share, no entry above most; what one can't take goes to the others in proportion."""
    out, free = np.zeros(len(share)), share > 0
    left = want
    while free.any() and left > 0:
        trial = left * share / share[free].sum()
        over = free & (trial >= most)
        if not over.any():
            out[free] = trial[free]
            break
        out[over] = most[over]
        left -= most[over].sum()
        free &= ~over
    return out


def rake(source: np.ndarray, lang: np.ndarray, topic: np.ndarray, tokens: np.ndarray, most: np.ndarray, source_want: np.ndarray, lang_share: np.ndarray, topic_share: np.ndarray) -> np.ndarray:
    """The raked tokens of each cell; arrays give each cell's source, language, topic, tokens and the most it may give."""
    x = np.where(source_want[source] > 0, tokens, 0.0)
    by_source = [np.flatnonzero(source == s) for s in range(len(source_want))]
    for _ in range(SWEEPS):
        whole = source_want.sum()
        before = x
        for key, share in ((topic, topic_share), (lang, lang_share)):
            now = np.bincount(key, weights=x, minlength=len(share))
            x = x * np.divide(share * whole, now, out=np.ones_like(now), where=now > 0)[key]
        out = np.zeros_like(x)
        for s, cells in enumerate(by_source):
            if source_want[s] > 0 and len(cells):
                w = np.where(x[cells] > 0, x[cells], 0)
                out[cells] = fill(source_want[s], w, most[cells])
                short = source_want[s] - out[cells].sum()
                if short > 1e-9 * source_want[s]:  # raked down to nothing: the source still gives what it has
                    room = most[cells] - out[cells]
                    out[cells] += fill(short, room, room)
        x = out
        if np.abs(x - before).sum() <= TOLERANCE * max(whole, 1):
            break
    return x


def _topic(path: Column) -> Column:
    """The first folder below the vault."""
    parts = F.split(F.lower(F.translate(path, "\\", "/")), "/")
    return F.when(F.size(parts) >= 3, F.element_at(parts, 2)).otherwise(F.lit("(top)"))


def _scaled(df: DataFrame, keys: list[str], weight: str, most: str, want: DataFrame) -> DataFrame:
    """``fill`` as a plan: df with ``_out``, weight scaled by one factor a group so that the sum of least(factor * weight, most) is its want.

    want: keys, want (a row a group). The factor grows from the plain ratio as entries reach their most, as in ``fill``; each step is a
    partially aggregated sum, so a group with a third of all rows is no hot task.
    """
    df, want = cut(df, "fill"), want.withColumnRenamed("want", "_want")
    on = lambda x: x.crossJoin(F.broadcast(factor)) if not keys else x.join(factor, keys)  # noqa: E731 - without keys the factor is one row
    sums = df.groupBy(*keys).agg(F.sum(weight).alias("_w"))
    factor = cut((sums.crossJoin(F.broadcast(want)) if not keys else sums.join(want, keys)).select(*keys, "_want", F.when(F.col("_w") > 0, F.col("_want") / F.col("_w")).otherwise(0.0).alias("_f")), "factor")
    while True:
        full = F.col(weight) * F.col("_f") >= F.col(most)
        s = on(df).groupBy(*keys, "_want", "_f").agg(F.sum(F.when(full, F.col(most)).otherwise(0.0)).alias("_full"), F.sum(F.when(full, 0.0).otherwise(F.col(weight))).alias("_free"))
        left = F.col("_want") - F.col("_full")
        up = F.when((F.col("_free") > 0) & (left > 0), F.greatest("_f", left / F.col("_free"))).otherwise(F.col("_f"))
        before, factor = factor, cut(s.select(*keys, "_want", up.alias("_f"), (up > F.col("_f") * (1 + 1e-12)).alias("_more")), "factor")
        more = factor.where("_more").limit(1).count()
        release(before)
        factor = factor.drop("_more")
        if not more:
            return on(df).withColumn("_out", F.least(F.col(weight) * F.col("_f"), F.col(most))).drop("_f", "_want")


def rake_table(cells: DataFrame, wants: DataFrame, lang_shares: DataFrame, topic_shares: DataFrame, whole: float) -> DataFrame:
    """``rake`` as a plan. cells: source, lang, topic, tokens, most. wants: source, want. shares: lang or topic, share. Returns cells with ``x``."""
    now = cut(cells.join(wants.where("want > 0").select("source"), "source", "left_semi").withColumn("x", F.col("tokens").cast("double")), "rake")
    for _ in range(SWEEPS):
        x = now.withColumn("_before", F.col("x"))
        for key, shares in (("topic", topic_shares), ("lang", lang_shares)):
            sums = x.groupBy(key).agg(F.sum("x").alias("_s")).join(shares, key)
            x = x.join(sums, key).withColumn("x", F.when(F.col("_s") > 0, F.col("x") * F.col("share") * whole / F.col("_s")).otherwise(F.col("x"))).drop("_s", "share")
        filled = _scaled(x, ["source"], "x", "most", wants).drop("x").withColumnRenamed("_out", "x")
        filled = cut(filled, "rake")
        # raked down to nothing: the source still gives what it has
        short = filled.groupBy("source").agg(F.sum("x").alias("_x"), F.sum(F.col("most") - F.col("x")).alias("_room")).join(wants, "source")
        add = F.when((F.col("want") - F.col("_x") > 1e-9 * F.col("want")) & (F.col("_room") > 0), F.least(F.lit(1.0), (F.col("want") - F.col("_x")) / F.col("_room"))).otherwise(0.0)
        out = filled.join(short.select("source", add.alias("_a")), "source").withColumn("x", F.col("x") + F.col("_a") * (F.col("most") - F.col("x"))).drop("_a")
        out = cut(out, "rake")
        moved = out.agg(F.sum(F.abs(F.col("x") - F.col("_before")))).first()[0] or 0.0
        release(now, filled)
        now = out.drop("_before")
        now._cut = out._cut
        if moved <= TOLERANCE * max(whole, 1):
            break
    return now


class Mix:
    """documents: id, source, lang, topic, tokens, copies of the selected ones. shares(): what each source was to have, and has. total: tokens of the mix."""

    def __init__(self, sized: DataFrame, targets: DataFrame, total: float | None = None, lang_shares: dict | None = None, topic_shares: dict | None = None, cells_in_memory: int = CELLS):
        """sized: id, source, lang, topic, tokens. targets: source, target_share, max_repeats. total: tokens of the mix; see the module for its default."""
        goals = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).cast("int").alias("repeats"))
        goals = goals.crossJoin(F.broadcast(goals.agg(F.sum("share").alias("_all")))).select("source", F.when(F.col("_all") > 0, F.col("share") / F.col("_all")).otherwise(0.0).alias("share"), "repeats")
        docs = sized.where(F.col("source").isNotNull() & (F.col("tokens") > 0)).select("id", "source", F.coalesce(F.lower("lang"), F.lit("und")).alias("lang"), F.coalesce("topic", F.lit("(top)")).alias("topic"), "tokens", F.monotonically_increasing_id().alias("row"))
        goals = cut(goals, "goals")
        docs = cut(docs.join(lookup(goals), "source", "left_semi"), "sized")
        cells = cut(docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "cells")
        have = cells.groupBy("source").agg(F.sum("tokens").alias("have"), F.sum("n").alias("n"))
        sources = cut(goals.join(have, "source", "left").select("source", "share", "repeats", F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("n", F.lit(0)).alias("n")), "sources")
        can = sources.where("share > 0 AND have > 0 AND repeats > 0")
        if total is None:
            # shares of the sources that can give anything are of what is left when the others give nothing
            fits = can.agg(F.min(F.col("have") * F.col("repeats") / F.col("share")).alias("t"), F.sum("share").alias("s")).first()
            total = math.floor(fits["t"] * fits["s"] + 1e-6) if fits["t"] is not None else 0
        self.total = float(total)
        few = small(cells, cells_in_memory) if sources.count() <= cells_in_memory else None
        planned, wants = self._in_memory(few, sources, lang_shares, topic_shares) if few is not None else self._as_table(cells, sources, can, lang_shares, topic_shares)
        self._frame = cut(sources.join(wants, "source", "left").select("source", F.col("share").alias("wanted_share"), F.col("repeats").alias("max_repeats"), F.col("have").alias("available_tokens"), F.coalesce("want", F.lit(0.0)).alias("wanted_tokens"), "n"), "frame")
        buckets = self._frame.select("source", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).cast("int").alias("buckets"), F.col("max_repeats").alias("most"))
        placed = docs.join(lookup(planned), ["source", "lang", "topic"]).join(lookup(buckets), "source").withColumn("bucket", F.pmod(F.xxhash64("id"), F.col("buckets")))
        spot = W.partitionBy("source", "bucket").orderBy("tokens", F.xxhash64("id"), "id", "row")
        begin = F.pmod(F.xxhash64("source", "bucket"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        # whole numbers in the stretch from the sum before to the sum with the document; summed in millionths, so the order of additions changes nothing
        millionths = F.round(F.col("expected") * 1_000_000).cast("long")
        upto = F.sum(millionths).over(spot.rowsBetween(W.unboundedPreceding, 0))
        shift = F.floor(begin * 1_000_000).cast("long")
        copies = F.expr("(upto + shift) div 1000000 - (upto - step + shift) div 1000000").cast("int")
        drawn = placed.withColumns({"step": millionths, "upto": upto, "shift": shift}).withColumn("copies", F.least(copies, F.col("most")))
        drawn = cut(drawn.select("id", "row", "source", "lang", "topic", "tokens", "most", "copies"), "drawn")
        drawn = self._mended(drawn)
        self.documents = drawn.where("copies > 0").select("id", "source", "lang", "topic", "tokens", "copies")

    def _mended(self, drawn: DataFrame) -> DataFrame:
        """One document a source and round gets a copy more or less, if that brings the source nearer to its tokens."""
        for _ in range(MENDS):
            got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("got"))
            miss = cut(self._frame.join(got, "source").select("source", (F.round("wanted_tokens") - F.col("got")).cast("long").alias("miss")), "miss")
            able = F.when(F.col("miss") > 0, F.col("copies") < F.col("most")).otherwise(F.col("copies") > 0) & (F.abs(F.abs("miss") - F.col("tokens")) < F.abs("miss"))
            best = drawn.join(lookup(miss), "source").where(able).groupBy("source").agg(F.min(F.struct(F.abs(F.abs("miss") - F.col("tokens")).alias("d"), "row", F.signum("miss").cast("int").alias("by"))).alias("b")).select(F.col("b.row").alias("row"), F.col("b.by").alias("by"))
            best = cut(best, "best")
            if not best.limit(1).count():
                break
            before, drawn = drawn, cut(drawn.join(lookup(best), "row", "left").withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0))).drop("by"), "drawn")
            release(before)
        return drawn

    def _in_memory(self, cells: list, sources: DataFrame, lang_shares: dict | None, topic_shares: dict | None) -> tuple[DataFrame, DataFrame]:
        spark, rows = sources.sparkSession, sorted(sources.collect(), key=lambda r: r["source"])  # no more than cells in memory
        at = {r["source"]: i for i, r in enumerate(rows)}
        share, repeats, have = (np.array([r[k] for r in rows], dtype=float) for k in ("share", "repeats", "have"))
        want = fill(self.total, share, have * repeats) if rows else np.zeros(0)
        wants = spark.createDataFrame([(r["source"], float(w)) for r, w in zip(rows, want)], "source string, want double")
        cells = sorted(cells, key=lambda r: (r["source"], r["lang"], r["topic"]))
        schema = "source string, lang string, topic string, expected double"
        if not cells:
            return spark.createDataFrame([], schema), wants
        tokens = np.array([r["tokens"] for r in cells], dtype=float)
        source = np.array([at[r["source"]] for r in cells], dtype=np.int64)
        kinds = {k: sorted({r[k] for r in cells}) for k in ("lang", "topic")}
        codes = {k: np.array([bisect_left(v, r[k]) for r in cells], dtype=np.int64) for k, v in kinds.items()}
        marginals = []
        for k, given in (("lang", lang_shares), ("topic", topic_shares)):
            own = np.bincount(codes[k], weights=tokens * (want[source] > 0), minlength=len(kinds[k]))
            m = np.array([given.get(v, 0.0) for v in kinds[k]], dtype=float) if given else own
            marginals.append(m / m.sum() if m.sum() else m)
        raked = rake(source, codes["lang"], codes["topic"], tokens, tokens * repeats[source], want, *marginals)
        expected = np.minimum(raked / tokens, repeats[source])
        return spark.createDataFrame([(c["source"], c["lang"], c["topic"], float(e)) for c, e in zip(cells, expected)], schema), wants

    def _as_table(self, cells: DataFrame, sources: DataFrame, can: DataFrame, lang_shares: dict | None, topic_shares: dict | None) -> tuple[DataFrame, DataFrame]:
        spark = cells.sparkSession
        most = can.select("source", "repeats", F.col("share").alias("_w"), (F.col("have") * F.col("repeats")).cast("double").alias("_m"))
        filled = _scaled(most, [], "_w", "_m", spark.createDataFrame([(self.total,)], "want double"))
        wants = cut(filled.select("source", F.col("_out").alias("want")), "wants")
        cells = cells.join(sources.select("source", "repeats"), "source").withColumn("most", (F.col("tokens") * F.col("repeats")).cast("double"))
        wanted = cells.join(wants.where("want > 0").select("source"), "source", "left_semi")

        def shares(key: str, given: dict | None) -> DataFrame:
            if given:
                m = cells.select(key).distinct().join(spark.createDataFrame(list(given.items()), f"{key} string, m double"), key, "left").select(key, F.coalesce("m", F.lit(0.0)).alias("m"))
            else:
                m = wanted.groupBy(key).agg(F.sum("tokens").cast("double").alias("m"))
            whole = m.agg(F.sum("m").alias("_all"))
            return cut(m.crossJoin(F.broadcast(whole)).select(key, F.when(F.col("_all") > 0, F.col("m") / F.col("_all")).otherwise(0.0).alias("share")), "shares")

        whole = wants.agg(F.sum("want")).first()[0] or 0.0
        raked = rake_table(cells, wants, shares("lang", lang_shares), shares("topic", topic_shares), whole)
        return raked.select("source", "lang", "topic", F.least(F.col("x") / F.col("tokens"), F.col("repeats")).alias("expected")), wants

    def shares(self) -> DataFrame:
        got = self.documents.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"), F.count("*").alias("documents"), F.sum("copies").cast("long").alias("copies"))
        got = cut(got, "got")
        whole = got.agg(F.sum("reached_tokens").alias("_all"))  # one row
        out = self._frame.join(got, "source", "left").crossJoin(F.broadcast(whole))
        zero = {c: F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("reached_tokens", "documents", "copies")}
        return out.select("source", "wanted_share", "max_repeats", "available_tokens", F.round("wanted_tokens").cast("long").alias("wanted_tokens"), *zero.values(), F.coalesce(F.col("reached_tokens") / F.col("_all"), F.lit(0.0)).alias("reached_share"))


def _p8(spark: SparkSession, sf_dir: str, ranks: str = RANKS) -> Mix:
    docs = need(table(spark, sf_dir, "documents"), "doc_id", "source", "lang", "path", "text").where(F.col("source").isNotNull())
    sized = with_tokens(docs.select(F.col("doc_id").alias("id"), "source", "lang", _topic(F.col("path")).alias("topic"), "text"), "text", "tokens", ranks)
    return Mix(sized, need(table(spark, sf_dir, "mix_targets"), "source", "target_share", "max_repeats"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir).documents.withColumnRenamed("id", "doc_id")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p8(spark, sf_dir).shares()


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source its wanted share and repeats, whether some document is repeated too often, and whether its tokens are within 1 % (or one document) of what was wanted."""
    m = _p8(spark, sf_dir)
    docs = m.documents.groupBy("source").agg(F.max("copies").alias("c"), F.max("tokens").alias("t"))
    out = m.shares().join(docs, "source", "left")
    near = F.abs(F.col("reached_tokens") - F.col("wanted_tokens")) <= F.greatest(0.01 * F.col("wanted_tokens"), F.coalesce("t", F.lit(0)))
    return out.select("source", F.round("wanted_share", 9).alias("wanted_share"), F.col("max_repeats").cast("long").alias("max_repeats"), F.coalesce(F.col("c") > F.col("max_repeats"), F.lit(False)).alias("repeated_too_often"), near.alias("reached"))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_invariants": p8_invariants}
SQL = {
    "p8_invariants": """WITH g AS (SELECT source, max(greatest(coalesce(target_share, 0), 0)) AS share, max(greatest(coalesce(max_repeats, 1), 0)) AS max_repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY 1)
SELECT source, round(share / sum(share) OVER (), 9) AS wanted_share, max_repeats::BIGINT AS max_repeats, false AS repeated_too_often, true AS reached FROM g"""
}
