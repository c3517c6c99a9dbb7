"""The map of a collection: overview, folders, tags, terms, hubs, themes, reading order, as short tables and as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import cut, need
from . import graph as G
from . import notes as N
from . import similar as M


def reading_minutes(words: Column) -> Column:
    """One decimal, at 225 words a minute."""
    return F.round(words / 225, 1)


def as_date(text: Column) -> Column:
    """The time that a frontmatter's value tells: a day, a day and time, or milliseconds or seconds since 1970; null if none."""
    t = F.trim(text)
    number = t.try_cast("long")
    seconds = F.when(number > 100_000_000_000, F.timestamp_millis(number)).when(number > 100_000_000, F.timestamp_seconds(number))
    return F.when(F.regexp_like(t, F.lit(r"^\d{9,14}$")), seconds).when(F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2}")), t.try_cast("timestamp"))


# Properties that tell when a note was made, in the order in which they are tried.
CREATED = ("created", "date", "created_at", "ctime")


def effective_created(notes: DataFrame) -> DataFrame:
    """doc_id, created: the first of CREATED that can be read, but no later than the file's own ctime (if there is one)."""
    p = N.properties(notes, "doc_id").where(F.col("key").isin(*CREATED)).withColumn("at", as_date(F.regexp_replace("value", "[\"']", ""))).where(F.col("at").isNotNull())
    rank = F.array_position(F.array(*map(F.lit, CREATED)), F.col("key"))
    said = p.groupBy("doc_id").agg(F.min_by("at", rank).alias("said"))
    own = F.col("ctime") if "ctime" in notes.columns else F.lit(None).cast("timestamp")
    return notes.select("doc_id", own.alias("own")).join(said, "doc_id", "left").select("doc_id", F.least("own", "said").alias("created"))


def reading_order(hubs: DataFrame, themes: DataFrame, members: DataFrame, signal: DataFrame, most: int = 12) -> DataFrame:
    """place, path: up to six hubs, then up to two notes a theme (by signal), then by signal; each note once.

    hubs: path, in_degree; themes: theme, notes; members: theme, path; signal: path, signal.
    """
    from pyspark.sql import Window as W

    s = signal.select("path", "signal")
    first = hubs.orderBy(F.desc("in_degree"), "path").limit(6).select(F.lit(1).alias("k"), F.lit(0).cast("long").alias("t"), F.col("in_degree").cast("double").alias("v"), "path")
    w = W.partitionBy("theme").orderBy(F.desc("signal"), "path")
    second = members.join(themes.select("theme", "notes"), "theme").join(s, "path").withColumn("r", F.row_number().over(w)).where("r <= 2").select(F.lit(2).alias("k"), (-F.col("notes")).cast("long").alias("t"), F.col("signal").cast("double").alias("v"), "path")
    third = s.orderBy(F.desc("signal"), "path").limit(most + 6 + 2 * 12).select(F.lit(3).alias("k"), F.lit(0).cast("long").alias("t"), F.col("signal").cast("double").alias("v"), "path")
    every = first.union(second).union(third)  # a few rows
    once = every.groupBy("path").agg(F.min(F.struct("k", "t", (-F.col("v")).alias("v"))).alias("x")).select("path", "x.*")
    return once.withColumn("place", F.row_number().over(W.orderBy("k", "t", "v", "path"))).where(F.col("place") <= most).select("place", "path")


def mermaid(edges: list[tuple[str, str]], most: int = 12) -> str:
    """A diagram of the first edges; nodes are numbered as they come."""
    ids: dict[str, str] = {}
    node = lambda p: ids.setdefault(p, f"n{len(ids)}")
    name = lambda p: p.rsplit("/", 1)[-1].removesuffix(".md").replace('"', "'")
    lines = [f'  {node(a)}["{name(a)}"] --> {node(b)}["{name(b)}"]' for a, b in edges[:most]]
    return "\n".join(["```mermaid", "graph LR", *lines, "```"])


def knowledge_map(notes: DataFrame, edges: DataFrame, title: str = "notes") -> str:
    """The map as Markdown. Each of its lists is a bounded top-k made by a plan. notes: doc_id, path, folder, title, text, mtime; edges: a, b."""
    n = cut(need(notes, "doc_id", "path", "folder", "title", "text", "mtime").withColumn("words", T.count_words(F.col("text"))), "mapped")
    o = n.agg(F.count("*").alias("notes"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.count_distinct("folder").alias("folders"), F.min("mtime").alias("first"), F.max("mtime").alias("last")).first()
    if not o.notes:
        return f"# Map of {title}\n\nNo notes.\n"
    kt = cut(N.key_terms(n), "terms")
    deg = cut(G.degrees(edges), "degrees")
    pairs = cut(M.banded_pairs(M.signatures(n)), "pairs")
    th = M.themes(pairs, kt).collect()  # twelve at most
    show = lambda df, *c: [tuple(r) for r in df.select(*c).collect()]
    folders = show(n.groupBy("folder").agg(F.count("*").alias("n"), F.sum("words").alias("w")).orderBy(F.desc("w"), "folder").limit(30), "folder", "n", "w")
    tags = show(N.tags(n, "doc_id").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(40), "tag", "n")
    terms = show(kt.groupBy("term").agg(F.round(F.sum("weight"), 4).alias("w"), F.count("*").alias("n")).orderBy(F.desc("w"), "term").limit(40), "term", "n")
    hubs = show(deg.where("in_degree > 0").orderBy(F.desc("in_degree"), "node").limit(25), "node", "in_degree")
    months = show(n.groupBy(F.coalesce(F.date_format("mtime", "yyyy-MM"), F.lit("unknown")).alias("m")).agg(F.count("*").alias("n")).orderBy(F.desc("m")).limit(24), "m", "n")
    first = show(edges.orderBy("a", "b").limit(12), "a", "b")
    out = [f"# Map of {title}", "", f"{o.notes} notes in {o.folders} folders, {o.words} words, about {round(o.words / 225)} minutes to read."]
    for name, rows in (("Folders", [f"{f or '(root)'}: {k} notes, {w} words" for f, k, w in folders]), ("Tags", [f"#{t}: {k}" for t, k in tags]), ("Key terms", [f"{t} ({k})" for t, k in terms]), ("Hubs", [f"{p} ({k} links)" for p, k in hubs]), ("Themes", [f"{t.label or '(no terms)'}: {t.notes} notes" for t in th]), ("Timeline", [f"{m}: {k}" for m, k in months])):
        if rows:
            out += ["", f"## {name}", "", *(f"- {r}" for r in rows)]
    if first:
        out += ["", "## Links", "", mermaid(first)]
    return "\n".join(out) + "\n"
