"""Links of all kinds in notes, and the notes that they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import need

#: Code is no place for links: fenced blocks (an open one reaches the end) and inline spans.
FENCED = r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[^\n]*|\z)|^[ \t]*~~~.*?(?:^[ \t]*~~~[^\n]*|\z)"
SPAN = r"`[^`\n]*`"
WIKI = r"(!?)\[\[([^\[\]\n]+)\]\]"
MARKDOWN = r"(!?)\[([^\]\n]*)\]\(([^)\n]+)\)"
URL = r"<((?:https?|mailto):[^>\s]+)>|(?:^|[^(\[<\w])((?:https?://|www\.)[^\s<>()\"'\]]+)"
TAG = r"(?:^|[\s(>|,;:\[{])#([\p{L}\p{N}_][\p{L}\p{N}_/-]*)"
EXTERNAL = r"(?i)^(?:https?|mailto):"
#: Files that are notes; a target with another extension is an attachment.
NOTE_EXTENSIONS = ("md", "markdown", "mdx", "canvas", "txt", "text", "csv", "org", "tex")


def masked(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, FENCED, ""), SPAN, "")


def extract(df: DataFrame, *carried: str, text: str = "text") -> DataFrame:
    """carried, target, heading, block, alias, embed, external of every wiki link, Markdown link and URL outside code.

    Defined cases: null and empty texts have none; an empty target (a link within the note) is kept with its anchor; parts that a link
    doesn't have are null.
    """
    rows = df.select(*carried, masked(F.col(text)).alias("_t"))
    all_ = lambda p, *groups: F.explode(F.arrays_zip(*(F.regexp_extract_all("_t", F.lit(p), F.lit(g)).alias(f"g{g}") for g in groups))).alias("m")
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    wiki = rows.select(*carried, all_(WIKI, 1, 2)).select(*carried, (F.col("m.g1") == "!").alias("embed"), F.split_part("m.g2", F.lit("|"), F.lit(1)).alias("to"), part(F.when(F.contains("m.g2", F.lit("|")), F.regexp_extract("m.g2", r"^[^|]*\|(.*)$", 1))).alias("alias"))
    anchor = part(F.regexp_extract("to", r"^[^#]*#(.*)$", 1))
    wiki = wiki.select(*carried, F.trim(F.split_part("to", F.lit("#"), F.lit(1))).alias("target"), F.when(~anchor.startswith("^"), anchor).alias("heading"), F.when(anchor.startswith("^"), F.substring(anchor, F.lit(2), F.length(anchor))).alias("block"), "alias", "embed")
    none = F.lit(None).cast("string")
    mark = rows.select(*carried, all_(MARKDOWN, 1, 2, 3)).select(*carried, F.trim(F.regexp_replace("m.g3", r'\s+"[^"]*"$', "")).alias("target"), none.alias("heading"), none.alias("block"), part(F.col("m.g2")).alias("alias"), (F.col("m.g1") == "!").alias("embed"))
    urls = rows.select(*carried, all_(URL, 1, 2)).select(*carried, F.coalesce(F.nullif("m.g1", F.lit("")), F.col("m.g2")).alias("target"), none.alias("heading"), none.alias("block"), none.alias("alias"), F.lit(False).alias("embed"))
    web = F.regexp_like("target", F.lit(r"(?i)^(?:https?:|mailto:|www\.)"))
    return wiki.unionByName(mark).unionByName(urls).withColumn("external", web)


def inline_tags(df: DataFrame, *carried: str, text: str = "text") -> DataFrame:
    """Distinct carried, tag (lower-cased) of the tags in the text outside code; numbers are none."""
    t = df.select(*carried, F.explode(F.regexp_extract_all(masked(F.col(text)), F.lit(TAG))).alias("tag")).withColumn("tag", F.lower(F.regexp_replace("tag", "/+$", "")))
    return t.where((F.length("tag") > 0) & ~F.regexp_like("tag", F.lit("^[0-9]+$"))).distinct()


def internal(df: DataFrame, *carried: str) -> DataFrame:
    """Distinct carried, target of links that can lead to a note of the collection (no URLs, no attachments)."""
    ext = T.extension(F.col("target"))
    links = extract(df, *carried).where(~F.col("external") & (F.length("target") > 0))
    return links.where((ext == "") | ext.isin(*NOTE_EXTENSIONS)).select(*carried, "target").distinct()


def owners(notes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """kind, key, path: what notes can be called. One owner a key: the shortest path, then the first. notes: path, title. aliases: path, alias."""
    n = need(notes, "path", "title")
    path = F.lower("path")
    named = n.select("path", F.explode(F.array(F.struct(F.lit("path").alias("kind"), path.alias("key")), F.struct(F.lit("name").alias("kind"), F.lower(T.base_name(F.col("path"))).alias("key")), F.struct(F.lit("name").alias("kind"), F.lower(T.stem(F.col("path"))).alias("key")), F.struct(F.lit("title").alias("kind"), F.lower(F.trim("title")).alias("key")))).alias("k")).select("k.kind", "k.key", "path")
    if aliases is not None:
        named = named.unionByName(need(aliases, "path", "alias").select(F.lit("alias").alias("kind"), F.lower(F.trim("alias")).alias("key"), "path"))
    best = F.min(F.struct(F.length("path").alias("n"), "path"))["path"]
    return named.where(F.length("key") > 0).groupBy("kind", "key").agg(best.alias("path"))


def resolve(links: DataFrame, known: DataFrame) -> DataFrame:
    """a, target, b: each link of note a with the note it leads to, or null. links: a, target; known: owners().

    In order: the whole path; the name in a's own folder or at the root, with or without .md (the shortest path, then the first); the name
    or stem anywhere; the title; an alias. All keys of a link are looked up by one join, and the first that is known is taken.
    """
    low, folder = F.lower("target"), F.lower(T.parent(F.col("a")))
    name = F.lower(T.base_name(F.col("target")))
    here = F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))
    key = lambda rank, kind, k: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), k.alias("key"))
    md = F.lit(".md")
    keys = F.array(key(1, "path", low), key(2, "path", here), key(2, "path", F.concat(here, md)), key(2, "path", name), key(2, "path", F.concat(name, md)), key(3, "name", name), key(4, "name", F.concat(name, md)), key(5, "title", low), key(6, "alias", low))
    links = links.select("a", "target").distinct()
    asked = links.select("a", "target", F.explode(keys).alias("k")).select("a", "target", "k.*")
    found = asked.join(known, ["kind", "key"]).groupBy("a", "target").agg(F.min(F.struct("rank", F.length("path").alias("n"), "path"))["path"].alias("b"))
    return links.join(found, ["a", "target"], "left")


def edges(resolved: DataFrame) -> DataFrame:
    """Distinct a, b without loops."""
    return resolved.where(F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select("a", "b").distinct()
