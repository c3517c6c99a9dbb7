"""Notes and what is read out of them: lines, terms, tags, links, properties, tasks. All narrow expressions over the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import table


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, folder, stem, title, source, lang, text, mtime; notes without path are unfiled, those without text are left out."""
    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    path = F.coalesce("path", F.concat(F.lit("unfiled/"), F.col("doc_id").cast("string"), F.lit(".md")))
    d = d.withColumn("path", path)
    none = F.lit("")
    return d.select("doc_id", "path", T.parent(F.col("path")).alias("folder"), T.stem(F.col("path")).alias("stem"), F.coalesce("title", none).alias("title"), F.coalesce("source", none).alias("source"), F.coalesce("lang", none).alias("lang"), "text", "mtime")


def lines(df: DataFrame, *carried: str) -> DataFrame:
    """line_no (from 1) and line, without the carriage return, of every text."""
    return df.select(*carried, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).withColumns({"line_no": F.col("line_no") + 1, "line": F.regexp_replace("line", "\r$", "")})


FENCE = r"^\s*(```|~~~)"


def lines_like(df: DataFrame, pattern: str, *carried: str) -> DataFrame:
    """Lines in which the pattern is found, and those that outside_fences needs: only they go through its window."""
    return lines(df, *carried).where(F.regexp_like("line", F.lit(pattern)) | F.regexp_like("line", F.lit(FENCE)))


def outside_fences(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines that are in no code fence: the number of fence lines up to a line is even. Fences pair within one text, so the window is a text's own."""
    fence = F.regexp_like(F.col("line"), F.lit(FENCE))
    open_ = F.sum(fence.cast("int")).over(W.partitionBy(key).orderBy("line_no"))
    return df.withColumns({"_fence": fence, "_open": open_}).where(~F.col("_fence") & (F.col("_open") % 2 == 0)).drop("_fence", "_open")


def terms(df: DataFrame, *carried: str, stop: tuple[str, ...] = T.STOP) -> DataFrame:
    """Term and its times in each note: letter-initial, 3 to 40 characters, no stop word."""
    each = df.select(*carried, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({T.TERM})"))).alias("term"))
    return each.where((F.length("term") <= 40) & ~F.col("term").isin(*stop)).groupBy(*carried, "term").agg(F.count("*").alias("freq"))


def top_terms(df: DataFrame, key: str = "doc_id", k: int = 14) -> DataFrame:
    """key, term, freq, rank of the k most frequent terms, ties by term."""
    w = W.partitionBy(key).orderBy(F.desc("freq"), "term")
    return terms(df, key).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def key_terms(df: DataFrame, key: str = "doc_id", most_ratio: float = 0.6, per_note: int = 8) -> DataFrame:
    """key, term, rank, weight, df: idf = ln(1 + N / (1 + df)) over the top lists, divided by the root of the rank in the list."""
    top = top_terms(df, key)
    total = df.agg(F.count("*").alias("_n"))  # one row
    freq = top.groupBy("term").agg(F.count("*").alias("df"))
    scored = top.join(freq, "term").crossJoin(F.broadcast(total)).where((F.col("_n") <= 6) | (F.col("df") / F.col("_n") <= most_ratio))
    weight = F.log(1 + F.col("_n") / (1 + F.col("df"))) / F.sqrt(F.col("rank"))
    scored = scored.select(key, "term", "df", weight.alias("weight"))
    w = W.partitionBy(key).orderBy(F.desc(F.round("weight", 9)), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_note)


FRONT = r"^---\r?\n([\s\S]*?)\r?\n---"


def frontmatter(text: F.Column) -> F.Column:
    return F.regexp_extract(text, FRONT, 1)


def properties(df: DataFrame, *carried: str) -> DataFrame:
    """key and raw value of each top-level property of the frontmatter."""
    line = F.explode(F.split(frontmatter(F.col("text")), r"\r?\n")).alias("line")
    pair = df.select(*carried, line).where(F.regexp_like("line", F.lit(r"^[A-Za-z][A-Za-z0-9_ -]*:")))
    return pair.select(*carried, F.lower(F.trim(F.regexp_extract("line", r"^([A-Za-z][A-Za-z0-9_ -]*):", 1))).alias("key"), F.trim(F.regexp_extract("line", r"^[A-Za-z][A-Za-z0-9_ -]*:(.*)$", 1)).alias("value"))


def value_type(v: F.Column) -> F.Column:
    kind = lambda p: F.regexp_like(v, F.lit(p))
    return (
        F.when(kind(r"^\[.*\]$"), "list").when(kind(r"^(true|false|True|False)$"), "boolean").when(kind(r"^-?[0-9]+(\.[0-9]+)?$"), "number").when(kind(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").otherwise("string")
    )


def property_schema(df: DataFrame) -> DataFrame:
    """key, notes, type (mixed if several), of properties that have a value."""
    v = properties(df, "doc_id").where(~F.col("value").isin("", "null", "~", "[]"))
    typed = v.select("doc_id", "key", value_type(F.col("value")).alias("type")).distinct()
    return typed.groupBy("key").agg(F.count_distinct("doc_id").alias("notes"), F.when(F.count_distinct("type") > 1, "mixed").otherwise(F.max("type")).alias("type"))


def tags(df: DataFrame, *carried: str) -> DataFrame:
    """Distinct lower-cased tags of the frontmatter's list."""
    v = properties(df, *carried).where(F.col("key") == "tags")
    tag = F.explode(F.split(F.regexp_replace("value", r"[\[\]\"']", ""), r"\s*,\s*")).alias("tag")
    return v.select(*carried, tag).select(*carried, F.lower(F.trim("tag")).alias("tag")).where(F.length("tag") > 0).distinct()


LINK = r"\[\[([^\]\[|#\n]+)[^\]\[\n]*\]\]"


def links(df: DataFrame, *carried: str) -> DataFrame:
    """Targets of wiki links and embeds, once per note."""
    t = F.explode(F.regexp_extract_all("text", F.lit(LINK))).alias("target")
    return df.select(*carried, t).select(*carried, F.trim("target").alias("target")).where(F.length("target") > 0).distinct()


def open_tasks(df: DataFrame) -> DataFrame:
    """text, kind, priority, notes: unchecked or begun task boxes outside code, once per note, over all notes."""
    at = outside_fences(lines(df, "doc_id"))
    box = r"^\s*[-*+]\s+\[([ /?])\]\s+(.*)$"
    task = at.select("doc_id", F.regexp_extract("line", box, 1).alias("mark"), F.regexp_extract("line", box, 2).alias("raw"), "line").where(F.length("mark") > 0)
    task = task.withColumn("text", F.trim(T.strip_inline_markup(F.col("raw")))).where(F.length("text").between(4, 220))
    high = F.regexp_like("line", F.lit(HIGH))
    return task.groupBy(F.lower("text").alias("text")).agg(F.count_distinct("doc_id").alias("notes"), F.max(F.when(F.col("mark") == "/", "in-progress").otherwise("task")).alias("kind"), F.max(F.when(high, 1).otherwise(0)).alias("high"))


TASK = r"^\s*(?:[-*+]|[0-9]+[.)])\s+\[([ /?])\]\s+(.+)$"
MARKER = r"(?i)^(?:[-*+]\s+)?(?:TODO|FIXME|QUESTION|BLOCKER|❓)\s*[:—-]?\s+(.+)$"
HEADING = r"^#{1,6}\s+"
QUESTION_HEADING = r"(?i)^#{1,6}\s+.*\b(open\s+questions?|questions?|unresolved|blockers?|unknowns?)\b"
HIGH = r"(?i)🔥|⏫|🔺|\[!?(?:high|urgent|blocker|p0|p1)\]|#(?:urgent|high|blocker)\b|\b(?:FIXME|BLOCKER)\b"


def open_items(df: DataFrame) -> DataFrame:
    """text, kind, notes, high: task boxes, marker lines and question lines below a heading of open questions, outside code and frontmatter, once per note.

    open_tasks has the boxes alone. The heading that a line is under is the last one before it in its note.
    """
    body = df.select("doc_id", F.regexp_replace("text", FRONT.replace("(", "(?:", 1), "").alias("text"))
    t = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    # what can be no item, heading or fence is left out before the windows
    at = lines_like(body, r"^\s*(?:#{1,6}\s|(?:[-*+]|[0-9]+[.)])\s+\[[ /?]\]\s)|(?i)^\s*(?:[-*+]\s+)?(?:TODO|FIXME|QUESTION|BLOCKER|❓)|\?", "doc_id")
    at = outside_fences(at).withColumn("trimmed", t(F.col("line"))).withColumn("head", like("trimmed", HEADING))
    under = F.last(F.when(F.col("head"), like("trimmed", QUESTION_HEADING)), ignorenulls=True).over(W.partitionBy("doc_id").orderBy("line_no"))
    at = at.withColumn("asked", F.coalesce(under, F.lit(False))).where(~F.col("head"))
    box, marker = like("line", TASK), like("trimmed", MARKER)
    rule = F.when(box, 1).when(marker, 2).when(F.col("asked"), 3)
    raw = F.when(box, F.regexp_extract("line", TASK, 2)).when(marker, F.regexp_extract("trimmed", MARKER, 1)).otherwise(F.regexp_replace("trimmed", r"^(?:[-*+]|[0-9]+[.)])\s+", ""))
    at = at.select("doc_id", "line", rule.alias("rule"), F.regexp_extract("line", TASK, 1).alias("mark"), "trimmed", t(T.strip_inline_markup(t(raw))).alias("text")).where("rule IS NOT NULL")
    size, asks = F.length("text"), F.col("text").endswith("?")
    at = at.where(F.when(F.col("rule") == 1, size.between(4, 220)).when(F.col("rule") == 2, size.between(6, 240)).otherwise(asks & size.between(12, 240)))
    # as in the engine, a question mark sign anywhere makes a marker line a question
    question = (F.col("rule") == 3) | ((F.col("rule") == 2) & (asks | like("trimmed", r"(?i)^question|❓")))
    kind = F.when(F.max(F.when(F.col("mark") == "/", 0).otherwise(1)) == 0, "in-progress").otherwise("task")
    g = at.groupBy(F.lower("text").alias("text"), question.alias("question"))
    return g.agg(F.count_distinct("doc_id").alias("notes"), kind.alias("kind"), F.max(like("line", HIGH).cast("int")).alias("high")).select("text", F.when(F.col("question"), "question").otherwise(F.col("kind")).alias("kind"), "notes", "high")
