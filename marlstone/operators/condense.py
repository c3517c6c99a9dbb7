"""Making notes shorter: repeated lines out, summaries, outlines, cuts at a size, a glossary."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import cut, need
from . import intel as I
from .notes import lines, lines_like, outside_fences
from .transform import HEADING, segments

LEAST_CHARS, MOST_CHARS = 10, 400


def repeated_lines(notes: DataFrame, least_docs: int = 3) -> DataFrame:
    """doc_id, line_no of the lines that are a template of the collection: the line itself, or (if it has no digit) its form with digits aside, is in
    max(2, min(least_docs, notes)) notes. Copies of one text count once, so a collection of copies has no template."""
    one = notes.join(notes.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "doc_id", "left_semi")
    total = one.count()
    least = max(2, min(least_docs, total))
    exact = I.line_frequency(one, least, LEAST_CHARS, exact=True).select(F.lit(True).alias("same"), F.col("template").alias("form"))
    alike = I.line_frequency(one, least, LEAST_CHARS).select(F.lit(False).alias("same"), F.col("template").alias("form"))
    hot = cut(exact.unionByName(alike), "hot")
    at = lines(notes, "doc_id").where((F.length(F.trim("line")) >= LEAST_CHARS) & (F.length("line") <= MOST_CHARS))
    forms = F.array(F.struct(F.lit(True).alias("same"), T.normalize_exact(F.col("line")).alias("form")), F.struct(F.lit(False).alias("same"), F.when(~F.regexp_like("line", F.lit("[0-9]")), T.normalize_template(F.col("line"))).alias("form")))
    asked = at.select("doc_id", "line_no", F.explode(forms).alias("f")).select("doc_id", "line_no", "f.*").where("form IS NOT NULL")
    return asked.join(hot, ["same", "form"]).select("doc_id", "line_no").distinct()


def strip_lines(text: str, hits: set[int], most_removed: float = 0.5, least_left: float = 0.15) -> tuple[str, int]:
    """The text without the lines (from 1), by these rules: lines repeated next to each other go with the blank lines between them; a heading
    stays if its own section keeps anything; nothing goes if that were over most_removed of all lines, or if of ten words or more under
    least_left were left."""
    rows = text.split("\n")
    drop = [i + 1 in hits for i in range(len(rows))]
    i = 0
    while i < len(rows):
        if not drop[i]:
            i += 1
            continue
        last = j = i
        while j < len(rows) and (drop[j] or not rows[j].strip()):
            last = j if rows[j].strip() else last
            j += 1
        for k in range(i, last + 1):
            drop[k] = True
        i = j
    keeps = False  # anything kept below, up to the next heading
    for i in range(len(rows) - 1, -1, -1):
        if HEADING.match(rows[i]):
            drop[i] = drop[i] and not keeps
            keeps = False
        elif rows[i].strip() and not drop[i]:
            keeps = True
    gone = sum(drop)
    left = "\n".join(x for x, d in zip(rows, drop) if not d)
    words = len(text.split())
    if not gone or gone / len(rows) > most_removed or (words >= 10 and len(left.split()) < least_left * words):
        return text, 0
    return left, gone


def without_boilerplate(notes: DataFrame, least_docs: int = 3) -> DataFrame:
    """doc_id, text, removed (lines) of every note."""
    hits = repeated_lines(notes, least_docs).groupBy("doc_id").agg(F.collect_set("line_no").alias("hits"))  # of one note
    rows = need(notes, "doc_id", "text").join(hits, "doc_id", "left")

    def run(batches):
        for b in batches:
            done = [strip_lines(t, set(map(int, h))) if t is not None and h is not None else (t, 0) for t, h in zip(b["text"], b["hits"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [t for t, _ in done], "removed": [n for _, n in done]})

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string, removed int")


_END = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+(?=[\"'«“(\[]*[A-ZÀ-ÖØ-Þ0-9])")


def sentences(text: str) -> list[str]:
    """Per line; short headings and items are one each; code is none."""
    out = []
    for code, rows in segments(text):
        for line in rows if not code else ():
            line = line.strip()
            if not line:
                continue
            if len(line) < 90 and re.match(r"#{1,6}\s|[-*+]\s|\d+[.)]\s", line):
                out.append(line)
            else:
                out += [s.strip() for s in _END.split(line) if s.strip()]
    return out


_WORD = re.compile(r"[^\W\d_][\w'’-]{2,}")
_STOP = frozenset(T.STOP)
DEFINES = re.compile(r"\b(?:is|are|means|refers to|denotes|consists of|est|sont|désigne)\b", re.I)


def _budget(n: int, ratio: float, fixed: int | None) -> int:
    return max(1, min(fixed or math.ceil(n * ratio), n - 1))


def _terms(s: str) -> list[str]:
    return [w for w in (x.lower() for x in _WORD.findall(s)) if w not in _STOP]


def summarise(text: str, method: str = "centroid", ratio: float = 0.35, fixed: int | None = None, least_words: int = 120) -> tuple[str, bool]:
    """The chosen sentences in the text's order, the first always among them, and whether it was shortened at all.

    lead: the first ones. centroid: words by their share of the most frequent, over the root of the length, earlier ones up to 35 % more.
    keypoints: frequent terms, definitions, what follows a heading, digits. mmr: centroid against likeness to what is chosen (0.55).
    """
    all_ = sentences(text)
    n = len(all_)
    if n < 4 or len(text.split()) < least_words:
        return text, False
    k = _budget(n, ratio, fixed)
    words = [_terms(s) for s in all_]
    tf = Counter(w for ws in words for w in ws)
    top = max(tf.values(), default=1)
    score = [sum(tf[w] / top for w in ws) / math.sqrt(max(1, len(ws))) * (1 + 0.35 * (1 - i / n)) for i, ws in enumerate(words)]
    if method == "lead":
        chosen = list(range(k))
    elif method == "keypoints":
        common = {w for w, _ in tf.most_common(14)}
        point = []
        for i, (s, ws) in enumerate(zip(all_, words)):
            x = sum(w in common for w in ws) + 1.5 * bool(DEFINES.search(s)) + 0.8 * (i > 0 and all_[i - 1].startswith("#")) + 0.3 * any(c.isdigit() for c in s)
            point.append(x / math.sqrt(max(1, len(s.split()))) + 0.2 * (1 - i / n))
        chosen = [0, *sorted(range(1, n), key=lambda i: (-point[i], i))[: k - 1]]
    elif method == "mmr":
        stems = [{w[:5] for w in ws} for ws in words]
        high = max(score) or 1.0
        like = [len(s & stems[0]) / max(1, len(s | stems[0])) for s in stems]
        chosen, rest = [0], set(range(1, n))
        while len(chosen) < k and rest:
            best = min(rest, key=lambda i: (-(0.55 * score[i] / high - 0.45 * like[i]), i))
            chosen.append(best)
            rest.discard(best)
            for i in rest:
                like[i] = max(like[i], len(stems[i] & stems[best]) / max(1, len(stems[i] | stems[best])))
    else:
        chosen = [0, *sorted(range(1, n), key=lambda i: (-score[i], i))[: k - 1]]
    return "\n".join(all_[i] for i in sorted(chosen)), True


def summaries(notes: DataFrame, method: str = "centroid", ratio: float = 0.35, fixed: int | None = None, least_words: int = 120) -> DataFrame:
    """doc_id, summary, shortened."""
    rows = need(notes, "doc_id", "text")

    def run(batches):
        for b in batches:
            done = [summarise(t, method, ratio, fixed, least_words) if t is not None else (None, False) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "summary": [s for s, _ in done], "shortened": [x for _, x in done]})

    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, summary string, shortened boolean")


OUTLINE = 24


def outline(notes: DataFrame) -> DataFrame:
    """doc_id, outline: the headings of the shallowest level of each note in order, up to OUTLINE of them."""
    h = outside_fences(lines_like(notes, r"^ {0,3}#{1,6}[ \t]", "doc_id")).where(F.regexp_like("line", F.lit(r"^ {0,3}#{1,6}[ \t]")))
    h = h.select("doc_id", "line_no", F.length(F.regexp_extract("line", r"^ {0,3}(#{1,6})", 1)).alias("level"), F.trim(F.regexp_replace(F.regexp_extract("line", r"^ {0,3}#{1,6}[ \t]+(.*)$", 1), r"[ \t]+#+[ \t]*$", "")).alias("title"))
    g = h.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "level", "title"))).alias("h"))  # of one note
    least = F.array_min(F.transform("h", lambda x: x["level"]))
    return g.select("doc_id", "h", least.alias("least")).select("doc_id", F.transform(F.slice(F.filter("h", lambda x: x["level"] == F.col("least")), 1, OUTLINE), lambda x: x["title"]).alias("outline"))


def truncated(text: Column, tokens: Column, mark: str = "… (cut)") -> Column:
    """A text cut to about so many tokens (3.6 characters each, 200 characters at least), back to the last paragraph or sentence beyond the half."""
    room = F.greatest(F.lit(200), F.floor(tokens * 3.6)).cast("int")
    head = F.substring(text, F.lit(1), room)
    para = F.regexp_extract(head, r"(?s)^(.*)\n\n", 1)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?…])\s", 1)
    kept = F.when(F.length(para) > room / 2, para).when(F.length(sentence) > room / 2, sentence).otherwise(head)
    return F.when(F.length(text) <= room, text).otherwise(F.concat(F.rtrim(kept), F.lit("\n\n" + mark)))


TERM = r"^(?:[-*+]\s+)?(?:\*\*([^*\n:]{2,48})\*\*|([\p{L}][^:,\n]{1,47}))\s*(?::|—|–|::)\s+(.+)$"


def definition_like(text: Column) -> Column:
    """12 to 320 characters, no item or quote, not begun in lower case, no open task, and a verb that defines or a sentence's end."""
    like = lambda p: F.regexp_like(text, F.lit(p))
    return F.length(text).between(12, 320) & ~like(r"^\s*(?:[-*+>]|\d+[.)])\s") & ~like(r"^\p{Ll}") & ~like(r"(?i)\b(?:todo|fixme|tbd)\b") & (like(r"(?i)\b(?:is|are|means|refers to|denotes|consists of|est|sont|désigne)\b") | like(r"[.!?…]$"))


def glossary(notes: DataFrame, most: int = 200, per_note: int = 3) -> DataFrame:
    """term, definition, path: lines 'term: definition' outside code, up to per_note a note; a term and a definition are each in one entry, the first by path and line."""
    at = outside_fences(lines_like(notes, TERM, "doc_id")).join(notes.select("doc_id", "path"), "doc_id")
    hit = at.select("path", "line_no", F.trim(F.coalesce(F.nullif(F.regexp_extract("line", TERM, 1), F.lit("")), F.regexp_extract("line", TERM, 2))).alias("term"), F.trim(F.regexp_extract("line", TERM, 3)).alias("definition"))
    hit = hit.where((F.length("term") > 1) & (F.size(F.split("term", r"\s+")) <= 4) & definition_like(F.col("definition")))
    order = F.struct("path", "line_no")
    hit = hit.withColumn("_n", F.row_number().over(W.partitionBy("path").orderBy("line_no"))).where(F.col("_n") <= per_note)
    hit = hit.groupBy(F.lower("term").alias("key")).agg(*(F.min_by(c, order).alias(c) for c in ("term", "definition", "path", "line_no")))
    hit = hit.groupBy(F.lower("definition").alias("_d")).agg(*(F.min_by(c, order).alias(c) for c in ("key", "term", "definition", "path")))
    return hit.orderBy("key").limit(most).select("term", "definition", "path")


def merged_lines(notes: DataFrame, groups: DataFrame) -> DataFrame:
    """group, line, path: the lines of a group's members that its representative and earlier members (by path) lack, compared with digits aside.

    groups: doc_id, component, representative. A line is looked up by (group, form), so a large group is spread over its forms.
    """
    g = need(groups, "doc_id", "component", "representative").join(notes.select("doc_id", "path", "text"), "doc_id")
    rows = lines(g, "component", "doc_id", "representative", "path").where(F.length(F.trim("line")) > 0).withColumn("form", T.normalize_template(F.col("line")))
    first = F.min(F.struct((F.col("doc_id") != F.col("representative")).alias("later"), "path", "line_no", "line")).alias("x")
    new = rows.where(F.length("form") > 0).groupBy("component", "form").agg(first).where("x.later")
    return new.select(F.col("component").alias("group"), "x.path", "x.line_no", "x.line")
