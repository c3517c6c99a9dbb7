"""Units of a bundle in six formats, split and chunked into parts, with the text around them.

A unit is a note as it stands in a part. Parts are never held in memory: they come out as rows (part, seq, text) in order, which a sink
writes partition by partition.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..profiles import Chunking
from ..shared import cut
from . import pack as P

#: Columns of a note that are rendered if they are there.
FIELDS = {"citation": "string", "title": "string", "tags": "array<string>", "words": "int", "tokens": "long", "updated": "date", "inbound": "long", "outbound": "long", "to": "array<string>", "from": "array<string>", "outside": "int", "related": "array<string>", "flags": "array<string>"}
FORMATS = ("markdown", "plain", "json", "jsonl", "xml", "html")


def complete(df: DataFrame) -> DataFrame:
    """path, text and all FIELDS; those that df lacks are null."""
    have = set(df.columns)
    return df.select("path", "text", *(F.col(f"`{c}`").cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in FIELDS.items()))


def _list(c: str, most: int) -> Column:
    return F.array_join(F.slice(c, 1, most), ", ")


def metadata_line() -> Column:
    """Path, words, up to 8 tags, date, links in and out with up to 6 of each, what is outside, up to 4 related, flags: what there is of them."""
    some = lambda c: F.size(c) > 0
    parts = [
        F.concat(F.lit("`"), "path", F.lit("`")),
        F.concat(F.col("words").cast("string"), F.lit(" words")),
        F.when(some("tags"), F.concat(F.lit("tags: "), _list("tags", 8))),
        F.concat(F.lit("updated "), F.col("updated").cast("string")),
        F.when(F.col("inbound") + F.col("outbound") > 0, F.concat(F.col("inbound").cast("string"), F.lit(" in / "), F.col("outbound").cast("string"), F.lit(" out"))),
        F.when(some("to"), F.concat(F.lit("links to: "), _list("to", 6))),
        F.when(some("from"), F.concat(F.lit("linked from: "), _list("from", 6))),
        F.when(F.col("outside") > 0, F.concat(F.col("outside").cast("string"), F.lit(" outside this bundle"))),
        F.when(some("related"), F.concat(F.lit("related: "), _list("related", 4))),
        F.when(some("flags"), _list("flags", 9)),
    ]
    return F.concat(F.lit("> "), F.array_join(F.array_compact(F.array(*parts)), " · "))


def heading() -> Column:
    return F.array_join(F.array_compact(F.array("citation", F.coalesce(F.nullif("title", F.lit("")), T.stem(F.col("path"))))), " · ")


def record() -> Column:
    """The JSON of a note; what is empty has no key."""
    filled = lambda c: F.when(F.size(c) > 0, F.col(f"`{c}`")).alias(c)
    links = F.struct("inbound", filled("to"), "outbound", filled("from"), F.when(F.col("outside") > 0, F.col("outside")).alias("outside"))
    return F.to_json(F.struct(F.col("citation").alias("id"), "path", F.nullif("title", F.lit("")).alias("title"), filled("tags"), F.col("updated").cast("string").alias("updated"), "words", "tokens", F.when(F.col("inbound").isNotNull(), links).alias("links"), filled("related"), filled("flags"), F.nullif("chunk", F.lit("")).alias("chunk"), F.nullif("text", F.lit("")).alias("content")))


def xml_unit() -> Column:
    x = lambda c: T.escape_xml(c.cast("string"))
    attribute = lambda name, c: F.coalesce(F.concat(F.lit(f' {name}="'), x(c), F.lit('"')), F.lit(""))
    scalar = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), x(c), F.lit(f"</{name}>")), F.lit(""))
    many = lambda name, c: F.when(F.size(c) > 0, F.concat(*(F.array_join(F.transform(c, lambda v: F.concat(F.lit(f"<{name}>"), x(v), F.lit(f"</{name}>"))), ""),))).otherwise("")
    wrap = lambda name, c: F.when(c != "", F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))).otherwise("")
    meta = F.concat(scalar("words", F.col("words")), scalar("tokens", F.col("tokens")), scalar("updated", F.col("updated")), F.coalesce(many("tag", "tags"), F.lit("")))
    relations = F.concat(F.coalesce(many("to", "to"), F.lit("")), F.coalesce(many("from", "from"), F.lit("")))
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.concat(F.lit("<document"), attribute("id", F.col("citation")), attribute("path", F.col("path")), attribute("title", F.nullif("title", F.lit(""))), attribute("chunk", F.nullif("chunk", F.lit(""))), F.lit(">"), wrap("metadata", meta), wrap("relations", relations), wrap("references", F.coalesce(many("related", "related"), F.lit(""))), F.lit("<content><![CDATA["), body, F.lit("]]></content></document>"))


@F.pandas_udf(StringType())
def _html(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    return P.html_articles(texts)


def unit(format_: str) -> Column:
    """The text of a unit, of the columns of ``complete`` and chunk ('2/3', or empty if the note is whole)."""
    text = F.coalesce("text", F.lit(""))
    part = F.when(F.coalesce("chunk", F.lit("")) != "", F.concat(F.lit(" ("), "chunk", F.lit(")"))).otherwise("")
    if format_ == "plain":
        rule = F.lit("=" * 78 + "\n")
        return F.concat(rule, F.upper(heading()), part, F.lit("\n"), rule, F.lit("\n"), T.strip_inline_markup(text))
    if format_ in ("json", "jsonl"):
        return record()
    if format_ == "xml":
        return xml_unit()
    if format_ == "html":
        return F.concat(F.lit("<article><h2>"), T.escape_xml(heading()), T.escape_xml(part), F.lit("</h2>"), _html(text), F.lit("</article>"))
    return F.concat(F.lit("## "), heading(), part, F.lit("\n"), metadata_line(), F.lit("\n\n"), text)


# ---- splitting ------------------------------------------------------------------------------------------------------------------


def tokens_of(text: str) -> int:
    """The estimate of functions.text.estimate_tokens for texts without CJK characters, to decide where a unit is cut."""
    symbols = len(_SYMBOL.findall(text))
    latin = max(0, len(text) - len(_SPACE.findall(text)) - symbols)
    return max(1, int(latin / 8 + 0.65 * len(_WORD.findall(text)) + 0.3 * symbols + 0.5)) if text else 0


_SYMBOL, _SPACE, _WORD = re.compile("[" + re.escape(T.SYMBOLS) + "]"), re.compile(r"[ \t\n\r]"), re.compile(r"[^\W_][\w'’.-]*")


def hard_split(text: str, limit: int) -> list[str]:
    """Pieces of about so many tokens at spaces, and within words that alone are more (3.6 characters a token)."""
    room, out, now = max(1, int(limit * 3.6)), [], ""
    for word in re.findall(r"\S+\s*|\s+", text):
        while len(word) > room:
            if now.strip():
                out.append(now.rstrip())
            out.append(word[:room])
            now, word = "", word[room:]
        if len(now) + len(word) > room and now.strip():
            out.append(now.rstrip())
            now = ""
        now += word
    return [*out, now.rstrip()] if now.strip() else out


def blocks(text: str, level: int) -> list[str]:
    """Paragraphs, begun anew at headings up to the level; what is in a code fence stays together."""
    from .transform import HEADING, segments

    out, now = [], []
    for code, rows in segments(text):
        if code:
            now += rows
            continue
        for line in rows:
            h = HEADING.match(line)
            if (h and len(h.group(1)) <= level) or not line.strip():
                if now:
                    out.append("\n".join(now))
                now = [line] if line.strip() else []
            else:
                now.append(line)
    return [*out, "\n".join(now)] if now else out


def split_unit(text: str, limit: int, overlap: int = 0, level: int = 2) -> list[str]:
    """Pieces of at most about ``limit`` tokens: at blocks, else at sentences, else hard; each begins with the last blocks of the one before that fit the overlap."""
    if tokens_of(text) <= limit:
        return [text]
    pieces = blocks(text, level)
    joint = "\n\n"
    if len(pieces) <= 1:
        pieces, joint = re.split(r"(?<=[.!?…])\s+", text), " "
    pieces = [x for b in pieces for x in ([b] if tokens_of(b) <= limit else hard_split(b, limit))]
    out, now, used = [], [], 0
    for b in pieces:
        n = tokens_of(b)
        if now and used + n > limit:
            out.append(joint.join(now))
            tail, left = [], overlap
            for x in reversed(now):  # a suffix that fits
                left -= tokens_of(x)
                if left < 0:
                    break
                tail.insert(0, x)
            now, used = tail, sum(map(tokens_of, tail))
            if used + n > limit:
                now, used = [], 0
        now.append(b)
        used += n
    return [*out, joint.join(now)] if now else out


def split_units(units: DataFrame, limit: int, overlap: int, level: int) -> DataFrame:
    """units (seq, text and others) with texts over the limit in pieces: piece (from 1), chunk ('1/3', empty for whole ones), tokens."""
    types = dict(units.dtypes)

    def run(batches):
        for b in batches:
            pieces = [split_unit(t, limit, overlap, level) if t is not None else [None] for t in b["text"]]
            at = [i for i, p in enumerate(pieces) for _ in p]
            out = b.iloc[at].reset_index(drop=True)
            out["text"] = [x for p in pieces for x in p]
            out["piece"] = [k + 1 for p in pieces for k in range(len(p))]
            out["chunk"] = [f"{k + 1}/{len(p)}" if len(p) > 1 else "" for p in pieces for k in range(len(p))]
            yield out

    schema = ", ".join(f"`{c}` {t}" for c, t in types.items()) + ", piece int, chunk string"
    return units.mapInPandas(run, schema).withColumn("tokens", T.estimate_tokens(F.col("text")))


# ---- chunking -------------------------------------------------------------------------------------------------------------------

#: A task fills about so many parts; a bundle of fewer is packed as one sequence.
PARTS_PER_TASK = 1000


def chunk(units: DataFrame, c: Chunking, overhead: int = 0) -> DataFrame:
    """units (seq, piece, path, tokens) with part (from 1), in order.

    single: one part; perNote: a part a note; perFolder: a part a folder. Else next-fit: a part is closed before the unit that would
    overflow it and when it is full. The text around units takes ``overhead`` of each part and is counted with the units too. Long orders
    are cut into stretches of PARTS_PER_TASK parts by running totals; each stretch is packed by itself, so at most one part a stretch is
    less full than it could be.
    """
    if c.mode == "perNote":
        return P.ordinals(units, [F.asc("seq"), F.asc("piece")]).withColumnRenamed("ordinal", "part")
    folder = T.parent(F.col("path"))
    if c.mode == "perFolder":
        firsts = units.groupBy(folder.alias("_f")).agg(F.min("seq").alias("seq"))
        numbered = P.ordinals(firsts, [F.asc("seq")]).select("_f", F.col("ordinal").alias("part"))
        return units.withColumn("_f", folder).join(numbered, "_f").drop("_f")
    limit = c.limit_tokens()
    if limit <= 0:
        return units.withColumn("part", F.lit(1).cast("long"))
    room = max(64, limit - overhead)
    order = [F.asc("seq"), F.asc("piece")]
    at = P.ordinals(units.select("seq", "piece", "tokens"), order, {"upto": F.col("tokens")})
    at = at.withColumn("block", F.floor((F.col("upto") - F.col("tokens")) / (room * PARTS_PER_TASK)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "piece"], kind="stable")
        part, used, held, out = 1, overhead, 0, []
        for t in pdf["tokens"].fillna(0):
            if held and used + t > room:
                part, used, held = part + 1, overhead, 0
            out.append(part)
            used, held = used + t, held + 1
            if used >= room:
                part, used, held = part + 1, overhead, 0
        return pdf.assign(local=out)[["block", "seq", "piece", "local"]]

    packed = cut(at.select("block", "seq", "piece", "tokens").groupBy("block").applyInPandas(run, "block long, seq long, piece int, local int"), "packed")
    size = packed.groupBy("block").agg(F.max("local").alias("n"))
    before = size.select("block", F.coalesce(F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return units.join(packed.join(F.broadcast(before), "block").select("seq", "piece", (F.col("_b") + F.col("local")).alias("part")), ["seq", "piece"])


def with_totals(units: DataFrame) -> DataFrame:
    """units with position and total within their part, and parts in all. A part's totals are a row a part, joined back."""
    per = units.groupBy("part").agg(F.count("*").alias("total"), F.sum("tokens").alias("part_tokens"))
    whole = per.agg(F.count("*").alias("parts"))
    first = units.groupBy("part").agg(F.min(F.struct("seq", "piece")).alias("_f"))
    return units.join(per, "part").join(first, "part").crossJoin(F.broadcast(whole)).withColumn("first", F.struct("seq", "piece") == F.col("_f")).drop("_f")


def volumes(part: Column, most_parts: int) -> Column:
    return F.floor((part - 1) / most_parts) + 1 if most_parts > 0 else F.lit(1)


CONTENTS = 300


def contents(units: DataFrame, most: int = CONTENTS) -> DataFrame:
    """folder, seq, entry: the first ``most`` notes in order, and a row that says how many more there are."""
    notes = units.where("piece = 1").select("seq", T.parent(F.col("path")).alias("folder"), heading().alias("entry"))
    more = notes.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.lit(None).cast("long").alias("seq"), F.lit("").alias("folder"), F.concat(F.lit("and "), (F.col("n") - most).cast("string"), F.lit(" more")).alias("entry"))
    return notes.orderBy("seq").limit(most).unionByName(more).select("folder", "seq", "entry")


_AROUND = {"json": ('{{"bundle": {bundle}, "documents": [', "]}}", ",\n"), "jsonl": ("{bundle}", '{{"end": true}}', "\n"), "xml": ('<?xml version="1.0" encoding="UTF-8"?>\n<bundle>', "</bundle>", "\n"), "html": ("<section>", "</section>", "\n")}


def assembled(units: DataFrame, format_: str, title: str, divider: str = "---") -> DataFrame:
    """part, seq, piece, text: the rows of every part in order. The first row of a part carries what stands before it, the last what stands after.

    json: one object with the documents; jsonl: the bundle's record, the documents, an end record; xml: prologue and root; markdown and
    plain: a title with 'Part n of m' if there are several, units parted by dividers.
    """
    u = with_totals(units.withColumn("unit", unit(format_)))
    last = u.groupBy("part").agg(F.max(F.struct("seq", "piece")).alias("_l"))
    u = u.join(last, "part").withColumn("last", F.struct("seq", "piece") == F.col("_l"))
    if format_ in ("markdown", "plain"):
        notice = F.when(F.col("parts") > 1, F.format_string("\n\nPart %d of %d", F.col("part").cast("long"), "parts")).otherwise("")
        head = F.concat(F.lit(("# " if format_ == "markdown" else "") + title), notice, F.lit("\n\n"))
        tail, joint = F.lit("\n"), F.lit(f"\n\n{divider}\n")
    else:
        before, after, between = _AROUND[format_]
        bundle = F.to_json(F.struct(F.lit(title).alias("title"), F.col("part").alias("part"), F.col("parts").alias("parts"), F.col("total").alias("documents")))
        pre, _, post = before.replace("{{", "{").replace("}}", "}").partition("{bundle}")
        head = F.concat(F.lit(pre), bundle, F.lit(post + "\n")) if "{bundle}" in before else F.lit(before + "\n")
        tail, joint = F.lit("\n" + after.replace("{{", "{").replace("}}", "}")), F.lit(between)
    text = F.concat(F.when(F.col("first"), head).otherwise(""), "unit", F.when(F.col("last"), tail).otherwise(joint))
    return u.select("part", "seq", "piece", "path", "tokens", text.alias("text"))


def page(title: str, body: str) -> str:
    """A standalone page with a field that filters its articles by their text."""
    script = "const q=document.getElementById('q');q.oninput=()=>document.querySelectorAll('article').forEach(a=>a.hidden=!a.textContent.toLowerCase().includes(q.value.toLowerCase()))"
    return f"<!doctype html><meta charset='utf-8'><title>{json.dumps(title)[1:-1].replace('<', '&lt;')}</title><input id='q' placeholder='filter'>{body}<script>{script}</script>"
