"""One note's text made ready for a bundle: the ordered transforms that look at lines and fences, sections, blocks, transclusion.

Rules that need no state are Column builders in ``functions.transforms``; these here walk a note's lines once, in an Arrow-batched map
without shuffle. Other notes' texts come in by joins (``transclude``), never by a lookup on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import cut, need
from ..sources.frontmatter import parse
from . import links as L

FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})")
HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*$")
CALLOUT = re.compile(r"^> ?\[!([\w-]+)\][+-]?[ \t]*(.*)$")
TASK = re.compile(r"^(\s*(?:[-*+]|\d+[.)])\s+)\[([ xX/?-])\]\s+")
WIKI = re.compile(r"(!?)\[\[([^\[\]\n]+)\]\]")
MARK = re.compile(r"(!?)\[([^\]\n]*)\]\(([^)\n]+)\)")
FRONT = re.compile(r"\A---[ \t]*\r?\n(.*?)\r?\n(?:-{3,}|\.{3})[ \t]*(?:\r?\n|\Z)", re.S)
QUERY = ("dataview", "dataviewjs", "query", "tasks")
# Signs of callouts.
ICONS = {"note": "📝", "info": "ℹ️", "tip": "💡", "warning": "⚠️", "danger": "🛑", "question": "❓", "quote": "💬", "example": "📎", "success": "✅", "bug": "🐛", "todo": "☑️", "abstract": "📋"}
COLLAPSE, HEAD, TAIL = 40, 8, 4


@dataclass
class Options:
    """What is done to a note; the defaults are those of a plain bundle."""

    frontmatter: str = "card"  # strip, keep, card
    card_keys: list[str] = field(default_factory=list)  # all if empty
    comments: bool = True
    query_blocks: bool = True
    code: str = "keep"  # keep, collapse, remove
    title_once: bool = True
    level: int | None = 2  # the notes' own level; headings sit under it; None: as they are
    callouts: bool = True
    tasks: str = "keep"  # keep, clear, dropDone
    links: str = "label"  # keep, label, path, remove
    embeds: str = "reference"  # keep, reference, remove
    external: str = "keep"  # keep, label, strip
    images: str = "keep"  # keep, drop
    tags: str = "keep"  # keep, strip, hoist
    blank_lines: int = 1
    ensure_title: bool = True


COUNTERS = ("comments", "query_blocks", "code_collapsed", "callouts", "tasks", "links", "embeds", "tags")


def segments(text: str) -> Iterator[tuple[bool, list[str]]]:
    """Stretches of lines: (in code, lines); the fence lines belong to the code, an open fence reaches the end."""
    now, code, mark = [], False, ""
    for line in text.split("\n"):
        f = FENCE.match(line)
        if not code and f:
            if now:
                yield False, now
            now, code, mark = [line], True, f.group(1)
        elif code and f and f.group(1)[0] == mark[0] and len(f.group(1)) >= len(mark) and not line[f.end() :].strip():
            yield True, [*now, line]
            now, code = [], False
        else:
            now.append(line)
    if now:
        yield code, now


def split_front(text: str) -> tuple[str, str]:
    m = FRONT.match(text)
    return (m.group(), text[m.end() :]) if m else ("", text)


def card(text: str, keys: list[str]) -> str:
    """The frontmatter as a list of its plain values."""
    rows = []
    for k, v in parse(text).items():
        if (keys and k not in keys) or v in (None, "", [], {}):
            continue
        rows.append(f"- **{k}**: " + (", ".join(map(str, v)) if isinstance(v, list) else str(v)))
    return "\n".join(rows)


def label(inner: str) -> str:
    """What a wiki link shows: its alias, or the note's stem with › heading or (^block)."""
    to, bar, alias = inner.partition("|")
    if bar and alias.strip():
        return alias.strip()
    target, _, anchor = to.partition("#")
    name = re.sub(r"^(.+)\.[^.]*$", r"\1", target.strip().rsplit("/", 1)[-1]) if re.search(r"\.(md|markdown|mdx)$", target.strip()) else target.strip().rsplit("/", 1)[-1]
    anchor = anchor.strip()
    if anchor.startswith("^"):
        return f"{name} ({anchor})".strip()
    return f"{name} › {anchor}" if anchor and name else name or anchor


def _inline(line: str, o: Options, n: dict[str, int]) -> str:
    def wiki(m: re.Match) -> str:
        if m.group(1):
            n["embeds"] += 1
            return {"keep": m.group(), "reference": f"({label(m.group(2))})"}.get(o.embeds, "")
        n["links"] += 1
        if o.links == "path":
            return m.group(2).split("|")[0].split("#")[0].strip()
        return {"keep": m.group(), "label": label(m.group(2))}.get(o.links, "")

    def mark(m: re.Match) -> str:
        if m.group(1):
            return "" if o.images == "drop" else m.group()
        if not re.match(r"https?:", m.group(3)):
            return m.group()
        return {"label": m.group(2), "strip": ""}.get(o.external, m.group())

    parts = re.split(r"(`+[^`\n]*`+)", line)
    for i in range(0, len(parts), 2):  # code spans stay
        s = WIKI.sub(wiki, parts[i])
        s = MARK.sub(mark, s) if "](" in s else s
        if o.external == "strip":
            s = re.sub(r"(?<![(\[<\w])https?://[^\s<>()\"'\]]+", "", s)
        parts[i] = s
    return "".join(parts)


_TAG = re.compile(r"(^|[\s(>|,;:\[{])#([^\W\d_][\w/-]*)")


def transform(text: str, title: str, o: Options) -> tuple[str, dict[str, int]]:
    """The note's text after all transforms in order, and what was done."""
    n = dict.fromkeys(COUNTERS, 0)
    text = text.replace("\r\n", "\n")
    front, body = split_front(text)
    if o.comments:
        for p in (r"<%.*?%>", r"%%.*?%%", r"<!--.*?-->"):
            body, k = re.subn(p, "", body, flags=re.S)
            n["comments"] += k
    parts: list[tuple[bool, list[str]]] = []
    for code, lines in segments(body):
        if code:
            kind = lines[0].strip().strip("`~").strip().split(" ")[0].lower()
            if o.query_blocks and kind in QUERY:
                n["query_blocks"] += 1
                continue
            if o.code == "remove":
                continue
            if o.code == "collapse" and len(lines) - 2 > COLLAPSE:
                n["code_collapsed"] += 1
                hidden = len(lines) - 2 - HEAD - TAIL
                lines = [*lines[: 1 + HEAD], f"… {hidden} lines left out …", *lines[-1 - TAIL :]]
        parts.append((code, lines))
    shallow = min((len(h.group(1)) for code, lines in parts if not code for x in lines if (h := HEADING.match(x))), default=0)
    first, seen_tags, has_heading, out = True, [], False, []
    shift = None
    for code, lines in parts:
        if code:
            out += lines
            first = False
            continue
        in_callout = False
        for line in lines:
            h = HEADING.match(line)
            if h:
                plain = re.sub(r"[*_`]", "", h.group(2)).strip()
                if first and o.title_once and len(h.group(1)) == 1 and plain.casefold() == title.strip().casefold():
                    first = False
                    continue
                if shift is None:
                    left = [len(g.group(1)) for c, ls in parts if not c for x in ls if (g := HEADING.match(x)) and not (o.title_once and len(g.group(1)) == 1 and re.sub(r"[*_`]", "", g.group(2)).strip().casefold() == title.strip().casefold())]
                    shift = (o.level + 1 - min(left, default=shallow)) if o.level is not None else 0
                has_heading = True
                line = "#" * min(6, max(1, len(h.group(1)) + shift)) + " " + h.group(2)
            first = first and not line.strip()
            if o.callouts and (c := CALLOUT.match(line)):
                n["callouts"] += 1
                kind = c.group(1).lower()
                line = f"**{ICONS.get(kind, '▪️')} {c.group(2).strip() or kind.capitalize()}**"
                in_callout = True
            elif in_callout and line.startswith(">"):
                line = re.sub(r"^> ?", "", line)
            else:
                in_callout = False
            if t := TASK.match(line):
                if o.tasks == "dropDone" and t.group(2) in "xX":
                    n["tasks"] += 1
                    continue
                if o.tasks != "keep":
                    n["tasks"] += 1
                    line = t.group(1) + line[t.end() :]
            line = _inline(line, o, n)
            if o.tags != "keep" and not h:
                found = [m.group(2) for m in _TAG.finditer(line)]
                n["tags"] += len(found)
                seen_tags += found
                line = _TAG.sub(lambda m: m.group(1), line) if found else line
            out.append(line)
    done = "\n".join(out)
    done = re.sub(r"[ \t]+(?=\n|\Z)", "", done)
    done = re.sub(r"\n{%d,}" % (o.blank_lines + 2), "\n" * (o.blank_lines + 1), done).strip("\n")
    if o.tags == "hoist" and seen_tags:
        done = "Tags: " + ", ".join(dict.fromkeys(seen_tags)) + "\n\n" + done
    if o.ensure_title and title and not has_heading:
        done = "#" * (o.level or 1) + f" {title}\n\n" + done
    if front and o.frontmatter == "keep":
        done = front.rstrip("\n") + "\n\n" + done
    elif front and o.frontmatter == "card" and (c := card(text, o.card_keys)):
        done = c + "\n\n" + done
    return done.strip("\n"), n


def transformed(df: DataFrame, o: Options | None = None, id_: str = "doc_id", text: str = "text", title: str = "title") -> DataFrame:
    """id, text and the counters of every note. One map, no shuffle. Null texts stay null; a null title is none."""
    o = o or Options()
    rows = need(df, id_, text, title)
    kind = dict(rows.dtypes)[id_]

    def run(batches):
        for b in batches:
            done = [transform(t, x or "", o) if t is not None else (None, dict.fromkeys(COUNTERS, 0)) for t, x in zip(b[text], b[title])]
            yield pd.DataFrame({id_: b[id_], text: [t for t, _ in done], **{c: [n[c] for _, n in done] for c in COUNTERS}})

    return rows.mapInPandas(run, f"`{id_}` {kind}, `{text}` string, " + ", ".join(f"{c} int" for c in COUNTERS))


def section(text: str, heading: str) -> str | None:
    """From the heading (its case aside) up to the next one of its level or above; headings in code are none."""
    want, out, level = heading.strip().casefold(), [], 0
    for code, lines in segments(text):
        for line in lines:
            h = None if code else HEADING.match(line)
            if h and level and len(h.group(1)) <= level:
                return "\n".join(out).strip("\n")
            if h and not level and h.group(2).strip().casefold() == want:
                level = len(h.group(1))
            if level:
                out.append(line)
    return "\n".join(out).strip("\n") if level else None


def block(text: str, name: str) -> str | None:
    """The paragraph or item that ends with ^name, without that mark."""
    end = re.compile(rf"\s*\^{re.escape(name)}\s*$")
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if end.search(line):
            j = i
            if not re.match(r"\s*(?:[-*+]|\d+[.)])\s", line):
                while j and lines[j - 1].strip() and not HEADING.match(lines[j - 1]):
                    j -= 1
            return end.sub("", "\n".join(lines[j : i + 1])).strip("\n") or None
    return None


def expand(text: str, parts: list[dict], most: int) -> tuple[str, int]:
    """The text with its embeds replaced by what they show, as long as the result of all has no more than ``most`` characters."""
    by = {(p["target"], p["heading"], p["block"]): p["body"] for p in parts}
    used, done, out = 0, 0, []

    def put(m: re.Match) -> str:
        nonlocal used, done
        to = m.group(2).split("|")[0]
        target, _, anchor = to.partition("#")
        anchor = anchor.strip()
        key = (target.strip(), anchor if anchor and not anchor.startswith("^") else None, anchor[1:] if anchor.startswith("^") else None)
        body = by.get(key) if m.group(1) else None
        if body is None:
            return m.group()
        body = split_front(body)[1]
        shown = section(body, key[1]) if key[1] else block(body, key[2]) if key[2] else body.strip("\n")
        if shown is None or used + len(shown) > most:
            return m.group()
        used += len(shown)
        done += 1
        return shown

    for code, lines in segments(text):
        s = "\n".join(lines)
        out.append(s if code else WIKI.sub(put, s))
    return "\n".join(out), done


def transclude(notes: DataFrame, known: DataFrame, depth: int = 2, most: int = 20_000) -> DataFrame:
    """path, text, transclusions: texts in which embeds of notes, sections and blocks are replaced, and embeds within those up to depth.

    Each level is an equi-join of the embeds with the texts of the level below, so a note's embeds of embeds are already in what it shows;
    a note doesn't embed itself. notes: path, text; known: links.owners(). A note that very many embed is one row of the smaller side.
    """
    notes = cut(need(notes, "path", "text"), "embedding")
    refs = L.extract(notes, "path").where(F.col("embed") & ~F.col("external") & (F.length("target") > 0)).select(F.col("path").alias("a"), "target", "heading", "block").distinct()
    ext = T.extension(F.col("target"))
    refs = cut(refs.where((ext == "") | ext.isin(*L.NOTE_EXTENSIONS)), "embeds")
    refs = cut(refs.join(L.resolve(refs.select("a", "target"), known), ["a", "target"]).where(F.col("b").isNotNull() & (F.col("a") != F.col("b"))), "embeds")

    def run(batches):
        for b in batches:
            done = [expand(t, list(p), most) if t is not None and p is not None else (t, 0) for t, p in zip(b["text"], b["parts"])]
            yield pd.DataFrame({"path": b["path"], "text": [t for t, _ in done], "transclusions": [n for _, n in done]})

    now = notes.withColumn("transclusions", F.lit(0))
    for _ in range(depth):
        shown = refs.join(now.select(F.col("path").alias("b"), F.col("text").alias("body")), "b")
        parts = shown.groupBy(F.col("a").alias("path")).agg(F.collect_list(F.struct("target", "heading", "block", "body")).alias("parts"))  # what one note embeds
        now = cut(notes.join(parts, "path", "left").mapInPandas(run, "path string, text string, transclusions int"), "expanded")
    return now
