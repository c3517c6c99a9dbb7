"""Transforms of a note's text that need no state over lines, as Column builders. Patterns are shared by Java's and RE2's syntax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CALLOUT = (r"(?m)^> ?\[!([A-Za-z-]+)\][+-]?[ \t]*([^\n]*)$", "> **$1** $2")
TASK_BOX = (r"(?m)^([ \t]*[-*+]) \[[ xX/-]\] ", "$1 ")
DONE_TASK = (r"(?m)^[ \t]*[-*+] \[[xX]\] [^\n]*\n?", "")
EMBED = (r"!\[\[[^\]\n]*\]\]", "")
WIKI_LABEL = ((r"\[\[[^\]|\n]+\|([^\]\n]+)\]\]", "$1"), (r"\[\[([^\]\n]+)\]\]", "$1"))
EXTERNAL = (r"(^|[^!])\[([^\]\n]*)\]\(https?://[^)\s]*\)", "$1$2")
BARE_URL = (r"https?://[^\s)\]>]+", "")
INLINE_TAG = (r"(^|\s)#[A-Za-z][A-Za-z0-9_/-]*", "$1")
QUERY_BLOCK = (r"(?s)```(?:dataview|dataviewjs|query|tasks)\b.*?```", "")
IMAGE = (r"!\[[^\]\n]*\]\([^)\n]*\)", "")


def apply(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def shift_headings(text: Column, by: int) -> Column:
    """ATX headings one or more levels deeper, never below the sixth."""
    deeper = F.regexp_replace(text, r"(?m)^(#{1,6}) ", "#" * by + "$1 ")
    return F.regexp_replace(deeper, r"(?m)^#{7,12} ", "###### ")


def signal(prose_words: Column, links: Column, headings: Column, has_code: Column, list_lines: Column, task_lines: Column, lines: Column) -> Column:
    """How much a note has to say: length and structure less link, list and task density, between 0 and 1."""
    length = F.least(F.lit(1.0), F.log10(F.greatest(F.lit(1), prose_words) + 1) / 2.6)
    structure = F.least(F.lit(1.0), (headings * 0.12 + F.when(has_code, 0.25).otherwise(0.0)) / 0.9)
    ratio = F.when(prose_words > 0, 1.0).otherwise(0.0)
    density = F.when(prose_words > 0, links / F.greatest(F.lit(1.0), prose_words / 20)).otherwise(0.0)
    penalty = F.least(F.lit(0.55), density * 0.3 + list_lines / F.greatest(lines, F.lit(1)) * 0.2 + task_lines / F.greatest(lines, F.lit(1)) * 0.35)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), length * 0.5 + ratio * 0.24 + structure * 0.26 - penalty))
