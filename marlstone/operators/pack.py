"""Budget, packing and rendering of notes into parts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import cut

WORDS_TO_TOKENS = 1.35
CHARS_PER_TOKEN = 3.6


def part_limit_tokens(chars: Column, tokens: Column, words: Column) -> Column:
    """The strictest of the limits, in tokens; null limits don't count."""
    return F.least(F.floor(chars / CHARS_PER_TOKEN), tokens, F.ceil(words * WORDS_TO_TOKENS))


def running_total(df: DataFrame, value: Column, order: list[Column], name: str = "upto") -> DataFrame:
    """df with the sum of value over all rows up to each, in order."""
    return ordinals(df, order, {name: value}).drop("ordinal")


def citation_ids(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with ``citation`` S01, S02 ... in order."""
    return ordinals(df, order).withColumn("citation", F.format_string("S%02d", "ordinal")).drop("ordinal")


def ordinals(df: DataFrame, order: list[Column], totals: dict[str, Column] | None = None) -> DataFrame:
    """df with ``ordinal`` 1, 2 ... in order, and the running totals that are asked for.

    Rows are spread by ranges of the order, which are even whatever its values; each range is numbered and summed by itself and offset by
    those before it, of which there is a row a range. Rows equal in the whole order are in one range.
    """
    spark, totals = df.sparkSession, totals or {}
    names = [f"_v{i}" for i in range(len(totals))]
    part = df.withColumns({"_p": F.lit(0), **dict(zip(names, totals.values()))})
    part = part.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_p", F.spark_partition_id())
    part = cut(part, "ordered")
    w = W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sizes = part.groupBy("_p").agg(F.count("*").alias("_n"), *(F.sum(v).alias(v) for v in names))
    up = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("_p", *(F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"_b{c}") for c in ("_n", *names)))
    out = part.join(F.broadcast(before), "_p").withColumn("ordinal", F.col("_b_n") + F.count("*").over(w))
    out = out.withColumns({name: F.col(f"_b{v}") + F.sum(v).over(w) for name, v in zip(totals, names)})
    return out.drop("_p", "_b_n", *names, *(f"_b{v}" for v in names))


def budget_ladder(df: DataFrame, budget: int, tokens: str = "tokens", ratio: float = 0.35, per_note: int = 0) -> DataFrame:
    """df (doc_id, tokens, density) with ``action``: all full if they fit, else all summarised if that fits, else the least dense are dropped.

    The rungs are decided by two sums; what is kept on the last is a running total by density.
    """
    df = cut(df, "costs")  # read for the sums and in order
    cost = F.col(tokens) + per_note
    short = F.ceil(F.col(tokens) * ratio) + per_note
    whole = df.agg(F.sum(cost).alias("_full"), F.sum(short).alias("_short"))
    df = df.crossJoin(F.broadcast(whole))
    order = [F.desc("density"), F.asc("doc_id")]
    ranked = running_total(df, short, order)
    action = F.when(F.col("_full") <= budget, "full").when(F.col("_short") <= budget, "summarize").when(F.col("upto") <= budget, "summarize").otherwise("drop")
    return ranked.withColumn("action", action).drop("_full", "_short", "upto")


def next_fit(df: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """df's (group, order, size) with ``part`` (from 1): a part is closed before the item that would overflow it. Of each group in order.

    The order of a group is part of the result, so a group is one task's; it moves three numbers a row.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        part, used, out = 1, 0, []
        for s in pdf[size].fillna(0):
            if used and used + s > limit:
                part, used = part + 1, 0
            used += s
            out.append(part)
        return pdf.assign(part=out)

    types = dict(df.dtypes)
    return df.select(group, order, size).groupBy(group).applyInPandas(run, f"{group} {types[group]}, {order} {types[order]}, {size} {types[size]}, part int")


def limits_check(parts: DataFrame, limit: int, most_parts: int) -> DataFrame:
    """severity, parts, largest: error over a limit, warning over 90 % of the parts, else ok."""
    a = parts.agg(F.count_distinct("part").alias("parts"), F.max("used").alias("largest"))
    return a.select("parts", "largest", F.when((F.col("parts") > most_parts) | (F.col("largest") > limit), "error").when(F.col("parts") > 0.9 * most_parts, "warning").otherwise("ok").alias("severity"))


def json_record() -> Column:
    """One JSON object a note; keys that are null or empty are absent."""
    return F.to_json(F.struct(F.col("path"), F.nullif("title", F.lit("")).alias("title"), F.nullif("lang", F.lit("")).alias("lang"), F.nullif("text", F.lit("")).alias("content")))


def markdown_unit() -> Column:
    return F.concat(F.lit("## "), F.col("citation"), F.lit(" · "), F.col("title"), F.lit("\n> "), F.col("path"), F.lit("\n\n"), F.col("text"))


def xml_document() -> Column:
    body = F.replace("text", F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.concat(F.lit('<document path="'), T.escape_xml(F.col("path")), F.lit('" title="'), T.escape_xml(F.col("title")), F.lit('"><content><![CDATA['), body, F.lit("]]></content></document>"))


def plain_unit() -> Column:
    return F.concat(F.repeat(F.lit("="), 78), F.lit("\n"), F.upper("title"), F.lit("\n"), F.repeat(F.lit("="), 78), F.lit("\n\n"), T.strip_inline_markup(F.col("text")))


_HTML_LINE = ((r"^(#{1,6})\s+(.*)$", None), (r"^\s*[-*+]\s+(.*)$", "li"), (r"^>\s?(.*)$", "blockquote"))


def html_articles(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Markdown to HTML, for a pandas_udf: fences, headings, items, quotes, inline code, strong, emphasis, links."""
    import html
    import re

    def inline(s: str) -> str:
        s = html.escape(s, quote=False)
        for p, t in ((r"`([^`]+)`", r"<code>\1</code>"), (r"\*\*([^*]+)\*\*", r"<strong>\1</strong>"), (r"(?<!\w)[*_]([^*_]+)[*_](?!\w)", r"<em>\1</em>"), (r"\[([^\]]+)\]\((https?:[^)\s]+)\)", r'<a href="\2">\1</a>')):
            s = re.sub(p, t, s)
        return s

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        out, code, items = [], False, False
        for line in text.splitlines():
            if re.match(r"^\s*(```|~~~)", line):
                out.append("</code></pre>" if code else "<pre><code>")
                code = not code
                continue
            if code:
                out.append(html.escape(line, quote=False))
                continue
            item = re.match(r"^\s*[-*+]\s+(.*)$", line)
            if bool(item) != items:
                out.append("<ul>" if item else "</ul>")
                items = bool(item)
            head, quote = re.match(r"^(#{1,6})\s+(.*)$", line), re.match(r"^>\s?(.*)$", line)
            if item:
                out.append(f"<li>{inline(item[1])}</li>")
            elif head:
                out.append(f"<h{len(head[1])}>{inline(head[2])}</h{len(head[1])}>")
            elif quote:
                out.append(f"<blockquote>{inline(quote[1])}</blockquote>")
            elif line.strip():
                out.append(f"<p>{inline(line)}</p>")
        out += (["</ul>"] if items else []) + (["</code></pre>"] if code else [])
        return "\n".join(out)

    for s in texts:
        yield s.map(one)


SENTENCE = r"[^.!?…]+[.!?…]+"


def lead_summary(text: Column, sentences: int = 3) -> Column:
    """The first sentences; texts with fewer stay."""
    s = F.regexp_extract_all(text, F.lit(f"({SENTENCE})"))
    return F.when(F.size(s) <= sentences, text).otherwise(F.trim(F.array_join(F.transform(F.slice(s, 1, sentences), lambda x: F.trim(x)), " ")))


def assemble_parts(units: DataFrame, part: str = "part", order: str = "seq", content: str = "content") -> DataFrame:
    """part, text: the units of a part joined by dividers in order. A part's size is bounded by its limit."""
    return units.groupBy(part).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda x: x[content]), "\n\n---\n\n").alias("text"))
