"""Choosing and ordering notes: globs, filters with reasons, the two query languages, value order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import cut


def glob_regex(pattern: str) -> str:
    """A glob as a regular expression over a whole path: * ** ? [a] [!a] {a,b}; a leading / anchors, a trailing / means all below."""
    p = pattern.lstrip("!").strip()
    anchored, p = p.startswith("/"), p.lstrip("/")
    if p.endswith("/"):
        p += "**"
    out, i, depth = "", 0, 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if p.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in p[i + 1 :]:
            end = p.index("]", i + 1)
            inner = p[i + 1 : end]
            out, i = out + ("[^" + re.escape(inner[1:]) + "]" if inner[:1] == "!" else "[" + inner.replace("\\", "\\\\") + "]"), end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return "^" + ("" if anchored else "(?:.*/)?") + out + ")" * depth + "$"


def glob_match(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches is a positive one. Case-insensitive."""
    out = F.lit(False)
    for p in patterns:
        out = F.when(F.regexp_like(F.lower(path), F.lit(glob_regex(p.lower()))), F.lit(not p.startswith("!"))).otherwise(out)
    return out


def tag_match(tags: Column, pattern: str) -> Column:
    """A tag equals the pattern, lies below it, or begins with what is before a trailing *."""
    p = pattern.lower().lstrip("#")
    if p.endswith("*"):
        return F.exists(tags, lambda t: F.lower(t).startswith(p[:-1]))
    return F.exists(tags, lambda t: (F.lower(t) == p) | F.lower(t).startswith(p + "/"))


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with ``reasons``: the names of the rules that drop a row (a null rule doesn't)."""
    return df.withColumn("reasons", F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))))


def value_score(signal: Column, centrality: Column, age_days: Column, words: Column, most_words: Column) -> Column:
    """Signal and centrality at 1, recency (half-life 180 days) at 0.6, length (log) at 0.3."""
    recency = F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / 180)
    length = F.log10(words + 1) / F.greatest(F.log10(most_words + 1), F.lit(1e-9))
    return signal + centrality + 0.6 * recency + 0.3 * length


def note_cap(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """df with ``action``: keep for the first ``most`` rows in order, drop for the rest. The top rows are found by a bounded top-k, and the rest joined to them, so no task sorts all rows."""
    top = df.orderBy(*order).limit(most).withColumn("_kept", F.lit(True))
    return df.join(F.broadcast(top.select("doc_id", "_kept")), "doc_id", "left").withColumn("action", F.when(F.col("_kept"), "keep").otherwise("drop")).drop("_kept")


# ---- the tabular language -------------------------------------------------------------------------------------------------------

_LEX = re.compile(r"""\s*(?:(?P<s>"[^"]*"|'[^']*')|(?P<l>\[\[[^\]]*\]\])|(?P<h>\#[\w/*-]+)|(?P<n>-?\d+(?:\.\d+)?)(?![\w-])|(?P<w>[A-Za-z_][\w.-]*)|(?P<o><=|>=|!=|[=<>(),!-]))""")


@dataclass
class Table:
    kind: str
    fields: list[tuple[str, str]] = field(default_factory=list)
    sources: list[tuple[bool, str, str]] = field(default_factory=list)
    any_source: bool = False
    where: list = field(default_factory=list)
    sort: tuple[str, bool] | None = None
    limit: int = 50


def parse_table(query: str) -> Table | None:
    """LIST or TABLE fields [AS label] FROM sources WHERE clauses SORT field LIMIT n; None for what the language lacks (GROUP BY, FLATTEN).

    Words in quotes are never keywords; a comment begins with // at the start of a line.
    """
    text, at, tokens = "\n".join(x for x in query.split("\n") if not x.lstrip().startswith("//")), 0, []
    while text[at:].strip():
        m = _LEX.match(text, at)
        if not m:
            return None
        kind = m.lastgroup
        tokens.append((kind, m.group(kind)))
        at = m.end()
    words = [v.upper() if k == "w" else "" for k, v in tokens]
    if not words or words[0] not in ("LIST", "TABLE") or "FLATTEN" in words or "GROUP" in words:
        return None
    q, i = Table(words[0].lower()), 1
    if words[i : i + 2] == ["WITHOUT", "ID"]:
        i += 2
    stops = ("FROM", "WHERE", "SORT", "LIMIT")
    while i < len(tokens) and words[i] not in stops:
        if tokens[i][0] == "w":
            name = tokens[i][1]
            label = name
            if i + 2 < len(tokens) and words[i + 1] == "AS":
                label = tokens[i + 2][1].strip("\"'")
                i += 2
            q.fields.append((name, label))
        i += 1
    while i < len(tokens):
        part, i = words[i], i + 1
        if part == "FROM":
            negative = False
            joins = []
            while i < len(tokens) and words[i] not in stops:
                k, v = tokens[i]
                if words[i] in ("AND", "OR"):
                    joins.append(words[i])
                elif k == "o" and v in "-!":
                    negative = True
                elif k in "hsl" or (k == "w" and v == "outgoing"):
                    out = k == "w"
                    while out and tokens[i][0] != "l":
                        i += 1
                    v = tokens[i][1]
                    q.sources.append((negative, "outgoing" if out else {"h": "tag", "s": "folder", "l": "note"}[k], v.strip("\"'#[]")))
                    negative = False
                    i += out and i + 1 < len(tokens) and tokens[i + 1][1] == ")"
                i += 1
            q.any_source = bool(joins) and "AND" not in joins
        elif part == "WHERE":
            clause: list = []
            while i < len(tokens) and words[i] not in stops:
                if words[i] == "AND":
                    q.where.append(clause)
                    clause = []
                else:
                    clause.append(tokens[i])
                i += 1
            q.where.append(clause)
        elif part == "SORT":
            name = tokens[i][1]
            i += 1
            down = i < len(tokens) and words[i] in ("DESC", "DESCENDING")
            q.sort = (name, down)
            while i < len(tokens) and words[i] not in stops:
                i += 1
        elif part == "LIMIT":
            q.limit = min(200, max(1, int(float(tokens[i][1]))))
            i += 1
    return q


def _clause(clause: list, columns: dict[str, Column], arrays: set[str]) -> Column:
    values = [v for _, v in clause]
    negative = values[0] == "!"
    if negative:
        clause, values = clause[1:], values[1:]
    if values[0].lower() == "contains":
        name, what = values[2].lower(), values[4].strip("\"'").lower()
        col = columns.get(name, F.lit(None).cast("string"))
        has = F.exists(col, lambda x: F.contains(F.lower(x), F.lit(what))) if name in arrays else F.contains(F.lower(col.cast("string")), F.lit(what))
        has = F.coalesce(has, F.lit(False))
        return ~has if negative else has
    col = columns.get(values[0].lower(), F.lit(None).cast("string"))
    if len(values) == 1:
        text = F.coalesce(col.cast("string"), F.lit(""))
        true = ~text.isin("", "false", "0", "[]")
        return ~true if negative else true
    op, (kind, raw) = values[1], clause[2]
    if raw.lower() == "null":
        return col.isNull() if op == "=" else col.isNotNull()
    if kind == "n":
        left, right = col.try_cast("double"), F.lit(float(raw))
    else:
        left, right = T.natural_key(col.cast("string")), T.natural_key(F.lit(raw.strip("\"'")))
    test = {"=": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
    return F.coalesce(test, F.lit(op == "!="))


def evaluate_table(q: Table, df: DataFrame, columns: dict[str, Column], arrays: set[str] = frozenset(), path: str = "path", tags: Column | None = None, outgoing: Column | None = None) -> DataFrame:
    """The query as a plan: rows of df filtered, cut to the first q.limit in order, with Note and the query's fields."""
    tests = []
    for negative, kind, v in q.sources:
        if kind == "tag":
            t = F.lit(False) if tags is None else F.coalesce(tag_match(tags, v), F.lit(False))
        elif kind == "folder":
            t = F.lower(F.col(path)).startswith(v.lower().rstrip("/") + "/")
        else:
            t = F.lit(False) if outgoing is None else F.coalesce(F.exists(outgoing, lambda x: F.lower(x) == v.lower()), F.lit(False))
        tests.append(~t if negative else t)
    if tests:
        df = df.where(reduce((lambda a, b: a | b) if q.any_source else (lambda a, b: a & b), tests))
    for clause in q.where:
        df = df.where(_clause(clause, columns, arrays))
    key = T.natural_key(F.col(path))
    order = [key.asc()]
    if q.sort:
        col = columns.get(q.sort[0].lower(), F.lit(None))
        number, text = col.try_cast("double"), T.natural_key(col.cast("string"))
        order = [number.desc_nulls_last(), text.desc_nulls_last(), key.desc()] if q.sort[1] else [number.asc_nulls_last(), text.asc_nulls_last(), key.asc()]
    cell = lambda c: F.coalesce(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("—"))
    return df.orderBy(*order).limit(q.limit).select(T.stem(F.col(path)).alias("Note"), *(cell(columns.get(n.lower(), F.lit(None))).alias(label) for n, label in q.fields))


# ---- the ranked search ----------------------------------------------------------------------------------------------------------


@dataclass
class Focus:
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    no_tags: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)
    has: list[tuple[str, bool]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    hops: int = 0


def parse_focus(query: str) -> Focus:
    q = Focus()
    for m in re.finditer(r'(-?)(?:(tag|path|title|has|hops):)?("[^"]*"|\S+)', query):
        negative, what, raw = m.group(1) == "-", m.group(2), m.group(3)
        v = raw.strip('"').lower()
        if what == "tag":
            (q.no_tags if negative else q.tags).append(v)
        elif what == "path" and not negative:
            q.paths.append(v)
        elif what == "title" and not negative:
            q.titles.append(v)
        elif what == "has":
            q.has.append((v, not negative))
        elif what == "hops":
            q.hops = min(3, int(v)) if v.isdigit() else 0
        elif raw.startswith('"') and not negative:
            q.phrases.append(v)
        else:
            for w in re.findall(r"[^\W_][^\W_'’-]*", v):
                if negative:
                    q.excluded.append(w)
                elif w not in T.STOP and not w.isdigit() and len(w) >= 2:
                    q.terms.append(w)
    return q


HOP = 0.25


def rank_by_focus(notes: DataFrame, key_terms: DataFrame, q: Focus, most: int = 20, tags: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """doc_id, score, matched of the best notes. Weights as the engine's search: keyword weight, +2.5 idf for a title word, 1 + 0.35 per further term; a phrase gives 1.5 of the mean idf in the title, 0.9 in the text.

    key_terms has doc_id, term, weight, df, of all notes; the terms of a query are few, so the join side is small by the query. tags:
    doc_id, tag, for tag: and -tag:. edges: a, b (paths), for hops:, by which notes that a found note is linked with get HOP**hop of its
    score. A query of phrases only is scored by them, one of filters only (or an empty one) keeps all that pass, in the order of paths.
    Excluded words may be in no title, path, tag or key term.
    """
    kt = cut(key_terms, "terms")
    total = notes.count()
    wanted = kt.where(F.col("term").isin(q.terms)) if q.terms else kt.limit(0)
    idf = wanted.groupBy("term").agg(F.log(1 + F.lit(float(total)) / (1 + F.max("df"))).alias("idf"))
    body = wanted.select("doc_id", "term", F.col("weight").alias("score"))
    title_words = notes.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(f"({T.TERM})")))).alias("term")).where(F.col("term").isin(q.terms or [""]))
    title = title_words.join(F.broadcast(idf), "term").select("doc_id", "term", (2.5 * F.col("idf")).alias("score"))
    per_term = body.union(title).groupBy("doc_id", "term").agg(F.sum("score").alias("score"))
    per_note = per_term.groupBy("doc_id").agg(F.sum("score").alias("score"), F.count("*").alias("matched"))
    score = F.col("score") * F.when(F.col("matched") > 1, 1 + 0.35 * (F.col("matched") - 1)).otherwise(1.0)
    per_note = per_note.select("doc_id", score.alias("score"), "matched")
    rules = F.lit(True)
    for p in q.phrases:
        rules = rules & (F.contains(F.lower("text"), F.lit(p)) | F.contains(F.lower("title"), F.lit(p)))
    for w in q.excluded:
        rules = rules & ~F.contains(F.lower("title"), F.lit(w)) & ~F.contains(F.lower("path"), F.lit(w))
    if q.paths:
        rules = rules & reduce(lambda a, b: a | b, [F.contains(F.lower("path"), F.lit(p)) for p in q.paths])
    if q.titles:
        rules = rules & reduce(lambda a, b: a | b, [F.contains(F.lower("title"), F.lit(p)) for p in q.titles])
    kinds = {"code": r"(?m)^ {0,3}(```|~~~)", "links": r"\[\[|\]\(", "tasks": r"(?m)^\s*[-*+] \[[ xX/?-]\] ", "tags": r"(?m)^tags:|(^|\s)#\p{L}", "embeds": r"!\[\[|!\[[^\]\n]*\]\(", "headings": r"(?m)^ {0,3}#{1,6}[ \t]"}
    for kind, wanted_ in q.has:
        if kind not in kinds:
            raise ValueError(f"has:{kind} is not known; there are {sorted(kinds)}")
        found = F.regexp_like("text", F.lit(kinds[kind]))
        rules = rules & (found if wanted_ else ~found)
    pool = notes.where(rules)
    if q.excluded:
        pool = pool.join(kt.where(F.col("term").isin(q.excluded)).select("doc_id"), "doc_id", "left_anti")
    if q.tags or q.no_tags:
        if tags is None:
            raise ValueError("a query with tag: needs the notes' tags")
        under = lambda t: (F.lower("tag") == t.lstrip("#")) | F.lower("tag").startswith(t.lstrip("#") + "/")
        for t in q.tags:
            pool = pool.join(tags.where(under(t)).select("doc_id"), "doc_id", "left_semi")
        for t in q.no_tags:
            pool = pool.join(tags.where(under(t)).select("doc_id"), "doc_id", "left_anti")
        if q.excluded:
            pool = pool.join(tags.where(F.lower("tag").isin(q.excluded)).select("doc_id"), "doc_id", "left_anti")
    pool = pool.select("doc_id", "path", *(c for c in ("title", "text") if q.phrases))
    if q.terms:
        out = pool.join(per_note, "doc_id")
        if q.phrases:
            mean = F.broadcast(idf.agg(F.coalesce(F.avg("idf"), F.lit(1.0)).alias("_i")))
            out = out.crossJoin(mean).withColumn("score", F.col("score") + F.col("_i") * _phrases(q.phrases))
    else:
        out = pool.withColumns({"score": _phrases(q.phrases), "matched": F.lit(0).cast("long")})
    out = out.select("doc_id", "path", "score", "matched")
    if q.hops and edges is not None and (q.terms or q.phrases):
        both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
        seen = front = cut(out, "found")
        ok = notes.select("doc_id", "path")
        if q.no_tags and tags is not None:
            for t in q.no_tags:
                ok = ok.join(tags.where(under(t)).select("doc_id"), "doc_id", "left_anti")
        for hop in range(1, q.hops + 1):
            next_ = front.join(both, F.col("path") == F.col("a")).groupBy(F.col("b").alias("path")).agg((F.max("score") * HOP**hop).alias("score"))
            front = cut(next_.join(seen.select("path"), "path", "left_anti").join(ok, "path").select("doc_id", "path", "score", F.lit(0).cast("long").alias("matched")), "front")
            seen = seen.union(front)
        out = seen
    return out.orderBy(F.desc(F.round("score", 9)), "path").limit(most).select("doc_id", "score", "matched")


def _phrases(phrases: list[str]) -> Column:
    """What phrases in the title or text add, in mean idfs."""
    one = lambda p: F.when(F.contains(F.lower("title"), F.lit(p)), 1.5).when(F.contains(F.lower("text"), F.lit(p)), 0.9).otherwise(0.0)
    return reduce(lambda a, b: a + b, [one(p) for p in phrases], F.lit(0.0))
