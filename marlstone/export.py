"""An export from notes to a bundle of parts: candidates, filters, condensing, transforms, order, budget, rendering, files, report."""

from __future__ import annotations

import datetime as dt
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import text as T
from .functions import transforms as X
from .operators import condense as C
from .operators import graph as G
from .operators import intel as I
from .operators import links as L
from .operators import notes as N
from .operators import pack as P
from .operators import render as R
from .operators import select as S
from .operators.incremental import content_hash
from .operators.transform import transclude, transformed
from .profiles import Profile
from .shared import cut, fs, need

NOTE_FILES, TEXT_FILES = ("md", "markdown", "mdx", "canvas"), ("txt", "text", "csv", "org", "tex")


def inside(path: Column, root: str) -> Column:
    r = root.strip("/").lower()
    return F.lit(True) if not r else (F.lower(path) == r) | F.lower(path).startswith(r + "/")


def candidates(files: DataFrame, p: Profile, own_folder: str | None = None) -> DataFrame:
    """files with ``reasons``: why a file is no candidate (none if it is one). files: path, size (may be null).

    Extension, the bundle's own folder, roots, depth below the root, globs on the whole path or the part below the root, path pattern
    (one that is no valid expression keeps everything), size.
    """
    path, ext = F.col("path"), T.extension(F.col("path"))
    roots = [r.strip("/") for r in p.roots if r.strip("/")]
    below = path
    for r in roots:
        below = F.when(F.lower(path).startswith(r.lower() + "/"), F.substring(path, F.lit(len(r) + 2), F.length(path))).otherwise(below)
    in_root = F.lit(not roots)
    for r in roots:
        in_root = in_root | inside(path, r)
    listed = S.glob_match(path, list(p.include)) | S.glob_match(below, list(p.include)) if p.include else F.lit(True)
    excluded = S.glob_match(path, list(p.exclude)) | S.glob_match(below, list(p.exclude)) if p.exclude else F.lit(False)
    rules = {
        "extension": ~ext.isin(*NOTE_FILES, *(TEXT_FILES if p.text_files else ())),
        "own output": inside(path, own_folder) if own_folder else F.lit(False),
        "outside the roots": ~in_root,
        "too deep": F.size(F.split(below, "/")) > p.depth + 1 if p.depth >= 0 else F.lit(False),
        "not included": ~listed,
        "excluded": excluded,
        "too large": F.col("size") > p.max_bytes,
    }
    if p.path_regex:
        try:
            re.compile(p.path_regex)
            rules["path pattern"] = ~F.regexp_like("path", F.lit(p.path_regex))
        except re.error:
            pass
    return S.with_reasons(files, rules)


def title_of(text: Column, path: Column) -> Column:
    """The frontmatter's title or name, else the first heading of the first level, else the stem."""
    given = F.regexp_extract(N.frontmatter(text), r"(?mi)^(?:title|name):[ \t]*[\"']?([^\r\n]*?)[\"']?[ \t]*\r?$", 1)
    head = F.trim(F.regexp_extract(text, r"(?m)^ {0,3}#[ \t]+([^\r\n]+?)[ \t#]*\r?$", 1))
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(head, F.lit("")), T.stem(path))


def all_tags(notes: DataFrame) -> DataFrame:
    """doc_id, tags: those of the frontmatter and of the text, each once, sorted."""
    t = N.tags(notes, "doc_id").unionByName(L.inline_tags(notes, "doc_id")).distinct()
    return t.groupBy("doc_id").agg(F.sort_array(F.collect_list("tag")).alias("tags"))  # of one note


def template(text: str, values: dict[str, Column]) -> Column:
    """{{key}} or {{key:argument}} by the value; unknown keys are empty."""
    parts = []
    for literal, key in re.findall(r"([^{]+|\{(?!\{))|\{\{\s*(\w+)[^}]*\}\}", text):
        parts.append(F.lit(literal) if literal else F.coalesce(values.get(key, F.lit("")).cast("string"), F.lit("")))
    return F.concat(F.lit(""), *parts)


def output_names(parts: DataFrame, p: Profile, title: str, day: str, extension: str) -> DataFrame:
    """part, name: by the profile's template; segments hold no signs that files can't and can't leave the folder, names used twice get -2, -3, ..."""
    values = {"folder": F.lit(title), "title": F.lit(title), "profile": F.lit(p.id), "date": F.lit(day), "part": F.col("part"), "note_path": F.regexp_replace("path", r"\.[^./]*$", "")}
    first = parts.groupBy("part").agg(F.min_by("path", F.struct("seq", "piece")).alias("path"))
    count = first.agg(F.count("*").alias("n"))
    raw = template(p.name, values)
    needs = "part" not in re.findall(r"\{\{\s*(\w+)", p.name) and "note_path" not in p.name
    if needs:
        raw = F.concat(raw, F.when(F.col("n") > 1, F.concat(F.lit(" - part "), F.col("part").cast("string"))).otherwise(""))
    safe = F.array_join(F.filter(F.transform(F.split(raw, "/"), lambda s: T.sanitize_file_name(s, "")), lambda s: ~s.isin("", ".", "..")), "/")
    volume = R.volumes(F.col("part"), p.limits.parts)
    named = first.crossJoin(F.broadcast(count)).select("part", F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("untitled")), F.when(volume > 1, F.concat(F.lit("-v"), volume.cast("string"))).otherwise("")).alias("name"))
    again = F.row_number().over(W.partitionBy(F.lower("name")).orderBy("part"))
    return named.select("part", F.concat("name", F.when(again > 1, F.concat(F.lit("-"), again.cast("string"))).otherwise(""), F.lit("." + extension)).alias("name"))


EXTENSIONS = {"markdown": "md", "plain": "txt", "json": "json", "jsonl": "jsonl", "xml": "xml", "html": "html"}


@dataclass
class Bundle:
    """parts: part, seq, piece, path, tokens, text in order. notes: what is in it. left_out: path, reasons. names: part, name."""

    profile: Profile
    parts: DataFrame
    notes: DataFrame
    left_out: DataFrame
    names: DataFrame
    stats: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def _signal(text: Column) -> Column:
    c = lambda p: T.count(text, p)
    return X.signal(T.count_words(text), c(r"\[\[[^\]\n]+\]\]"), c(r"(?m)^ {0,3}#{1,6} "), c(r"(?m)^\s*(?:```|~~~)") > 0, c(r"(?m)^\s*[-*+] "), c(r"(?m)^\s*[-*+] \[[ xX/-]\] "), F.size(F.split(text, "\n", -1)))


def _filters(n: DataFrame, p: Profile, as_of: dt.datetime) -> DataFrame:
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    has = lambda t: F.coalesce(S.tag_match(tags, t), F.lit(False))
    any_ = F.lit(not p.tags_any)
    for t in p.tags_any:
        any_ = any_ | has(t)
    rules = {"short": F.col("words") < p.min_words, "long": F.col("words") > p.max_words if p.max_words else F.lit(False)}
    for t in p.tags_all:
        rules[f"no tag {t}"] = ~has(t)
    rules["none of the tags"] = ~any_
    for t in p.tags_none:
        rules[f"tag {t}"] = has(t)
    if p.modified_days is not None:
        rules["old"] = F.coalesce(F.col("mtime") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {p.modified_days} DAYS"), F.lit(True))
    if p.required_key:
        rules[f"no {p.required_key}"] = ~F.regexp_like(N.frontmatter(F.col("text")), F.lit(rf"(?mi)^{re.escape(p.required_key)}:[ \t]*[^\s~][^\n]*$"))
    if p.stub_words:
        # a stub has few words and little more than links
        prose = F.length(F.regexp_replace(F.col("text"), L.WIKI, ""))
        rules["stub"] = (F.col("words") <= p.stub_words) & (prose <= max(120, 4 * p.stub_words)) & (F.regexp_like("text", F.lit(r"\[\[[^\]\n]+\]\]")) | (F.col("words") <= 3))
    return S.with_reasons(n, rules)


def run_export(files: DataFrame, p: Profile, title: str = "notes", as_of: dt.datetime | None = None, own_folder: str | None = None, least_neighbour: float = 0.35) -> Bundle:
    """The bundle of a collection as plans and a few written tables. files: path, text, and mtime and size if known.

    Notes are numbered in the order of paths, so no result depends on the order of files. Nothing but counts and short lists reaches the driver.
    """
    as_of = as_of or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    have = set(files.columns)
    f = files.select("path", F.col("text").cast("string").alias("text"), (F.col("mtime") if "mtime" in have else F.lit(None)).cast("timestamp").alias("mtime"), (F.col("size") if "size" in have else F.octet_length("text")).cast("long").alias("size")).where(F.col("path").isNotNull())
    f = f.groupBy("path").agg(F.max_by(F.struct("text", "mtime", "size"), F.struct("mtime", "text")).alias("x")).select("path", "x.*")
    asked = cut(candidates(f, p, own_folder), "asked")
    n = P.ordinals(asked.where((F.size("reasons") == 0) & F.col("text").isNotNull()).drop("reasons"), [T.natural_order(F.col("path")).asc(), F.asc("path")]).withColumnRenamed("ordinal", "doc_id")
    n = n.withColumns({"title": title_of(F.col("text"), F.col("path")), "folder": T.parent(F.col("path")), "stem": T.stem(F.col("path"))})
    n = cut(n.withColumns({"words": T.count_words(F.col("text")), "signal": _signal(F.col("text"))}), "notes")
    tagged = cut(n.join(all_tags(n), "doc_id", "left"), "tagged")
    judged = cut(_filters(tagged, p, as_of), "judged")
    kept = judged.where(F.size("reasons") == 0).drop("reasons")
    left = [asked.where(F.size("reasons") > 0).select("path", "reasons"), judged.where(F.size("reasons") > 0).select("path", "reasons")]
    resolved = cut(L.resolve(L.internal(n, "path").select(F.col("path").alias("a"), "target"), L.owners(n)), "resolved")
    edges = cut(L.edges(resolved), "edges")
    if p.focus:
        ranked = S.rank_by_focus(kept, N.key_terms(kept), S.parse_focus(p.focus), p.max_notes or 1_000_000_000, N.tags(kept, "doc_id").unionByName(L.inline_tags(kept, "doc_id")).distinct(), edges)
        ranked = cut(ranked.select("doc_id", "score"), "focus")
        left.append(kept.join(ranked, "doc_id", "left_anti").select("path", F.array(F.lit("not in focus")).alias("reasons")))
        kept = kept.join(ranked, "doc_id")
    if p.dedupe != "off":
        groups = cut(I.similar_groups(kept.where(F.col("words") >= p.dedupe_words).select("doc_id", "text"), p.threshold, 8), "groups")
        sized = groups.join(kept.select("doc_id", "words", "path", "signal", "mtime"), "doc_id")
        worth = F.col("words") + 100 * F.col("signal") + F.least(F.coalesce(F.unix_millis("mtime"), F.lit(0)), F.lit(4_000_000_000_000)) / 1e10
        best = sized.groupBy("component").agg(F.max_by(F.struct("doc_id", "path"), F.struct(worth, -F.col("doc_id"))).alias("r"))
        out = cut(sized.join(best, "component").where(F.col("doc_id") != F.col("r.doc_id")).select("doc_id", F.col("path").alias("_p"), F.col("r.path").alias("of")), "duplicates")
        if p.dedupe == "merge":
            new = C.merged_lines(kept, sized.join(best, "component").select("doc_id", "component", F.col("r.doc_id").alias("representative")))
            text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "line_no", "line"))), lambda x: x["line"]), "\n")
            more = new.groupBy("group", "path").agg(F.concat(F.lit("\n\nAlso in "), F.col("path"), F.lit(":\n"), text).alias("m")).groupBy("group").agg(F.array_join(F.sort_array(F.collect_list("m")), "").alias("m"))
            more = more.join(best, F.col("group") == F.col("component")).select(F.col("r.doc_id").alias("doc_id"), "m")
            kept = kept.join(more, "doc_id", "left").withColumn("text", F.concat("text", F.coalesce("m", F.lit("")))).drop("m")
        left.append(out.select(F.col("_p").alias("path"), F.array(F.concat(F.lit("duplicate of "), "of")).alias("reasons")))
        kept = kept.join(out.select("doc_id"), "doc_id", "left_anti")
    kept = cut(kept, "kept")
    body = kept.select("doc_id", "path", "title", "text")
    if p.boilerplate:
        # lines are counted over all notes, those left out too
        hits = C.without_boilerplate(n.select("doc_id", "text"))
        body = body.drop("text").join(hits.select("doc_id", "text", F.col("removed").alias("boilerplate")), "doc_id")
    if p.transclude:
        shown = transclude(n.select("path", "text").join(body.select("path", F.col("text").alias("_t")), "path", "left").select("path", F.coalesce("_t", "text").alias("text")), L.owners(n))
        body = body.drop("text").join(shown, "path")
    body = cut(body, "body")
    done = transformed(body, p.transform).select("doc_id", "text")
    if p.redact:
        done = done.withColumn("text", I.redact(F.col("text")))
    done = cut(done.withColumns({"words": T.count_words(F.col("text")), "tokens": T.estimate_tokens(F.col("text"))}), "done")
    rank = G.pagerank(n.select(F.col("path").alias("node")), edges)
    meta = cut(kept.drop("text", "words").join(rank.withColumnRenamed("node", "path").withColumnRenamed("rank", "centrality"), "path").join(done, "doc_id"), "meta")
    most = meta.agg(F.max("words").alias("_m"))
    age = F.coalesce(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("mtime"), F.lit(86400 * 3650)) / 86400
    meta = meta.crossJoin(F.broadcast(most)).withColumn("value", S.value_score(F.col("signal"), F.col("centrality"), age, F.col("words"), F.col("_m"))).drop("_m")
    key = {"path": T.natural_order(F.col("path")), "title": T.natural_order(F.col("title")), "modified": F.col("mtime"), "words": F.col("words"), "value": F.col("value"), "signal": F.col("signal"), "centrality": F.col("centrality")}[p.order]
    order = [key.desc_nulls_last() if p.descending else key.asc_nulls_last(), F.asc("doc_id")]
    meta = P.ordinals(meta, order).withColumnRenamed("ordinal", "seq")
    if p.max_notes:
        left.append(meta.where(F.col("seq") > p.max_notes).select("path", F.array(F.lit("over the number of notes")).alias("reasons")))
        meta = meta.where(F.col("seq") <= p.max_notes)
    meta = cut(meta, "ordered").withColumn("action", F.lit("full"))
    if p.budget:
        dense = (F.col("signal") + 0.3 * F.log10(F.col("words") + 10)) / F.greatest(F.col("tokens"), F.lit(1))
        meta = cut(P.budget_ladder(meta.withColumn("density", F.round(dense, 9)), p.budget, ratio=p.summary_ratio).drop("density"), "budget")
        left.append(meta.where("action = 'drop'").select("path", F.array(F.lit("over the budget")).alias("reasons")))
        meta = meta.where("action <> 'drop'")
    if p.summary and p.budget:
        short = C.summaries(meta.where("action = 'summarize'").select("doc_id", "text"), p.summary, p.summary_ratio, p.summary_sentences, p.summary_words)
        meta = meta.join(short, "doc_id", "left").withColumns({"text": F.when(F.col("shortened"), F.col("summary")).otherwise(F.col("text")), "flags": F.when(F.col("shortened"), F.array(F.lit("summary")))}).drop("summary", "shortened")
        meta = meta.withColumn("tokens", T.estimate_tokens(F.col("text")))
    inner = edges.join(meta.select(F.col("path").alias("a")), "a", "left_semi").join(meta.select(F.col("path").alias("b")), "b", "left_semi")
    ends = lambda a, b, name: inner.groupBy(F.col(a).alias("path")).agg(F.sort_array(F.slice(F.sort_array(F.collect_set(T.stem(F.col(b)))), 1, 50)).alias(name), F.count("*").alias(f"_{name}"))
    outside = resolved.where("b IS NULL").groupBy(F.col("a").alias("path")).agg(F.count("*").cast("int").alias("outside"))
    meta = meta.join(ends("a", "b", "to"), "path", "left").join(ends("b", "a", "from"), "path", "left").join(outside, "path", "left")
    meta = meta.withColumns({"outbound": F.coalesce("_to", F.lit(0)), "inbound": F.coalesce("_from", F.lit(0)), "updated": F.to_date("mtime"), "citation": F.format_string("S%02d", "seq") if p.citation_ids else F.lit(None).cast("string")})
    meta = cut(meta.drop("_to", "_from"), "meta")
    units = R.complete(meta).join(meta.select("path", "seq"), "path")
    limit = p.chunking.limit_tokens()
    overhead = 400
    if limit:
        units = R.split_units(units, max(64, limit - overhead), p.chunking.overlap, p.chunking.level)
    else:
        units = units.withColumns({"piece": F.lit(1), "chunk": F.lit("")})
    units = cut(units, "units")
    units = cut(R.chunk(units, p.chunking, min(overhead, limit // 4) if limit else 0), "chunked")
    parts = cut(R.assembled(units, p.format, title), "parts")
    left_out = cut(_union(left), "left")
    bundle = Bundle(p, parts, meta.join(units.groupBy("path").agg(F.min("part").alias("part")), "path"), left_out, output_names(units, p, title, f"{as_of:%Y-%m-%d}", EXTENSIONS[p.format]))
    _measure(bundle, f)
    return bundle


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _measure(b: Bundle, files: DataFrame) -> None:
    """Counts, and what of the destination's limits is broken."""
    size = b.parts.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(T.count_words(F.col("text"))).alias("words"))
    s = size.agg(F.count("*").alias("parts"), F.max("tokens").alias("most_tokens"), F.max("bytes").alias("most_bytes"), F.max("words").alias("most_words")).first()
    k = b.notes.agg(F.count("*").alias("kept"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    b.stats = {"discovered": files.count(), **k.asDict(), **{c: v or 0 for c, v in s.asDict().items()}, "left_out": b.left_out.count()}
    m, lim = b.stats, b.profile.limits
    over = [
        (lim.parts and m["parts"] > lim.parts, "error", f"{m['parts']} parts, {lim.label} takes {lim.parts}"),
        (lim.parts and lim.parts * 0.9 < m["parts"] <= lim.parts, "info", f"{m['parts']} of {lim.parts} parts used"),
        (lim.words_per_part and m["most_words"] > lim.words_per_part, "error", f"a part has {m['most_words']} words, the limit is {lim.words_per_part}"),
        (lim.tokens_per_part and m["most_tokens"] > lim.tokens_per_part, "warning", f"a part has about {m['most_tokens']} tokens, the limit is {lim.tokens_per_part}"),
        (lim.megabytes_per_part and m["most_bytes"] > lim.megabytes_per_part * 1024 * 1024, "error", f"a part is over {lim.megabytes_per_part} MB"),
        (lim.total_words and m["words"] > lim.total_words, "error", f"{m['words']} words in all, the limit is {lim.total_words}"),
        (lim.total_tokens and m["tokens"] > lim.total_tokens, "warning", f"about {m['tokens']} tokens in all, the limit is {lim.total_tokens}"),
    ]
    b.warnings = [f"{severity}: {text}" for bad, severity, text in over if bad]


def manifest(b: Bundle) -> DataFrame:
    """path, hash (of the text as read), words, tokens, part, citation of all notes in the bundle: what the next run compares with."""
    return b.notes.select("path", content_hash(F.col("text")).alias("hash"), "words", "tokens", "part", "citation")


LISTED = 8


def report(b: Bundle) -> str:
    """What was exported, what was left out and why, what was cleaned, and the checks. Lists have at most LISTED entries."""
    why = b.left_out.select(F.explode("reasons").alias("r")).select(F.when(F.col("r").startswith("duplicate of"), "duplicate").otherwise(F.col("r")).alias("r")).groupBy("r").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "r").limit(LISTED).collect()
    secrets = I.scan_secrets(b.notes.select("doc_id", "text")).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").collect()  # a row a kind
    top = b.notes.orderBy(F.desc("tokens"), "path").limit(LISTED).select("path", "tokens").collect()
    lines = [f"# Report of {b.profile.id}", "", "## Exported", "", f"{b.stats['kept']} notes, {T_count(b.stats['words'])} words, about {T_count(b.stats['tokens'])} tokens in {b.stats['parts']} parts."]
    lines += ["", "Largest notes:", *(f"- {r.path} ({T_count(r.tokens)})" for r in top)] if top else []
    lines += ["", "## Left out", "", *(f"- {r.r}: {r.n}" for r in why)] if why else []
    lines += ["", "## Credentials", "", *(f"- {r.kind}: {r.n}" for r in secrets)] if secrets else []
    lines += ["", "## Checks", "", *(f"- {w}" for w in b.warnings or ["all limits kept"])]
    return "\n".join(lines) + "\n"


def T_count(n: int) -> str:
    return f"{n / 1_000_000:.1f}M" if n >= 1_000_000 else f"{n / 1_000:.1f}k" if n >= 1_000 else str(n)


INSTRUCTIONS = 10_000


def instructions(b: Bundle) -> str:
    """How to use the bundle, from what was counted; at most INSTRUCTIONS characters."""
    asks = N.open_items(b.notes.select("doc_id", "text")).where("kind = 'question'").orderBy(F.desc("high"), F.desc("notes"), "text").limit(6).collect()
    lines = [f"This bundle has {b.stats['kept']} notes ({T_count(b.stats['words'])} words) in {b.stats['parts']} part(s)."]
    if b.profile.citation_ids:
        lines.append("Each note has an id (S01, S02, ...): name it when you say something from that note.")
    lines.append("If the notes don't answer a question, say so.")
    lines += ["", "Open questions in the notes:", *(f"- {r.text}" for r in asks)] if asks else []
    return "\n".join(lines)[:INSTRUCTIONS] + "\n"


def part_index(b: Bundle, most: int = 300) -> str:
    """The parts and their first notes, if there are several."""
    if b.stats["parts"] < 2:
        return ""
    rows = b.names.join(b.notes.groupBy("part").agg(F.count("*").alias("n"), F.min_by("title", "seq").alias("first")), "part").orderBy("part").limit(most).collect()
    return "\n".join(["# Parts", "", *(f"- [[{r.name}]]: {r.n} notes, from {r.first}" for r in rows)]) + "\n"


def write(spark: SparkSession, b: Bundle, folder: str) -> list[str]:
    """Writes the parts under their names, and beside them what the profile asks for. All of it appears by renames after everything is written.

    Rows are sorted by ranges, so a part of any size is written by as many tasks as it needs: one file a part, or a folder of files in
    order where a part is larger than a task.
    """
    system, root = fs(spark, folder)
    jvm = spark.sparkContext._jvm
    to = lambda x: jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{x}")
    draft = "_draft"
    b.parts.repartitionByRange("part", "seq", "piece").sortWithinPartitions("part", "seq", "piece").select("part", F.regexp_replace("text", "\n$", "").alias("text")).write.mode("overwrite").partitionBy("part").option("lineSep", "\n").text(f"{folder.rstrip('/')}/{draft}")
    written = []
    for r in b.names.orderBy("part").toLocalIterator():
        files = sorted((s.getPath() for s in system.listStatus(to(f"{draft}/part={r.part}")) if not s.getPath().getName().startswith("_")), key=lambda x: x.getName())
        goal = to(r.name)
        system.mkdirs(goal.getParent())
        system.delete(goal, True)
        if len(files) == 1:
            system.rename(files[0], goal)
        else:
            system.rename(to(f"{draft}/part={r.part}"), goal)
        written.append(r.name)
    system.delete(to(draft), True)
    beside = {}
    if b.profile.report:
        beside["report.md"] = report(b)
    if b.profile.instructions:
        beside["instructions.md"] = instructions(b)
    if index := part_index(b) if b.profile.contents else "":
        beside["index.md"] = index
    if b.profile.manifest:
        manifest(b).write.mode("overwrite").json(f"{folder.rstrip('/')}/manifest")
        beside["manifest.json"] = json.dumps({"version": 1, "profile": b.profile.id, "stats": b.stats, "warnings": b.warnings, "hashes": "manifest/"}, indent=1)
    for name, text in beside.items():
        out = system.create(to(name), True)
        out.write(bytearray(text.encode()))
        out.close()
        written.append(name)
    return written


def status(current: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row: added, changed, removed, unchanged, and a text. current and recorded: path, hash."""
    both = need(current, "path", "hash").select("path", F.col("hash").alias("new"), F.lit(None).cast("string").alias("old")).unionByName(need(recorded, "path", "hash").select("path", F.lit(None).cast("string").alias("new"), F.col("hash").alias("old")))
    g = both.groupBy("path").agg(F.max("new").alias("new"), F.max("old").alias("old"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") != F.col("old"), "changed").otherwise("unchanged")
    s = g.select(state.alias("s")).agg(*(F.count_if(F.col("s") == x).alias(x) for x in ("added", "changed", "removed", "unchanged")))
    say = lambda c, word: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {word}")))
    text = F.array_join(F.array_compact(F.array(say("added", "new"), say("changed", "changed"), say("removed", "gone"))), ", ")
    return s.withColumn("text", F.coalesce(F.nullif(text, F.lit("")), F.lit("up to date")))
