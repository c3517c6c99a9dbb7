"""Markup to clean text, without the templates of a site.

Every text is parsed once into a tree of elements, which is written with the hashes of its subtrees. Subtrees with enough text are
counted per host in distinct pages (partially aggregated by host and hash, so a host with a third of all pages is spread over all
tasks). Pages whose trees are equal are one page: a note that a small host has five times is no template of it. A subtree found on at
least LEAST_PAGES pages and LEAST_SHARE of a host's pages is a template of that host: it is deleted from every page of it, and the rest
of the tree is written as clean text that keeps headings, lists, code and formulas. ``kinds`` are the kinds of markup that a field held,
in what is kept and in what is deleted.

Defined cases: null texts stay null and have no kinds; empty ones stay empty; a null host is no host, so nothing recurs there; rows
re-delivered under one id are one page; texts, and constructs in them, of any length are parsed whole.
"""

from __future__ import annotations

import marshal
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, lookup, need, small, table
from .markup import hashes, packed, parse, pruned, render, unpacked

LEAST_PAGES = 4
LEAST_SHARE = 0.05
#: Subtrees with less text are parts of the language, not of a template.
LEAST_CHARS = 20
#: Templates sent to the tasks as a set; with more of them each page gets its own by a join.
TEMPLATES_SENT = 500_000


def _long(h: bytes) -> int:
    return int.from_bytes(h, "little", signed=True)


def _parse(meta: str):
    """Of each text the kinds of markup, the packed tree, the hashes of its large enough subtrees and a hash of the whole."""

    def run(batches):
        for b in batches:
            kinds, trees, found, page = [], [], [], []
            for t, f in zip(b.column("text").to_pylist(), b.column("field").to_pylist()):
                if t is None:
                    for column in (kinds, trees, found, page):
                        column.append(None)
                    continue
                met: set[str] = set()
                nodes = parse(t, met, f != meta)
                all_ = hashes(nodes)
                kinds.append(sorted(met))
                trees.append(marshal.dumps(packed(nodes)))
                found.append(sorted({_long(h) for h, n in all_ if n >= LEAST_CHARS}))
                page.append(_long(blake2b(b"".join(h for h, _ in all_), digest_size=8).digest()))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("host"), b.column("field"), pa.array(kinds, pa.list_(pa.string())), pa.array(trees, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(page, pa.int64())],
                names=["id", "host", "field", "kinds", "tree", "hashes", "page"],
            )

    return run


def _clean(sent: dict[str, set[int]] | None):
    def run(batches):
        for b in batches:
            texts, gone = [], []
            own = b.column("drop").to_pylist() if sent is None else None
            for i, (tree, h) in enumerate(zip(b.column("tree").to_pylist(), b.column("host").to_pylist())):
                if tree is None:
                    texts.append(None)
                    gone.append(0)
                    continue
                nodes = unpacked(marshal.loads(tree))
                drop = sent.get(h, ()) if sent is not None else set(own[i] or ())
                at: set[int] = set()
                if drop:
                    at = {k for k, (x, n) in enumerate(hashes(nodes)) if n >= LEAST_CHARS and _long(x) in drop}
                    nodes = pruned(nodes, at) if at else nodes
                texts.append(render(nodes))
                gone.append(len(at))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "host", "field", "kinds")), pa.array(texts, pa.string()), pa.array(gone, pa.int32())], names=["id", "host", "field", "kinds", "text", "removed"])

    return run


class CleanMarkup:
    """rows: id, host, field, kinds (of markup), text (clean), removed (template subtrees). templates: host, hash, pages."""

    def __init__(self, df: DataFrame, id_: str, host: str, texts: list[str], meta: str = "", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE):
        """texts: the columns with markup; meta: the one of them that holds metadata, in which lines mean nothing."""
        rows = need(df, id_, host, *texts).select(F.col(id_).alias("id"), F.col(host).alias("host"), *(F.col(t).alias(f"_t{i}") for i, t in enumerate(texts)))
        each = rows.select("id", "host", F.explode(F.array(*(F.struct(F.lit(t).alias("field"), F.col(f"_t{i}").alias("text")) for i, t in enumerate(texts)))).alias("x")).select("id", "host", "x.field", "x.text")
        kind = dict(rows.dtypes)["id"]
        schema = f"id {kind}, host string, field string, kinds array<string>, "
        # the parsed pages are read twice below, so they are written once
        pages = cut(each.mapInArrow(_parse(meta), schema + "tree binary, hashes array<long>, page long"), "pages")
        # a page is what a field says: equal trees are one page, whatever their ids
        known = pages.where(F.col("host").isNotNull() & (F.size("hashes") > 0)).select("host", "page", "hashes")
        size = pages.where(F.col("host").isNotNull()).select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("n"))
        least = size.select("host", F.greatest(F.lit(least_pages), F.ceil(F.col("n") * F.lit(least_share) - 1e-9)).cast("long").alias("least"))
        single = known.select("host", "page", F.explode("hashes").alias("hash"))
        counted = single.distinct().groupBy("host", "hash").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
        self.templates = cut(counted.join(lookup(least), "host").where("pages >= least").select("host", "hash", "pages"), "templates")
        few = small(self.templates.select("host", "hash"), TEMPLATES_SENT)
        if few is not None:
            sent: dict[str, set[int]] = {}
            for r in few:
                sent.setdefault(r["host"], set()).add(r["hash"])
            self.rows = pages.select("id", "host", "field", "kinds", "tree").mapInArrow(_clean(sent), schema + "text string, removed int")
        else:
            drop = single.join(self.templates, ["host", "hash"]).groupBy("host", "page").agg(F.collect_set("hash").alias("drop"))  # a page has few
            self.rows = pages.join(drop, ["host", "page"], "left").select("id", "host", "field", "kinds", "tree", "drop").mapInArrow(_clean(None), schema + "text string, removed int")


def _outputs(rows: DataFrame) -> DataFrame:
    return CleanMarkup(rows, "output_id", "vault", ["text", "frontmatter_raw"], "frontmatter_raw").rows


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-delivered rows have the same kinds, so they are made distinct when they are narrow."""
    return _outputs(table(spark, sf_dir, "transform_outputs")).select(F.col("id").alias("output_id"), "field", F.explode("kinds").alias("kind")).distinct()


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """output_id, field, text, removed: each field once."""
    once = need(table(spark, sf_dir, "transform_outputs"), "output_id", "vault", "text", "frontmatter_raw").dropDuplicates(["output_id"])
    return _outputs(once).select(F.col("id").alias("output_id"), "field", "text", "removed")


def p3_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, text, removed of rendered_notes.body."""
    once = need(table(spark, sf_dir, "rendered_notes"), "note_id", "vault", "body").dropDuplicates(["note_id"])
    return CleanMarkup(once, "note_id", "vault", ["body"]).rows.select(F.col("id").alias("note_id"), "text", "removed")


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean, "p3_notes": p3_notes}
SQL: dict[str, str] = {}
