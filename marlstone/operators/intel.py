"""Corpus intelligence: duplicates, repeated lines, drift of metrics, credentials, neighbours, session windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import cut
from . import notes as N
from .components import components
from .notes import lines, lines_like, outside_fences


def exact_duplicates(notes: DataFrame) -> DataFrame:
    """hash, representative (most words, then path), copies: groups of notes with one content."""
    rows = notes.select(F.md5("text").alias("hash"), "path", T.count_words(F.col("text")).alias("words"))
    best = F.min(F.struct((-F.col("words")).alias("w"), "path"))
    return rows.groupBy("hash").agg(best["path"].alias("representative"), F.count("*").alias("copies")).where("copies > 1")


def line_frequency(notes: DataFrame, least_docs: int = 3, least_chars: int = 10, exact: bool = False) -> DataFrame:
    """template (or the exact line), docs: distinct notes per line with digits aside, of lines that are long enough. Counted in two partially aggregated steps.

    The form is made once a line: behind a generator, a filter on it isn't pushed down to be computed again.
    """
    form = T.normalize_exact(F.col("line")) if exact else T.normalize_template(F.col("line"))
    t = lines(notes, "doc_id").where(F.length("line") >= least_chars).select("doc_id", F.explode_outer(F.array(form)).alias("template"))
    once = t.where(F.length("template").between(least_chars, 300)).distinct()
    return once.groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs)


def similar_pairs(notes: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """a < b, similarity of notes whose distinct k-word shingles overlap by Jaccard >= threshold; copies of one text are one (the least id).

    Prefix filter: with shingles in order of rarity, only the first n - ceil(t n) + 1 of a note can decide, so frequent shingles are never
    joined. No cap on lists or pairs.
    """
    t = F.col("text")
    rep = notes.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    # words are hashed once; no filter on what is computed here, as it would be pushed down with the whole expression
    w = F.transform(F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}]+)")), lambda x: F.xxhash64(x))
    words = notes.join(rep.select("doc_id"), "doc_id", "left_semi").select("doc_id", w.alias("w"))
    # shifted lists side by side: inside a lambda over positions the list of words would be made anew for each of them
    side = F.arrays_zip(*(F.slice("w", j + 1, F.greatest(F.size("w") - j, F.lit(0))).alias(f"w{j}") for j in range(k)))
    runs = F.array_distinct(F.transform(F.filter(side, lambda r: r[f"w{k - 1}"].isNotNull()), lambda r: F.xxhash64(*[r[f"w{j}"] for j in range(k)])))
    post = words.select("doc_id", runs.alias("s")).select("doc_id", F.size("s").alias("n"), F.explode_outer("s").alias("e")).where("e IS NOT NULL")
    df = post.groupBy("e").agg(F.count("*").alias("df")).where("df > 1")
    # read four times below, so written once
    shared = cut(post.join(df, "e").groupBy("doc_id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("s")), "shared")
    head = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int") + 1 - (F.col("n") - F.size("s"))
    lead = shared.where(head > 0).select("doc_id", "n", F.explode(F.slice("s", F.lit(1), head)).alias("x")).select("doc_id", "n", "x.e")
    x, y = lead.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "e"), lead.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "e")
    met = x.join(y, "e").where((F.col("a") < F.col("b")) & (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)).select("a", "b", "na", "nb").distinct()
    sets = shared.select("doc_id", F.transform("s", lambda v: v["e"]).alias("s"))
    both = met.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")
    i = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (i / (F.col("na") + F.col("nb") - i)).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)


def similar_groups(notes: DataFrame, threshold: float = 0.8, k: int = 5) -> DataFrame:
    """doc_id, component (least doc_id of the group), representative (least doc_id of its text), links: every note that has a copy or a similar note.

    links counts the other notes that a note is linked with: its copies, and all copies of the texts similar to its own.
    """
    texts = cut(notes.select("doc_id", F.md5("text").alias("h")), "texts")
    classes = texts.groupBy("h").agg(F.min("doc_id").alias("representative"), F.count("*").alias("copies"))
    pairs = cut(similar_pairs(notes, threshold, k).select("a", "b"), "pairs")
    sizes = classes.select(F.col("representative").alias("b"), "copies")
    ends = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(sizes, "b").groupBy(F.col("a").alias("representative")).agg(F.sum("copies").alias("near"))
    # a text with copies is a group even if no other is similar to it
    own = classes.where("copies > 1").select(F.col("representative").alias("a"), F.col("representative").alias("b"))
    grouped = components(pairs.union(own)).withColumnRenamed("node", "representative")
    found = grouped.join(classes, "representative").join(ends, "representative", "left")
    links = F.col("copies") - 1 + F.coalesce("near", F.lit(0))
    return texts.join(found.select("h", "component", "representative", links.alias("links")), "h").drop("h")


# Shapes of credentials, in the order in which they are tried.
SECRETS = (
    ("private-key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    ("aws-access-key", r"\b(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}\b"),
    ("github-token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})\b"),
    ("slack-token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b"),
    ("openai-key", r"\bsk-(?:proj-|ant-)?[A-Za-z0-9_-]{20,}\b"),
    ("google-key", r"\bAIza[0-9A-Za-z_-]{35}\b"),
    ("huggingface-token", r"\bhf_[A-Za-z0-9]{30,}\b"),
    ("stripe-key", r"\b(?:sk|rk)_(?:live|test)_[0-9a-zA-Z]{24,}\b"),
    ("npm-token", r"\bnpm_[A-Za-z0-9]{36}\b"),
    ("db-connection", r"(?i)\b(?:postgres(?:ql)?|mongodb(?:\+srv)?|mysql|redis|amqp):\/\/[^:\s/@\"']+:[^@\s/\"']+@[^\s\"'`]+"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    ("named-secret", r"(?i)\b(?:api[_-]?key|apikey|secret[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|client[_-]?secret)\b\s*[:=]\s*[\"'`]?([A-Za-z0-9+/_\-.]{12,})"),
    ("bearer", r"\bBearer\s+([A-Za-z0-9\-._~+/]{24,}=*)"),
)
EMAIL = ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,12}\b")


PEM = r"(?s)-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----.*?-----END (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"
#: As the named secret, but with its name as a group: the name stays.
NAMED = r"(?i)\b((?:api[_-]?key|apikey|secret[_-]?key|access[_-]?token|auth[_-]?token|password|passwd|client[_-]?secret)\b\s*[:=]\s*[\"'`]?)[A-Za-z0-9+/_\-.]{12,}"


def secret_kind(line: Column, pii: bool = False) -> Column:
    kinds = (*SECRETS, EMAIL) if pii else SECRETS
    out = None
    for name, p in kinds:
        test = F.regexp_like(line, F.lit(p))
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.when(F.length(line) <= 4000, out)


def scan_secrets(notes: DataFrame, pii: bool = False) -> DataFrame:
    """doc_id, line_no, kind: the first kind that fits each line."""
    return lines(notes, "doc_id").select("doc_id", "line_no", secret_kind(F.col("line"), pii).alias("kind")).where(F.col("kind").isNotNull())


def redact(text: Column, pii: bool = False) -> Column:
    """Key blocks first, then the kinds in order; a named secret keeps its name."""
    text = F.regexp_replace(text, PEM, "[redacted: private key block]")
    for name, p in (*SECRETS[1:], *([EMAIL] if pii else [])):
        text = F.regexp_replace(text, NAMED, "$1[redacted]") if name == "named-secret" else F.regexp_replace(text, p, f"[redacted: {name}]")
    return text


METRIC = r"([A-Za-z][A-Za-z0-9@_/-]{1,24})\s*(?:=|:|\bis\b|\bat\b)\s*([0-9]+(?:\.[0-9]+)?)"


def metric_claims(notes: DataFrame) -> DataFrame:
    """doc_id, subject, value: the first claim of each subject in a note, in lines outside code of at most 300 characters."""
    at = outside_fences(lines_like(notes, r"(?:=|:|\bis\b|\bat\b)\s*[0-9]", "doc_id")).where(F.length("line") <= 300)
    hit = at.select("doc_id", "line_no", F.posexplode(F.arrays_zip(F.regexp_extract_all("line", F.lit(METRIC), F.lit(1)).alias("s"), F.regexp_extract_all("line", F.lit(METRIC), F.lit(2)).alias("v"))).alias("pos", "m"))
    first = hit.select("doc_id", F.lower("m.s").alias("subject"), "m.v", "line_no", "pos").groupBy("doc_id", "subject").agg(F.min_by("v", F.struct("line_no", "pos")).alias("value"))
    return first


def drift(notes: DataFrame, claims: DataFrame) -> DataFrame:
    """subject, older, newer (paths), old, new: claims of one folder's notes that differ in value.

    Of a subject and folder the claims are put in time order and each is compared with the one before, so no group's pairs are all made.
    """
    c = claims.join(notes.select("doc_id", "path", "folder", "mtime"), "doc_id").where(F.length("folder") > 0)
    w = W.partitionBy("folder", "subject").orderBy(F.col("mtime").asc_nulls_first(), "path")
    c = c.select("subject", F.lag("path").over(w).alias("older"), F.col("path").alias("newer"), F.lag("value").over(w).alias("old"), F.col("value").alias("new"))
    return c.where(F.col("old").isNotNull() & (F.col("old") != F.col("new")))


STATUS = r"\b([A-Za-z][A-Za-z0-9_-]{2,24}(?:\s+[A-Za-z][A-Za-z0-9_-]{2,20})?)\s+is\s+(?:currently\s+|now\s+)?(enabled|disabled|deprecated|active|required|optional|supported|unsupported)\b"
#: Both ends of each scale of states; a note that says one end contradicts a note that says the other.
SCALES = {"enabled": ("enabled", "disabled"), "active": ("active", "deprecated"), "required": ("required", "optional"), "supported": ("supported", "unsupported")}
GENERIC = tuple("step part page line item section chapter figure table note example option phase stage day week month year point rule level type case group number count total index id".split())


def status_claims(notes: DataFrame) -> DataFrame:
    """doc_id, subject, value: the first status claim of each subject (its last two words that say something) in a note, in lines outside code."""
    at = outside_fences(lines_like(notes, r"(?i)\sis\s+(?:currently\s+|now\s+)?(?:enabled|disabled|deprecated|active|required|optional|supported|unsupported)\b", "doc_id")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where(F.length("line") <= 300)
    found = F.arrays_zip(*(F.regexp_extract_all("line", F.lit("(?i)" + STATUS), F.lit(k)).alias(c) for k, c in ((1, "s"), (2, "v"))))
    hit = at.select("doc_id", "line_no", F.posexplode(found).alias("pos", "m"))
    words = F.filter(F.split(F.regexp_replace(F.lower("m.s"), r"[\s*_-]+$", ""), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(*T.STOP))
    hit = hit.withColumn("w", words).withColumn("subject", F.array_join(F.slice("w", F.greatest(F.size("w") - 1, F.lit(1)), 2), " "))
    hit = hit.where((F.length("subject") >= 3) & ~F.col("subject").isin(*GENERIC))
    return hit.groupBy("doc_id", "subject").agg(F.min_by(F.lower("m.v"), F.struct("line_no", "pos")).alias("value"))


def relations(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, relation, key: two notes are related if they have one (relation, key) in common. edges: a, b (paths).

    A folder (not the root), a tag or one of the twelve most frequent terms is a key; a link is one that its two ends have.
    """
    row = lambda df, relation, key: df.select("doc_id", F.lit(relation).alias("relation"), F.col(key).alias("key"))
    link = F.concat(F.least("a", "b"), F.lit("\n"), F.greatest("a", "b")).alias("link")
    ends = edges.select(link, F.explode(F.array("a", "b")).alias("path")).distinct().join(notes.select("doc_id", "path"), "path")
    parts = row(notes.where("folder <> ''"), "folder", "folder"), row(N.tags(notes, "doc_id"), "tag", "tag"), row(N.top_terms(notes, k=12), "term", "term"), row(ends, "link", "link")
    return reduce(DataFrame.unionByName, parts)


def related_drift(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, subject, relation, key, scale, value, first, path, mtime: the notes that say a value, of all subjects on which related notes differ.

    Two rows that agree in kind, subject, relation, key and scale and differ in value are a drift between their two notes, the one with the
    lesser (mtime, path) the older: every differing pair can be read off, and rows grow with claims, not with pairs. ``first`` is the
    value's oldest note. Statuses are compared on their scale only.
    """
    scale = F.create_map(*(F.lit(x) for name, ends in SCALES.items() for end in ends for x in (end, name)))
    claims = metric_claims(notes).select(F.lit("metric-drift").alias("kind"), F.lit("").alias("scale"), "doc_id", "subject", "value")
    claims = claims.unionByName(status_claims(notes).select(F.lit("status-conflict").alias("kind"), scale[F.col("value")].alias("scale"), "doc_id", "subject", "value"))
    # a subject on which all notes agree can't drift: it is left out before claims meet relations
    claims = cut(claims, "claims")
    group = ["kind", "subject", "scale"]
    open_ = claims.groupBy(group).agg(F.min("value").alias("_x"), F.max("value").alias("_y")).where("_x <> _y").select(group)
    said = claims.join(open_, group).join(notes.select("doc_id", "path", "mtime"), "doc_id")
    said = cut(said, "said")
    rows = cut(said.join(relations(notes.join(said.select("doc_id"), "doc_id", "left_semi"), edges), "doc_id"), "related")
    group += ["relation", "key"]
    values = rows.groupBy(*group, "value").agg(F.min(F.struct(F.col("mtime").isNotNull().alias("dated"), "mtime", "path"))["path"].alias("first"))
    differ = rows.groupBy(group).agg(F.min("value").alias("_x"), F.max("value").alias("_y")).where("_x <> _y").select(group)
    return rows.join(differ, group).join(values, [*group, "value"]).select("kind", "subject", "relation", "key", "scale", "value", "first", "path", "mtime")


#: Query vectors that are sent to the tasks at once.
QUERY_BLOCK = 20_000


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """id, neighbour, similarity, rank: the k nearest by cosine of each query among all vectors (exact). Ties by the lesser neighbour.

    Queries are counted and sent in blocks of about QUERY_BLOCK; for each block every task keeps its own k best, and those are merged.
    Null vectors have no neighbours and are none.
    """
    import numpy as np
    import pandas as pd

    spark = vectors.sparkSession
    schema = f"id {dict(queries.dtypes)['id']}, neighbour {dict(vectors.dtypes)['id']}, similarity double"
    queries, vectors = (x.select("id", "v").where(F.col("v").isNotNull()) for x in (queries, vectors))
    blocks = -(-queries.count() // QUERY_BLOCK)

    def block(sent):
        def run(batches):
            ids, unit = sent.value
            for b in batches:
                if b.empty:
                    continue
                x = np.array(b["v"].tolist(), dtype=np.float64)
                near = b["id"].to_numpy()
                s = unit @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).T
                s[ids[:, None] == near[None, :]] = -2
                # the k-th best similarity of each query in this batch: all that reach it are kept, so ties are decided in the end
                least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(ids), -1.5)
                rows, cols = np.nonzero((s >= least[:, None] - 1e-9) & (s > -1.5))
                yield pd.DataFrame({"id": ids[rows], "neighbour": near[cols], "similarity": s[rows, cols]})

        return run

    parts = []
    for i in range(blocks):
        q = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toPandas()
        if q.empty:
            continue
        m = np.array(q["v"].tolist(), dtype=np.float64)
        parts.append(vectors.mapInPandas(block(spark.sparkContext.broadcast((q["id"].to_numpy(), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)))), schema))
    part = reduce(DataFrame.unionByName, parts, spark.createDataFrame([], schema))
    w = W.partitionBy("id").orderBy(F.desc(F.round("similarity", 9)), "neighbour")
    return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """key, start, end, n: runs of events with no pause of the gap (batch or stream)."""
    s = F.session_window(ts, gap)
    return events.groupBy(key, s.alias("s")).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
