"""Lines that many documents of one source share, found by content-defined chunks.

The text is normalised line by line to its form (lower case, marks out, digit runs to 0, white space to one space) and hashed with a
rolling polynomial hash over windows of GRAM characters. Cut points are the positions whose window hash is the least of WINDOW
successive ones, so they depend on the text around them only, not on where lines begin; as a least hash is in every stretch of WINDOW
positions, two cut points, and so one whole chunk, lie inside every form of at least GRAM + 2 * WINDOW - 1 = 19 characters. A line
that repeats therefore repeats a chunk.

Chunks are counted in distinct documents per source: all documents' chunks are added into one table of WIDTH counters (pre-aggregated
per task, merged by block), whose counts are never too low. Where the threshold is a share of a source's documents, the table's error
stays in the same proportion to it at any size of input, so its width is fixed. For sources so small that their threshold lies below the
error the table rules out nothing and all their lines are candidates: a candidate costs two hashes and two ids in the shuffle, not its text.

The texts are cut where chunks repeat excessively: a line is a candidate if every chunk in its core reaches the source's threshold.
The core is what lies so far from the line's ends that its cut points don't depend on the lines beside it, so a repeated line always
has the same core. (A line too short to have a chunk in its core is a candidate if any chunk in it reaches the threshold.) Of
candidates alone the whole form is counted exactly (documents per source and 128-bit hash of the form), so text is never shuffled; forms
at or above the threshold are boilerplate.

Defined cases: null sources and null or empty texts have no lines; repeated rows count as documents of their own; the count of a
source's documents is of all its rows, those with null text too; the longest texts are hashed a block of lines at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, lookup, need, small, table

GRAM = 5
WINDOW = 7
WIDTH = 1 << 21
BLOCK = 1 << 15
#: TESTDATA.md: characters of a form, documents, and share of the source's documents.
FORM_CHARS = 20
LEAST_DOCS = 4
LEAST_SHARE = 0.05
#: Characters hashed at once.
PIECE = 1 << 20
#: Sources whose thresholds are sent to the tasks as a dictionary; with more of them they are joined to the rows.
SOURCES_SENT = 200_000

_MARKS = np.array([ord(c) for c in "*_~>#`"], dtype=np.uint32)
_SPACE = np.array(sorted({c for c in range(0x3001) if chr(c).isspace()}), dtype=np.uint32)
_MULT = 0x9E3779B97F4A7C15


def _table(values: np.ndarray) -> np.ndarray:
    out = np.zeros(0x3100, dtype=bool)
    out[values] = True
    return out


_IS_MARK, _IS_SPACE = _table(_MARKS), _table(_SPACE)


def forms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The normalised code points of lower-cased text whose lines end at "\\n", and the number of the line that each is in.

    Each line's form starts with one "\\n" in the output, which parts it from the one before.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    line = np.cumsum(c == 10, dtype=np.int32)
    low = np.where(c < 0x3100, c, 0)
    keep = ~_IS_MARK[low]
    c, line, low = c[keep], line[keep], low[keep]
    digit = (c >= 48) & (c <= 57)
    space = _IS_SPACE[low] & (c != 10)
    c = np.where(digit, np.uint32(48), np.where(space, np.uint32(32), c))
    if len(c):
        before = np.empty_like(c)
        before[0], before[1:] = 10, c[:-1]
        after = np.empty_like(c)
        after[-1], after[:-1] = 10, c[1:]
        # a digit after a digit and a space after a space or at a line's start go; a space before a line's end too
        keep = ~((c == 48) & (before == 48) | (c == 32) & ((before == 32) | (before == 10)))
        c, line = c[keep], line[keep]
        after = np.empty_like(c)
        after[-1:], after[:-1] = 10, c[1:]
        keep = ~((c == 32) & (after == 10))
        c, line = c[keep], line[keep]
    return c, line


def _grams(c: np.ndarray) -> np.ndarray:
    """Hashes of all windows of GRAM characters."""
    with np.errstate(over="ignore"):
        x = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULT)
        x ^= x >> np.uint64(29)
        n = len(c) - GRAM + 1
        g = np.zeros(n, dtype=np.uint64)
        for i in range(GRAM):
            g = g * np.uint64(0xBF58476D1CE4E5B9) + x[i : i + n]
        g ^= g >> np.uint64(31)
        g *= np.uint64(0x94D049BB133111EB)
        g ^= g >> np.uint64(32)
    return g


def _cuts(g: np.ndarray) -> np.ndarray:
    """Positions that are the (leftmost) least of some WINDOW successive hashes."""
    if len(g) <= WINDOW:
        return np.array([int(np.argmin(g))]) if len(g) else np.zeros(0, dtype=np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, WINDOW)
    at = np.argmin(view, axis=1) + np.arange(len(view))
    return at[np.concatenate(([True], at[1:] != at[:-1]))]


def chunks(c: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the chunks between successive cut points, each with the gram at its end, the lines they lie in, and whether in the core.

    Chunks that reach over a line's end are left out: they are of no use to tell a line, and what is before them in another document differs.
    """
    if len(c) < GRAM + 1:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=bool)
    g = _grams(c)
    at = _cuts(g)
    a, b = at[:-1], at[1:]
    whole = line[a] == line[np.minimum(b + GRAM - 1, len(line) - 1)]
    # a line's first character is the "\n" before it: a chunk from there is of the line too, but would differ at a text's start
    whole &= c[a] != 10
    a, b = a[whole], b[whole]
    with np.errstate(over="ignore"):
        # between two cut points there are at most WINDOW positions: the two grams and the distance say which characters there are
        mid = g[(a + b) // 2]
        h = (g[a] * np.uint64(3) + g[b]) * np.uint64(_MULT) + mid * np.uint64(5) + (b - a).astype(np.uint64)
        h ^= h >> np.uint64(30)
    edge = np.flatnonzero(c == 10)
    start = np.concatenate(([0], edge + 1))[np.searchsorted(edge, a)]
    end = np.concatenate((edge, [len(c)]))[np.searchsorted(edge, a)]
    core = (a - start >= WINDOW - 1) & (b + GRAM + WINDOW - 1 <= end)
    return h, line[a], core


def _pieces(texts: list, docs: list[int]):
    """Blocks of whole lines of about PIECE characters: (text, document index by line, line number by line)."""
    part, of, no, size = [], [], [], 0
    for d, t in zip(docs, texts):
        if not t:
            continue
        lines = t.lower().split("\n") if "\n" in t else [t.lower()]
        if size and size + len(t) > PIECE:
            yield "\n".join(part), np.array(of), np.array(no)
            part, of, no, size = [], [], [], 0
        for i in range(0, len(lines), 1 << 16):
            some = lines[i : i + (1 << 16)]
            part += some
            of += [d] * len(some)
            no += range(i + 1, i + 1 + len(some))
            size += sum(map(len, some))
            if size > PIECE:
                yield "\n".join(part), np.array(of), np.array(no)
                part, of, no, size = [], [], [], 0
    if part:
        yield "\n".join(part), np.array(of), np.array(no)


def _batch(batch: pa.RecordBatch):
    """Of each block: the sources by document; of each chunk the hash, document, line in the block, and if it is in the core; the block, and its lines' documents and numbers."""
    sources, texts = batch.column("source").to_pylist(), batch.column("text").to_pylist()
    for text, of, no in _pieces(texts, range(len(texts))):
        c, line = forms(text)
        h, at, core = chunks(c, line)
        if len(h):
            yield sources, h, of[at], at, core, text, of, no


def _by_source(sources: list, doc: np.ndarray) -> np.ndarray:
    """A salt of the source for each chunk."""
    salt = np.array([crc32((s or "").encode("utf-8", "surrogatepass")) + 1 for s in sources], dtype=np.uint64)
    return salt[doc]


def _mixed(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ salt) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(33))


def _count(batches):
    counts = np.zeros(WIDTH, dtype=np.int32)
    for batch in batches:
        for sources, h, doc, *_ in _batch(batch):
            key = _mixed(h, _by_source(sources, doc))
            slot = (key & np.uint64(WIDTH - 1)).astype(np.int64)
            # a document counts once for a slot: of its chunks the distinct (document, slot)
            both = np.unique(doc.astype(np.int64) * WIDTH + slot)
            counts += np.bincount(both % WIDTH, minlength=WIDTH).astype(np.int32)
    for i in range(0, WIDTH, BLOCK):
        block = counts[i : i + BLOCK]
        if block.any():
            most = block.max()
            kind = np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int32
            yield pa.RecordBatch.from_pydict({"block": pa.array([i // BLOCK], pa.int32()), "width": pa.array([np.dtype(kind).itemsize], pa.int32()), "counts": pa.array([block.astype(kind).tobytes()], pa.binary())})


_KINDS = {1: np.uint8, 2: np.uint16, 4: np.int32}


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BLOCK, dtype=np.int64)
    for b in batches:
        for width, data in zip(b.column("width").to_pylist(), b.column("counts").to_pylist()):
            total += np.frombuffer(data, dtype=_KINDS[width])
    merged = np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([4], pa.int32()), pa.array([merged], pa.binary())], names=["block", "width", "counts"])


class RepeatedLines:
    """lines: (doc_id, line_no, source, form, docs) of all lines that repeat excessively. id_ need not be unique."""

    def __init__(self, df: DataFrame, id_: str, text: str, source: str, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, form_chars: int = FORM_CHARS):
        if form_chars < GRAM + 2 * WINDOW - 1:
            raise ValueError(f"forms under {GRAM + 2 * WINDOW - 1} characters may hold no whole chunk")
        spark = df.sparkSession
        rows = need(df, id_, text, source).select(F.col(id_).alias("id"), F.col(text).alias("text"), F.col(source).alias("source")).where(F.col("source").isNotNull())
        per_source = rows.groupBy("source").agg(F.greatest(F.lit(least_docs), F.ceil(F.count("*") * F.lit(least_share) - 1e-9)).cast("long").alias("least"))
        full = rows.where(F.length("text") > 0)
        schema = "block int, width int, counts binary"
        per_task = full.select("source", "text").mapInArrow(_count, schema).withColumn("some", F.expr("spark_partition_id() div 128"))
        merged = per_task.groupBy("block", "some").applyInArrow(_merge, schema).groupBy("block").applyInArrow(_merge, schema)
        blocks = merged.select("block", "counts").collect()
        counts = np.zeros(WIDTH, dtype=np.int32)  # WIDTH counters whatever the input
        for r in blocks:
            counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], dtype=np.int32)
        sent = spark.sparkContext.broadcast(counts)
        known = small(per_source, SOURCES_SENT)
        least = {r["source"]: r["least"] for r in known} if known is not None else None
        if least is None:
            full = full.join(per_source, "source")

        def survivors(batches):
            """The lines all of whose core's chunks may repeat, with their forms."""
            table_ = sent.value
            for batch in batches:
                ids = batch.column("id").to_pylist()
                of_source = batch.column("source").to_pylist()
                needed = np.array([least[s] for s in of_source] if least is not None else batch.column("least").to_pylist(), dtype=np.int64)
                for sources, h, doc, at, core, block, of, no in _batch(batch):
                    key = _mixed(h, _by_source(sources, doc))
                    hot = table_[(key & np.uint64(WIDTH - 1)).astype(np.int64)] >= needed[doc]
                    any_hot, cold = np.zeros(len(of), dtype=bool), np.zeros(len(of), dtype=bool)
                    any_hot[at[hot]] = True
                    cold[at[core & ~hot]] = True
                    lines = block.split("\n")
                    chosen = [(i, f) for i in np.flatnonzero(any_hot & ~cold) if len(f := form_of(lines[i])) >= form_chars]
                    where = [i for i, _ in chosen]
                    docs = of[where].tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[d] for d in docs], batch.schema.field("id").type), pa.array(no[where], pa.int64()), pa.array([of_source[d] for d in docs], pa.string()), pa.array([f for _, f in chosen], pa.string())],
                        names=["id", "line_no", "source", "form"],
                    )

        kind = dict(rows.dtypes)["id"]
        lines = cut(full.mapInArrow(survivors, f"id {kind}, line_no long, source string, form string"), "lines")
        thresholds = F.broadcast(spark.createDataFrame(list(least.items()), "source string, least long")) if least else per_source
        # ids of one source and form in two steps, each partially aggregated: a form of a third of all rows is no hot task
        hashed = lines.withColumns({"h1": F.xxhash64("form"), "h2": F.xxhash64(F.lit(1), "form")})
        once = hashed.select("source", "h1", "h2", "id").distinct()
        many = once.groupBy("source", "h1", "h2").agg(F.count("*").alias("docs")).join(thresholds, "source").where("docs >= least").select("source", "h1", "h2", "docs")
        self.lines = hashed.join(lookup(cut(many, "forms")), ["source", "h1", "h2"]).select("id", "line_no", "source", "form", "docs")
        self.forms = self.lines.groupBy("source", "form").agg(F.max("docs").alias("docs"))


def form_of(line: str) -> str:
    c, _ = forms(line.lower())
    return "".join(map(chr, c))


def strip_lines(df: DataFrame, found: DataFrame, id_: str, text: str) -> DataFrame:
    """df's (id, text, removed): texts without the found lines (id, line_no). Rows with nothing found stay as they are."""
    numbers = found.groupBy("id").agg(F.collect_set("line_no").alias("_drop"))
    rows = need(df, id_, text).select(F.col(id_).alias("id"), F.col(text).alias("text")).join(numbers, "id", "left")
    lines = F.split("text", "\n", -1)
    kept = F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), (i + 1).cast("long").alias("i"))), lambda s: ~F.array_contains("_drop", s["i"])), lambda s: s["x"])
    return rows.select("id", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("_drop"), F.lit(0)).alias("removed"))


def _p6(spark: SparkSession, sf_dir: str) -> RepeatedLines:
    return RepeatedLines(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p6(spark, sf_dir).lines.select(F.col("id").alias("doc_id"), "line_no").distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, form, docs of every repeated line, as report_boilerplate has them."""
    return _p6(spark, sf_dir).forms


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without the repeated lines, removed."""
    found = cut(p6_found(spark, sf_dir).withColumnRenamed("doc_id", "id"), "found")
    return strip_lines(table(spark, sf_dir, "documents"), found, "doc_id", "text").withColumnRenamed("id", "doc_id")


def p6_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, line_no of the repeated lines of rendered_notes.body within a vault."""
    notes = need(table(spark, sf_dir, "rendered_notes"), "note_id", "vault", "body").dropDuplicates(["note_id"])
    return RepeatedLines(notes, "note_id", "body", "vault").lines.select(F.col("id").alias("note_id"), "line_no").distinct()


QUERIES = {"p6_found": p6_found, "p6_report": p6_report, "p6_clean": p6_clean, "p6_notes": p6_notes}

_FORMS = r"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents WHERE source IS NOT NULL AND text IS NOT NULL),
l AS (SELECT doc_id, source, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM d),
f AS (SELECT doc_id, source, line_no, trim(regexp_replace(regexp_replace(regexp_replace(lower(line), '[*_~>#`]', '', 'g'), '[0-9]+', '0', 'g'), '[\s\x{00a0}\x{2007}\x{202f}\x{2003}\x{2009}\x{3000}]+', ' ', 'g')) AS form FROM l),
n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
c AS (SELECT f.source, form, count(DISTINCT doc_id) AS docs FROM f WHERE length(form) >= 20 GROUP BY 1, 2),
h AS (SELECT c.source, c.form, c.docs FROM c JOIN n ON n.source = c.source WHERE docs >= 4 AND docs >= 0.05 * n.n)
"""
SQL = {
    "p6_found": _FORMS + "SELECT DISTINCT doc_id, line_no FROM f JOIN h ON f.source = h.source AND f.form = h.form",
    "p6_report": _FORMS + "SELECT source, form, docs FROM h",
}
