"""Splitting oversized texts at natural boundaries by lexical cohesion.

The words of a text (by their first six letters, so that forms of a word are one term) are hashed into term vectors of pseudo-sentences of PSEUDO words; at each gap between them the vectors of the
BLOCK pseudo-sentences before and after are compared (cosine). A gap's depth is how far its similarity lies below the peaks on both
sides: a deep valley is where the topic changes. A piece may be up to the limit long. Within its size window (from LEAST_FILL of the limit to the limit) the
cut is the deepest valley among the strongest kind of natural boundary there is: headings and paragraphs, else lines, else sentences;
only if the whole window up to the piece's start has none of these, words; else characters, never before a combining mark.

The next piece starts ``overlap`` characters before the cut, so two successive pieces share exactly that (less only if the first is
shorter). Without the overlaps the pieces are the text, character for character.

Characters are Unicode code points. Defined cases: null or empty texts and those within the limit are one piece; a null or non-positive
limit means no limit; a null or negative overlap is none, and one over half the limit counts as half; fences of code are no boundary
but between their lines.
"""

from __future__ import annotations

import re
import unicodedata
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import lookup, need, table

PSEUDO = 20
BLOCK = 6
DIMS = 256
LEAST_FILL = 0.5
HEADING, PARAGRAPH, LINE, SENTENCE, WORD = 5, 4, 3, 2, 1
NAMES = {HEADING: "heading", PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", WORD: "word", 0: "character", 6: "end"}

_LINE = re.compile(r"[^\n]*\n|[^\n]+$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEAD = re.compile(r" {0,3}#{1,6}\s|={2,6}[^=\n]+={2,6}\s*$|\\(?:sub)*section\*?\{|<h[1-6]\b", re.I)
_SENT = re.compile(r"[.!?…。！？]+[\"'»”’)\]]*[ \t ]+")
_STOP = frozenset("about after again also been before being could does dans down each even from have here into just less like made many mehr more most much must only other over same should some such than that the their them then there these they this those through under until very want well were what when where which while whose will with would your aber auch dass der die das dem den eine einen einer ein ist nicht oder sich und wird avec cette dans elle est les mais nous par pas pour que qui sont sur une vous".split())
_bins: dict[str, int] = {}


def _bin(word: str) -> int:
    b = _bins.get(word)
    if b is None:
        core = word.strip(".,;:!?…\"'()[]{}*_~>#`=-|<»«”“’")
        b = -1 if len(core) < 3 or core in _STOP or not core[0].isalpha() else crc32(core[:6].encode("utf-8", "surrogatepass")) % DIMS
        if len(_bins) < 1_000_000:
            _bins[word] = b
    return b


def natural_boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a piece may end, ascending, and the kind of each."""
    at, kind, pos, fence, blank = [], [], 0, "", False
    for m in _LINE.finditer(text):
        line, pos = m.group(), m.start()
        f = _FENCE.match(line)
        if pos:
            if fence:
                at.append(pos)
                kind.append(SENTENCE)
            elif line.strip():
                at.append(pos)
                kind.append(HEADING if _HEAD.match(line) else PARAGRAPH if blank else LINE)
        if fence:
            if f and f.group(1).startswith(fence) and not line[f.end() :].strip():
                fence = ""
        else:
            if f:
                fence = f.group(1)
            elif len(line) > 40:
                for s in _SENT.finditer(line):
                    if s.end() < len(line):
                        at.append(pos + s.end())
                        kind.append(SENTENCE)
        blank = not line.strip()
    return np.array(at, dtype=np.int64), np.array(kind, dtype=np.int8)


def depths(text: str, at: np.ndarray) -> np.ndarray:
    """The depth of the valley at each position."""
    words = text.lower().split()
    n = -(-len(words) // PSEUDO)
    if n < 3 or not len(at):
        return np.zeros(len(at))
    bins = np.fromiter(map(_bin, words), dtype=np.int64, count=len(words))
    gaps = np.empty(n - 1)
    row = np.arange(len(words)) // PSEUDO
    for lo in range(0, n - 1, 4096):  # rows at a time: memory stays bounded for the longest texts
        first, last = max(0, lo - BLOCK + 1), min(n, lo + 4096 + BLOCK)
        some = (row >= first) & (row < last) & (bins >= 0)
        counts = np.bincount((row[some] - first) * DIMS + bins[some], minlength=(last - first) * DIMS).reshape(-1, DIMS).astype(np.float32)
        sums = np.concatenate((np.zeros((1, DIMS), dtype=np.float32), np.cumsum(counts, axis=0)))
        g = np.arange(lo, min(lo + 4096, n - 1)) + 1 - first
        left = sums[g] - sums[np.maximum(g - BLOCK, 0)]
        right = sums[np.minimum(g + BLOCK, len(sums) - 1)] - sums[g]
        norm = np.sqrt((left**2).sum(1) * (right**2).sum(1))
        gaps[lo : lo + len(g)] = (left * right).sum(1) / np.maximum(norm, 1e-6)
    depth = _climb(gaps) + _climb(gaps[::-1])[::-1]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = _SPACES[np.where(codes < len(_SPACES), codes, 0)]
    starts = ~space & np.concatenate(([True], space[:-1]))
    ordinal = np.cumsum(starts)  # words begun up to each character
    gap = np.rint(ordinal[np.maximum(at - 1, 0)] / PSEUDO).astype(np.int64) - 1
    return depth[np.clip(gap, 0, n - 2)]


_SPACES = np.array([chr(c).isspace() for c in range(0x3001)])


def _climb(s: np.ndarray) -> np.ndarray:
    """How far the similarity rises from each gap to the next peak before it."""
    peak = np.empty(len(s))
    top = s[0]
    for i, x in enumerate(s.tolist()):
        top = max(top, x) if i and x <= s[i - 1] else x
        peak[i] = top
    return peak - s


def pieces(text: str, limit: int | None, overlap: int | None) -> list[tuple[int, int, str]]:
    """(start, end, kind of the boundary at its end) of each piece."""
    n = len(text)
    if not limit or limit < 1 or n <= limit:
        return [(0, n, "end")]
    overlap = min(max(overlap or 0, 0), limit // 2)
    at, kind = natural_boundaries(text)
    depth = depths(text, at)
    strong = depth + np.where(kind == HEADING, 0.3, 0.0)
    out, start, cut = [], 0, 0
    while n - start > limit:
        hi = start + limit
        end, name = 0, 0
        for lo in (start + int(limit * LEAST_FILL), cut):
            lo = max(lo, cut)
            i, j = np.searchsorted(at, [lo, hi], side="right")
            if i < j:
                k = kind[i:j]
                level = PARAGRAPH if (k >= PARAGRAPH).any() else int(k.max())
                w = np.flatnonzero(k >= level)
                best = i + w[len(w) - 1 - int(np.argmax(strong[i:j][w][::-1]))]
                end, name = int(at[best]), int(kind[best])
                break
        else:
            space = next((p for p in range(hi, max(cut, start + limit // 2), -1) if text[p - 1].isspace()), 0)
            if space:
                end, name = space, WORD
            else:
                end = hi
                while end > cut + 1 and end > hi - 32 and unicodedata.combining(text[end]):
                    end -= 1
        out.append((start, end, NAMES[name]))
        cut, start = end, max(end - overlap, 0)
    out.append((start, n, "end"))
    return out


def _split(with_text: bool):
    def run(batches):
        for b in batches:
            rows = [[], [], [], [], [], []]
            texts = []
            for i, (text, limit, overlap) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "limit", "overlap")))):
                cuts = pieces(text or "", limit, overlap)
                for k, (s, e, name) in enumerate(cuts):
                    for column, v in zip(rows, (i, k + 1, len(cuts), s, e, name)):
                        column.append(v)
                    if with_text:
                        texts.append(text[s:e] if text is not None else None)
            ids = b.column("id").take(pa.array(rows[0], pa.int64()))
            columns = [ids, pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.int64()), pa.array(rows[4], pa.int64()), pa.array(rows[5], pa.string())]
            columns.insert(3, b.column("limit").take(pa.array(rows[0], pa.int64())))
            names = ["id", "piece", "pieces", "limit", "start", "end", "boundary"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def split_oversized(df: DataFrame, id_: str, text: str, limit: str, overlap: str, with_text: bool = True) -> DataFrame:
    """id, piece (from 1), pieces, limit, start, end (code points), boundary and, if asked for, text of every row's pieces.

    One narrow map over the rows, so no shuffle; texts within the limit pass as one piece.
    """
    rows = need(df, id_, text, limit, overlap).select(F.col(id_).alias("id"), F.col(text).alias("text"), F.col(limit).cast("long").alias("limit"), F.col(overlap).cast("long").alias("overlap"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_split(with_text), f"id {kind}, piece int, pieces int, limit long, start long, end long, boundary string" + ", text string" * with_text)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splittable units over their destination's limit; the length is compared before Python sees a row."""
    limits = need(table(spark, sf_dir, "bundle_limits"), "destination", "part_limit_chars", "overlap_chars").where(F.col("part_limit_chars").isNotNull()).groupBy("destination").agg(F.min("part_limit_chars").alias("limit"), F.max("overlap_chars").alias("overlap"))
    units = need(table(spark, sf_dir, "pack_units"), "unit_id", "destination", "content", "splittable").where(F.col("splittable"))
    return units.join(lookup(limits), "destination").where(F.length("content") > F.col("limit")).select("unit_id", "content", "limit", "overlap")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that come out in several pieces, each within its limit. Re-delivered rows give the same pieces, so only narrow rows are made distinct."""
    spans = split_oversized(_units(spark, sf_dir), "unit_id", "content", "limit", "overlap", with_text=False)
    held = F.assert_true(F.col("end") - F.col("start") <= F.col("limit"), "a piece is over its limit").isNull()
    return spans.where((F.col("pieces") > 1) & held).select(F.col("id").alias("unit_id")).distinct()


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(_units(spark, sf_dir).dropDuplicates(["unit_id"]), "unit_id", "content", "limit", "overlap").withColumnRenamed("id", "unit_id")


#: Notes have no destination: they are cut for this one.
NOTES_FOR = "rag-records"


def p1_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the long bodies that are not numbered yet."""
    limits = need(table(spark, sf_dir, "bundle_limits"), "destination", "part_limit_chars", "overlap_chars").where(F.col("destination") == NOTES_FOR).agg(F.min("part_limit_chars").alias("limit"), F.max("overlap_chars").alias("overlap"))
    notes = need(table(spark, sf_dir, "rendered_notes"), "note_id", "body", "chunk_index", "chunk_total").where(F.col("chunk_index").isNull() | F.col("chunk_total").isNull())
    long = notes.crossJoin(F.broadcast(limits)).where(F.length("body") > F.col("limit")).dropDuplicates(["note_id"])  # the limits are one row
    return split_oversized(long, "note_id", "body", "limit", "overlap").withColumnRenamed("id", "note_id")


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_notes": p1_notes}
SQL = {
    "p1_found": "SELECT DISTINCT unit_id FROM pack_units u JOIN bundle_limits b ON u.destination = b.destination WHERE splittable AND part_limit_chars IS NOT NULL AND length(content) > part_limit_chars"
}
