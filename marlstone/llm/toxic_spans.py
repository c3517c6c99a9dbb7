"""Abusive, hateful and sexual content by a linear-chain conditional random field.

Texts are read as sentences of words; a word is first put back to its plain spelling (case, look-alike letters, digits for letters,
drawn-out letters, masked or split letters, signs put between letters). The field tags each word O, A (abusive), H (hateful) or S
(sexual) from the words around it; forward and backward sums give each word's marginal probabilities. A document's score for a
category is the largest marginal of it, and the offending offsets are the runs of words whose marginal is at least THRESHOLD. Within a sentence a category that others outweigh counts only if it
has a stretch of its own (see ``settled``), so that an insult isn't taken for hate or sex because of single words.

It is trained here, on labelled tokens: the seed sentences of ``toxic_seeds``, then the sentences of at most LABELLED_DOCS rated
documents (the only sample; which ones is decided by a hash of the id): of those that most raters pass all sentences are O, of those
that most flag the sentences that the first fit finds offending keep its tags. Scoring covers all documents in full.

Defined cases: null and empty texts score 0; null or other ratings than 0 and 1 don't count; documents with as many ratings for as
against are not used; sentences and words of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import need, table
from .toxic_seeds import sentences

LABELS = "OAHS"
CATEGORIES = ("abusive", "hateful", "sexual")
LABELLED_DOCS = 1000
THRESHOLD = 0.9
#: A category has its own stretch in a sentence if so many of its words reach the threshold, or if so much of what is offending there is its.
OWN_WORDS, OWN_SHARE = 4, 0.4
PAIRS = 1 << 16
#: Words scored at once.
PIECE = 400_000

_JOIN = "’'*@$!|._\\-­​‌‍⁠﻿"
_TOKEN = re.compile(rf"\w+(?:[{_JOIN}]+\w+)*|[.!?…]+(?=[\s\"'»”)\]*_]|$)|\n\r?\n")
_PARAGRAPH = "\x1e"
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .*_-][^\W_]){2,}(?![^\W_])")
_INNER = re.compile(rf"[{_JOIN}]+")
_RUN = re.compile(r"(.)\1{2,}")
_RUN2 = re.compile(r"(.)\1+")
# Letters of other scripts that look like Latin ones, and signs and digits that stand for letters.
_LOOK = str.maketrans("аеорсухіјѕԁһӏвкмнтпгԛԝαβεικνορτυχηωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhlbkmhtnrqwabeiknoptuxnwabezhikmnoptyx")
_LEET = str.maketrans("013457@$!|€", "oleastasiie"), str.maketrans("013457@$!|€", "oieastasile")


class Words:
    """Word numbers: 0 is a sentence's border, 1 any unknown word, 2 an unknown single letter."""

    def __init__(self, vocabulary: list[str], offensive: set[str]):
        self.number = {w: i + 3 for i, w in enumerate(vocabulary)}
        self.offensive = offensive
        self.by_length: dict[int, list[str]] = {}
        for w in sorted(offensive):
            self.by_length.setdefault(len(w), []).append(w)
        self.longest = max(map(len, offensive), default=0)
        self.collapsed = {_RUN2.sub(r"\1", w) for w in offensive}
        self.seen: dict[str, int] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.single = np.zeros(len(self.number) + 3, dtype=bool)
        self.single[[2, *(n for w, n in self.number.items() if len(w) == 1)]] = True

    def __len__(self) -> int:
        return len(self.number) + 3

    def __call__(self, token: str) -> int:
        n = self.seen.get(token)
        if n is None:
            n = self._find(token)
            if len(self.seen) < 500_000:
                self.seen[token] = n
        return n

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        """The numbers of what stands between two white spaces."""
        ids = (0,) if chunk == _PARAGRAPH else tuple(map(self, _TOKEN.findall(chunk)))
        if len(self.chunks) < 500_000:
            self.chunks[chunk] = ids
        return ids

    def _numbers(self, text: str) -> np.ndarray:
        chunks = text.replace("\r\n", "\n").replace("\n\n", f" {_PARAGRAPH} ").split()
        ids = list(map(self.chunks.get, chunks))
        if None in ids:
            ids = [self._chunk(chunks[i]) if x is None else x for i, x in enumerate(ids)]
        return np.fromiter(chain.from_iterable(ids), dtype=np.int32)

    def read(self, text: str) -> np.ndarray:
        """The text's word numbers; where three single letters follow each other they may be a word spaced out."""
        ids = self._numbers(text)
        single = self.single[ids]
        if (single[:-2] & single[1:-1] & single[2:]).any():
            ids = self._numbers(unspaced(text, self))
        return ids

    def _find(self, token: str) -> int:
        if token[0] in ".!?…\n":
            return 0
        low = plain(token)
        n = self.number.get(low)
        if n is not None:
            return n
        for form in self._forms(low):
            if form in self.offensive:
                return self.number[form]
        return 2 if len(low) == 1 else 1

    def _forms(self, low: str):
        """Spellings that low may be a disguise of; only offensive words are looked for."""
        bare = _INNER.sub("", low)
        bases = [low, bare] if bare != low else [low]
        if any(c.isdigit() or c in "@$!|€" for c in low) and any(c.isalpha() for c in low):
            bases += [b.translate(t) for b in (low, bare) for t in _LEET]
            bases += [_INNER.sub("", b) for b in bases]
        for b in bases:
            yield b
            if _RUN.search(b):
                yield _RUN.sub(r"\1", b)
                yield _RUN.sub(r"\1\1", b)
                yield _RUN2.sub(r"\1", b)
        if "*" in low and len(bare) < self.longest:
            for shape in (re.escape(low).replace(r"\*", "[^\\W_]"), re.escape(re.sub(r"\*+", "*", low)).replace(r"\*", "[^\\W_]{1,5}")):
                fits = re.compile(shape)
                for length in range(len(bare) + 1, len(bare) + 6):
                    for w in self.by_length.get(length, ()):
                        if fits.fullmatch(w):
                            yield w


def plain(token: str) -> str:
    t = token.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
        latin = sum(c.isascii() and c.isalpha() for c in t)
        looks = t.translate(_LOOK)
        # a word in another script stays as it is; one with Latin letters or look-alikes only is read as Latin
        t = looks if latin or looks.isascii() else t
        t = "".join(c for c in t if c not in "­​‌‍⁠﻿")
    return t.replace("’", "'").strip("_")


def unspaced(text: str, words: Words) -> str:
    """Letters spaced out into an offensive word are put together, with spaces after it, so all offsets stay.

    Drawn-out letters count as one, so a word's letters end within as many runs of equal letters as the longest word has: each place is
    looked at so far, whatever the length of what is spaced out.
    """

    def join(m: re.Match) -> str:
        spaced = m.group()
        letters = spaced[::2]
        runs = [(r.group()[0], r.start(), r.end()) for r in re.finditer(r"(.)\1*", letters, re.S)]
        spellings = ["".join(plain(c) or c for c, _, _ in runs)]
        if any(not c.isalpha() for c, _, _ in runs):
            spellings += [spellings[0].translate(t) for t in _LEET]
        out, done, i = [], 0, 0
        while i < len(runs):
            at = runs[i][1]
            for j in range(min(len(runs), i + words.longest), i, -1):
                end = runs[j - 1][2]
                w = letters[at:end]
                if len(w) > 2 and any(_RUN2.sub(r"\1", x[i:j]) in words.collapsed for x in spellings if len(x) == len(runs)):
                    low = plain(w)
                    if low in words.offensive or any(f in words.offensive for f in words._forms(low)):
                        out.append(spaced[done : at * 2] + w + " " * (len(w) - 1))
                        done, i = end * 2 - 1, j
                        break
            else:
                i += 1
        return "".join(out) + spaced[done:]

    return _SPACED.sub(join, text)


class Field:
    """Weights: of the word at each offset, of the pairs with the neighbours (hashed), of successive tags, and of a sentence's first."""

    OFFSETS = (-2, -1, 0, 1, 2)

    def __init__(self, words: int):
        self.w = np.zeros((len(self.OFFSETS), words, 4), dtype=np.float32)
        self.pairs = np.zeros((2, PAIRS, 4), dtype=np.float32)
        self.step = np.zeros((4, 4), dtype=np.float32)
        self.first = np.zeros(4, dtype=np.float32)

    def parts(self) -> list[np.ndarray]:
        return [self.w, self.pairs, self.step, self.first]

    @staticmethod
    def around(ids: np.ndarray, offset: int) -> np.ndarray:
        """The word at an offset, 0 beyond a border."""
        out = np.zeros_like(ids)
        n, k = len(ids), abs(offset)
        if not offset:
            return ids
        if k < n:
            if offset < 0:
                out[k:] = ids[:-k]
            else:
                out[:-k] = ids[k:]
        if k == 2:
            between = Field.around(ids, offset // 2)
            out[between == 0] = 0
        return out

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.int64) * 1_000_003 + b.astype(np.int64) * 7_919) ^ (a.astype(np.int64) >> 3)) & (PAIRS - 1)

    def features(self, ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        near = [self.around(ids, o) for o in self.OFFSETS]
        return near, [self.pair(near[1], ids), self.pair(ids, near[3])]

    def unary(self, ids: np.ndarray) -> np.ndarray:
        near, pairs = self.features(ids)
        u = np.zeros((len(ids), 4), dtype=np.float32)
        for k, x in enumerate(near):
            u += self.w[k][x]
        for k, x in enumerate(pairs):
            u += self.pairs[k][x]
        return u


def chains(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of words between borders, longest first."""
    word = ids != 0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], word.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    return starts[order].astype(np.int64), size[order].astype(np.int64)


class Packed:
    """Sentences side by side, longest first, their words place by place: what is at place t of all sentences is one stretch."""

    def __init__(self, ids: np.ndarray):
        starts, size = chains(ids)
        self.longest = int(size[0]) if len(size) else 0
        # active[t]: sentences longer than t; sizes fall, so they are the first ones
        self.active = np.searchsorted(-size, -np.arange(self.longest), side="left") if self.longest else np.zeros(0, dtype=np.int64)
        self.at = np.concatenate([starts[:k] + t for t, k in enumerate(self.active)]) if self.longest else np.zeros(0, dtype=np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.active)))
        self.starts = starts


def _forward_backward(field: Field, ids: np.ndarray):
    """In packed order: scores, forward and backward sums (each row of forward sums adds up to 1), and the scales."""
    packed = Packed(ids)
    u = field.unary(ids)[packed.at]
    top = u.max(axis=1)
    u -= top[:, None]
    e = np.exp(u, out=u)
    step, first = np.exp(field.step), np.exp(field.first)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty(len(e), dtype=np.float32)
    o, ones = packed.offset, np.ones(4, dtype=np.float32)
    for t in range(packed.longest):
        here = slice(o[t], o[t + 1])
        a = e[here] * first if t == 0 else (alpha[o[t - 1] : o[t - 1] + packed.active[t]] @ step) * e[here]
        s = a @ ones
        np.divide(a, s[:, None], out=alpha[here])
        scale[here] = s
    for t in range(packed.longest - 2, -1, -1):
        k = packed.active[t + 1]
        after = slice(o[t + 1], o[t + 1] + k)
        b = (e[after] * beta[after]) @ step.T
        beta[o[t] : o[t] + k] = b / scale[after][:, None]
    return packed, e, top, alpha, beta, scale, step


def marginals(field: Field, ids: np.ndarray) -> np.ndarray:
    """Each word's probability of each tag; rows of borders are zero."""
    packed, _, _, alpha, beta, _, _ = _forward_backward(field, ids)
    alpha *= beta
    p = np.zeros((len(ids), 4), dtype=np.float32)
    p[packed.at] = alpha / np.maximum(alpha @ np.ones(4, dtype=np.float32), 1e-30)[:, None]
    return p


def settled(p: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The marginals, lowered for categories that have neither OWN_SHARE of what is offending in the sentence nor OWN_WORDS sure words there. ids begin with a border."""
    starts = np.flatnonzero(ids == 0)
    mass = np.add.reduceat(p[:, 1:], starts, axis=0)
    sure = np.add.reduceat((p[:, 1:] >= THRESHOLD).astype(np.int32), starts, axis=0)
    share = mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-9)
    keep = np.where(sure >= OWN_WORDS, 1.0, np.minimum(1.0, share / OWN_SHARE)).astype(np.float32)
    out = p.copy()
    out[:, 1:] *= np.repeat(keep, np.diff(np.append(starts, len(ids))), axis=0)
    return out


def _expected(field: Field, ids: np.ndarray):
    """For training: marginals, expected steps between tags, sentences' starts, and the words that have one before them."""
    packed, e, _, alpha, beta, scale, step = _forward_backward(field, ids)
    steps, o = np.zeros((4, 4)), packed.offset
    for t in range(1, packed.longest):
        k = packed.active[t]
        here = slice(o[t], o[t + 1])
        steps += step * (alpha[o[t - 1] : o[t - 1] + k].T @ (e[here] * beta[here] / scale[here][:, None]))
    p = np.zeros((len(ids), 4), dtype=np.float32)
    alpha = alpha * beta
    p[packed.at] = alpha / np.maximum(alpha.sum(axis=1, keepdims=True), 1e-30)
    inner = ids != 0
    inner[packed.starts] = False
    return p, steps, packed.starts, np.flatnonzero(inner)


def fit(words: Words, ids: np.ndarray, tags: np.ndarray, rounds: int = 40, rate: float = 0.12, l2: float = 2e-4, seed: int = 5) -> Field:
    """Adam on the penalised likelihood. Some words are hidden in each round, so that the field doesn't hang on single words."""
    field, rng = Field(len(words)), np.random.default_rng(seed)
    m = [np.zeros_like(x) for x in field.parts()]
    v = [np.zeros_like(x) for x in field.parts()]
    gold = np.zeros((len(ids), 4), dtype=np.float32)
    gold[np.arange(len(ids)), tags] = 1
    for k in range(1, rounds + 1):
        seen = np.where((ids > 1) & (rng.random(len(ids)) < 0.12), 1, ids)
        p, pairs, starts, at = _expected(field, seen)
        miss = (gold - p) * (seen != 0)[:, None]
        near, hashed = field.features(seen)
        g_w, g_p = np.zeros_like(field.w), np.zeros_like(field.pairs)
        for label in range(4):
            for j, x in enumerate(near):
                g_w[j, :, label] = np.bincount(x, weights=miss[:, label], minlength=len(words))
            for j, x in enumerate(hashed):
                g_p[j, :, label] = np.bincount(x, weights=miss[:, label], minlength=PAIRS)
        real = np.zeros((4, 4))
        np.add.at(real, (tags[at - 1], tags[at]), 1)
        grads = [g_w, g_p, (real - pairs).astype(np.float32), (gold[starts] - p[starts]).sum(axis=0)]
        for x, g, a, b in zip(field.parts(), grads, m, v):
            g = g / 100 - l2 * x
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += (rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
    return field


def _numbers(words: Words, texts: list[str]) -> np.ndarray:
    """The texts one after the other, with borders."""
    border = np.zeros(1, dtype=np.int32)
    return np.concatenate([border, *(x for t in texts for x in (words.read(t), border))])


_COMMON = frozenset("a an the and or of to in on at is are was be been by for with from this that it you your i we they he she his her him them my our all not no so as but if until while just like one will would should must have has had do does who what where when me us their there here".split())


def train(passed: list[str], flagged: list[str]) -> tuple[Words, Field]:
    """From the seeds and the texts of rated documents."""
    labelled, counts, offensive = [], {}, set()
    for prefix, s, category in sentences():
        parts = ([(prefix, "O")] if prefix else []) + [(s, category)]
        labelled.append([(plain(w) if w[0] not in ".!?…\n" else "", c) for text, c in parts for w in _TOKEN.findall(text) if not (text == prefix and w == ".")])
        for w, c in labelled[-1]:
            if w and not w.startswith("group"):
                counts[w] = counts.get(w, 0) + 1
                if c != "O" and len(w) > 2 and w not in _COMMON:
                    offensive.add(w)
    own = set(counts)
    for t in passed:
        for w in {plain(x) for x in _TOKEN.findall(t) if x[0] not in ".!?…\n"}:
            if w.isalpha() and w not in own:
                counts[w] = counts.get(w, 0) + 1
    vocabulary = sorted(w for w, n in counts.items() if w in own or n >= 5)
    words = Words(vocabulary, offensive)

    def rows(passages: list[list[tuple[str, str]]]) -> tuple[np.ndarray, np.ndarray]:
        ids, tags = [0], [0]
        for s in passages:
            for w, c in s:
                ids.append(words.number.get(w, 1) if w else 0)
                tags.append(LABELS.index(c) if w else 0)
            ids.append(0)
            tags.append(0)
        return np.array(ids, dtype=np.int32), np.array(tags, dtype=np.int64)

    ids, tags = rows(labelled)
    calm = _numbers(words, passed)
    zero = np.zeros(1, dtype=np.int32)
    field = fit(words, np.concatenate((ids, calm, zero)), np.concatenate((tags, np.zeros(len(calm) + 1, dtype=np.int64))))
    # a rater may have passed an offending text: sentences that the fit finds offending though it was told they are not are left out
    p = marginals(field, calm)
    starts, size = chains(calm)
    keep = np.zeros(len(calm), dtype=bool)
    for s, n in zip(starts, size):
        keep[s : s + n + 1] = p[s : s + n, 1:].max() < 0.5
    found = _numbers(words, flagged)
    p = marginals(field, found)
    guess = p.argmax(axis=1)
    starts, size = chains(found)
    use = np.zeros(len(found), dtype=bool)
    for s, n in zip(starts, size):
        sure = p[s : s + n, 1:].max()
        use[s : s + n + 1] = sure > 0.8 or sure < 0.2
    ids = np.concatenate((ids, zero, calm[keep], zero, found[use], zero))
    tags = np.concatenate((tags, [0], np.zeros(int(keep.sum()), dtype=np.int64), [0], np.where(found[use] == 0, 0, guess[use]), [0]))
    return words, fit(words, ids, tags)


def _spans(text: str, words: Words, field: Field, threshold: float) -> list[dict]:
    """Runs of words over the threshold, with their offsets in the text."""
    found = list(_TOKEN.finditer(unspaced(text, words)))
    ids = np.array([0, *(words(m.group()) for m in found), 0], dtype=np.int32)
    p = settled(marginals(field, ids), ids)[1:-1]
    out = []
    for k, category in enumerate(CATEGORIES, 1):
        hit = p[:, k] >= threshold
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
        out += [{"category": category, "start": found[a].start(), "end": found[b - 1].end()} for a, b in zip(edge[::2], edge[1::2])]
    return sorted(out, key=lambda x: (x["start"], x["category"]))


class ToxicSpans:
    """Trains on the driver (a bounded sample), scores in a map."""

    def __init__(self, documents: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, labelled_docs: int = LABELLED_DOCS):
        rated = need(labels, "doc_id", "flagged").where(F.col("flagged").isin(0, 1)).groupBy("doc_id").agg(F.avg("flagged").alias("r")).where("r != 0.5")
        chosen = rated.orderBy(F.xxhash64("doc_id")).limit(labelled_docs).select(F.col("doc_id").alias("_id"), (F.col("r") > 0.5).alias("bad"))
        # at most labelled_docs narrow rows: broadcast whatever the size of the labels
        rows = need(documents, id_, text).join(F.broadcast(chosen), F.col(id_) == F.col("_id")).where(F.length(text) > 0).select("_id", "bad", F.col(text).alias("t")).orderBy("_id").collect()
        self.words, self.field = train([r["t"] for r in rows if not r["bad"]], [r["t"] for r in rows if r["bad"]])
        self.threshold = threshold

    def scores(self, df: DataFrame, id_: str, text: str, *carried: str) -> DataFrame:
        """id, carried columns, abusive, hateful, sexual (0 to 1), spans. One map, no shuffle."""
        words, field, threshold = self.words, self.field, self.threshold
        sent = df.sparkSession.sparkContext.broadcast((list(words.number), sorted(words.offensive), [x.astype(np.float16) for x in field.parts()]))  # a few MB whatever the input
        names = ["id", *carried]

        def run(batches):
            vocabulary, offensive, parts = sent.value
            words = Words(vocabulary, set(offensive))
            field = Field(len(words))
            field.w, field.pairs, field.step, field.first = (x.astype(np.float32) for x in parts)
            for b in batches:
                texts = b.column("_text").to_pylist()
                best = np.zeros((len(texts), 3))
                part: list[int] = []
                read: list[np.ndarray] = []

                def flush(best=best, part=part, read=read):
                    if part:
                        border = np.zeros(1, dtype=np.int32)
                        ids = np.concatenate([border, *(x for r in read for x in (r, border))])
                        p = settled(marginals(field, ids), ids)[:, 1:]
                        ends = np.cumsum([len(r) + 1 for r in read])
                        best[part] = np.maximum.reduceat(p, np.concatenate(([0], ends[:-1])), axis=0)
                    part.clear()
                    read.clear()

                size = 0
                for d, t in enumerate(texts):
                    if not t:
                        continue
                    part.append(d)
                    read.append(words.read(t))
                    size += len(read[-1])
                    if size > PIECE:
                        flush()
                        size = 0
                flush()
                spans = [_spans(t, words, field, threshold) if t and best[d].max() >= threshold else [] for d, t in enumerate(texts)]
                kind = pa.list_(pa.struct([("category", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(best[:, k]) for k in range(3)), pa.array(spans, kind)], names=[*names, *CATEGORIES, "spans"])

        rows = need(df, id_, text, *carried).select(F.col(id_).alias("id"), *carried, F.col(text).alias("_text"))
        types = dict(rows.dtypes)
        schema = ", ".join(f"`{c}` {types[c]}" for c in names) + ", abusive double, hateful double, sexual double, spans array<struct<category string, start int, end int>>"
        return rows.mapInArrow(run, schema)


def _p9(spark: SparkSession, sf_dir: str, *carried: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return ToxicSpans(documents, table(spark, sf_dir, "abuse_labels")).scores(documents, "doc_id", "text", *carried)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = F.array(*(F.when(F.col(c) >= THRESHOLD, c) for c in CATEGORIES))
    return _p9(spark, sf_dir).select(F.col("id").alias("doc_id"), F.explode(F.array_compact(over)).alias("category")).distinct()


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p9(spark, sf_dir, "source").withColumnRenamed("id", "doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the documents, those over the threshold by category, and the rate of those with any."""
    hit = [F.sum((F.col(c) >= THRESHOLD).cast("long")).alias(c) for c in CATEGORIES]
    anyone = F.greatest(*CATEGORIES) >= THRESHOLD
    return p9_scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), *hit, F.avg(anyone.cast("double")).alias("rate"))


QUERIES = {"p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates}
SQL: dict[str, str] = {}
