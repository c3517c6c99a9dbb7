"""Near-duplicate records by a size-aware heavy-light join.

Records are sets of hashed runs of k successive words; two are near-duplicates if the Jaccard similarity of their sets is at least t.
Equal sets are first folded into one class, so a group of exact copies of any size is one set. The shingles of a set are ordered by
document frequency, rarest first. With x not larger than y, J(x, y) >= t means that at least c common shingles lie both within the
first |x| - ceil(2t/(1+t)|x|) + c of x and within the first |y| - ceil(t|y|) + c of y: an overlap join with a fixed number c = 2 on
those prefixes. Shingles of one class only can't be common, so they count for the positions but leave the join after they were counted.

Shingles are moved once to be counted, and where they are counted they are also looked up. A shingle that very many records have (found
by counting those of one in HOT_EVERY records) goes to many tasks, its records spread over them; what is counted of it then serves as
its frequency. Frequencies only order the shingles, so no result depends on that.

That overlap join is size-aware. Small sets (at most X shared shingles in the prefix) list all their subsets of size two; two small
sets meet if they share one. Large sets scan the inverted lists of their shingles and keep partners met at least twice. X is where the
estimated rows of both parts together are fewest: sum over small sets of q(q-1)/2 against the lengths of the lists that large sets
scan. Candidates are then checked exactly. There is no cap on lists, partners or candidates.

Defined cases: null or empty bodies and those under k words have no shingles and no partner; rows re-delivered under one id count
once (their latest row); copies are members of one class with similarity 1; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..shared import cut, lookup, need, table

SHINGLE_WORDS = 5
SUBSET = 2
#: Shingles are looked at in one of so many records to find the hot ones, which so large a share of them have; their records go to so many tasks.
HOT_EVERY, HOT_SHARE, HOT_LEAST, HOT_TASKS = 64, 0.005, 64, 32
#: A class of exact copies up to this size is written out as all its pairs by ``pairs``; of a larger one each member is paired with
#: the class's representative (its least id), which with ``groups`` says the same.
COPIES_IN_FULL = 256


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"))


def _runs(w: Column, k: int) -> Column:
    """The runs of k words by position: the k shifted word lists, zipped; a run is complete if its last word is there."""
    shifted = [F.slice(w, i + 1, F.greatest(F.size(w) - i, F.lit(0))).alias(f"w{i}") for i in range(k)]
    return F.arrays_zip(*shifted)


def _rows(df: DataFrame, id_: str, text: str, order: str | None, k: int) -> DataFrame:
    """id, size, two checksums of the set, and the set, which is empty for texts under k words. Words are hashed once, and runs of k hashes again.

    There is no filter on what is computed here: it would be pushed down with the whole expression, which would then be computed twice.
    """
    rows = need(df, id_, text, *([order] if order else [])).where(F.col(id_).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(id_).alias("id"), F.transform(words(F.col(text)), lambda x: F.xxhash64(x)).alias("w"), *([F.col(order).alias("at")] if order else []))
    s = F.sort_array(F.array_distinct(F.transform(F.filter(_runs(F.col("w"), k), lambda r: r[f"w{k - 1}"].isNotNull()), lambda r: F.xxhash64(*[r[f"w{i}"] for i in range(k)]))))
    rows = rows.select("id", *(["at"] if order else []), s.alias("s"))
    return rows.select("id", *(["at"] if order else []), F.size("s").alias("n"), F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"), "s")


def _boundary(prefixes: DataFrame) -> int:
    """X by cost: q, scan of every set's probe. The sums are gathered by q, above 4096 by the next of 4096 steps an octave, so there are few whatever the sets."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.col("q"))) - 12, F.lit(0)))
    upto = (F.ceil(F.col("q") / step) * step).cast("long")
    rows = prefixes.select(upto.alias("u"), "q", "scan").groupBy("u").agg(F.count("*").alias("n"), F.sum(F.col("q") * (F.col("q") - 1) / 2).alias("pairs"), F.sum("scan").alias("scan")).orderBy("u").collect()
    best, least, subsets, scans = 1, None, 0, sum(r["scan"] for r in rows)
    for r in [{"u": 1, "pairs": 0, "scan": 0}, *rows]:
        subsets += r["pairs"]
        scans -= r["scan"]
        if least is None or subsets + scans < least:
            best, least = r["u"], subsets + scans
    return max(1, best)


class NearDuplicates:
    """The join over one table, its parts written once to the shared folder: members (id, rep), links (a, b, similarity)."""

    def __init__(self, df: DataFrame, id_: str, text: str, order: str | None = None, threshold: float = 0.8, k: int = SHINGLE_WORDS):
        if not 0.5 < threshold <= 1:
            raise ValueError("the threshold must be above 0.5 and at most 1")
        t = threshold
        rows = _rows(df, id_, text, order, k)
        keyed = cut(rows.select("id", *(["at"] if order else []), "n", "h1", "h2"), "keys")
        keys = keyed.groupBy("id").agg(F.max(F.struct(*(["at"] if order else []), "n", "h1", "h2")).alias("x")).select("id", "x.n", "x.h1", "x.h2").where("n > 0")
        reps = keys.groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
        self.members = cut(keys.join(reps, ["h1", "h2", "n"]).select("id", "rep", "n", "copies", "h1", "h2"), "members")
        # the sets again from the texts, of one row per class: of a record that is a copy, or isn't the latest under its id, none
        is_rep = self.members.where("id = rep").select("id", "h1", "h2")
        others = keyed.select("id", "h1", "h2").distinct().join(is_rep, ["id", "h1", "h2"], "left_anti")
        one = rows.join(lookup(others), ["id", "h1", "h2"], "left_anti").select("id", "s")
        total = is_rep.count()
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(HOT_EVERY)) == 0).select(F.explode_outer("s").alias("e")).where("e IS NOT NULL").groupBy("e").agg(F.count("*").alias("seen"))
        hot = lookup(cut(some.where(F.col("seen") >= max(HOT_LEAST, total * HOT_SHARE / HOT_EVERY)), "hot"))
        salt = F.when(F.col("seen").isNotNull(), F.pmod(F.xxhash64("id"), F.lit(HOT_TASKS))).otherwise(0).cast("int")
        postings = one.select("id", F.explode_outer("s").alias("e")).where("e IS NOT NULL").join(hot, "e", "left").select("id", "e", salt.alias("salt")).repartition("e", "salt")
        # the least and largest id keep both readers of the exchange alike, so it is written once; they differ if two classes have the shingle
        counted = postings.groupBy("e", "salt").agg(F.count("*").alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi")).join(hot, "e", "left")
        counted = counted.where("lo < hi OR seen IS NOT NULL").select("e", "salt", F.coalesce(F.col("seen") * HOT_EVERY, F.col("c")).alias("df"))
        shared = postings.join(counted.hint("shuffle_hash"), ["e", "salt"]).groupBy("id").agg(F.sort_array(F.collect_set(F.struct("df", "e"))).alias("s"))
        shared = shared.join(self.members.where("id = rep").select("id", "n"), "id")
        own = F.col("n") - F.size("s")
        index = F.col("n") - F.ceil(F.lit(2 * t / (1 + t)) * F.col("n") - 1e-9).cast("int") + SUBSET
        probe = F.col("n") - F.ceil(F.lit(t) * F.col("n") - 1e-9).cast("int") + SUBSET
        head = lambda first: F.least(F.greatest(first - own, F.lit(0)), F.size("s")).cast("int")
        lists = F.aggregate(F.slice("s", F.lit(1), head(probe)), F.lit(0).cast("long"), lambda a, x: a + x["df"])
        self.sets = cut(shared.select("id", "n", F.transform("s", lambda x: x["e"]).alias("e"), head(index).alias("p"), head(probe).alias("q"), lists.alias("scan")), "sets")
        prefixes = self.sets.where(F.col("q") >= SUBSET)
        self.boundary = _boundary(prefixes.select("q", "scan"))
        prefixes = prefixes.select("id", "n", F.slice("e", F.lit(1), F.col("p")).alias("index"), F.slice("e", F.lit(1), F.col("q")).alias("probe"))
        candidates = self._light(prefixes, t).union(self._heavy(prefixes, t)).distinct()
        self.links = cut(self._exact(candidates, t), "links")

    def _met(self, x: DataFrame, y: DataFrame, t: float) -> DataFrame:
        """Pairs of an index row (xi, xn) and a probe row (yi, yn) under one key; x is not larger, y not too large."""
        pairs = x.join(y, "key").where(((F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("xi") < F.col("yi")))) & (F.col("xn") >= F.lit(t) * F.col("yn") - 1e-9))
        return pairs.select("xi", "yi")

    def _light(self, prefixes: DataFrame, t: float) -> DataFrame:
        small = prefixes.where(F.size("probe") <= self.boundary)

        def subsets(col: str, i: str, n: str) -> DataFrame:
            # the pairs (e, later e), each ordered by value so that both sides make the same key
            pairs = F.flatten(
                F.transform(
                    F.col(col),
                    lambda a, p: F.transform(F.slice(F.col(col), p + 2, F.size(col)), lambda b: F.xxhash64(F.least(a, b), F.greatest(a, b))),
                )
            )
            return small.where(F.size(col) >= SUBSET).select(F.col("id").alias(i), F.col("n").alias(n), F.explode(pairs).alias("key"))

        return self._met(subsets("index", "xi", "xn"), subsets("probe", "yi", "yn"), t).distinct()

    def _heavy(self, prefixes: DataFrame, t: float) -> DataFrame:
        large = F.size("probe") > self.boundary

        def lists(col: str, i: str, n: str, where: Column) -> DataFrame:
            return prefixes.where(where).select(F.col("id").alias(i), F.col("n").alias(n), F.explode(col).alias("key"))

        everyone = F.lit(True)
        met = self._met(lists("index", "xi", "xn", everyone), lists("probe", "yi", "yn", large), t).union(self._met(lists("index", "xi", "xn", large), lists("probe", "yi", "yn", ~large), t))
        return met.groupBy("xi", "yi").agg(F.count("*").alias("c")).where(F.col("c") >= SUBSET).select("xi", "yi")

    def _exact(self, candidates: DataFrame, t: float) -> DataFrame:
        x = self.sets.select(F.col("id").alias("xi"), F.col("n").alias("xn"), F.col("e").alias("xe"))
        y = self.sets.select(F.col("id").alias("yi"), F.col("n").alias("yn"), F.col("e").alias("ye"))
        both = candidates.join(x, "xi").join(y, "yi").withColumn("i", F.size(F.array_intersect("xe", "ye")))
        sim = F.col("i") / (F.col("xn") + F.col("yn") - F.col("i"))
        return both.select(F.least("xi", "yi").alias("a"), F.greatest("xi", "yi").alias("b"), sim.alias("similarity")).where(F.col("similarity") >= t - 1e-12)

    def pairs(self) -> DataFrame:
        """id_a < id_b and their similarity, over members: see COPIES_IN_FULL for very large classes."""
        m = self.members.where((F.col("copies") <= COPIES_IN_FULL) | (F.col("id") == F.col("rep"))).select("id", "rep")
        between = self.links.join(m.select(F.col("id").alias("x"), F.col("rep").alias("a")), "a").join(m.select(F.col("id").alias("y"), F.col("rep").alias("b")), "b").select("x", "y", "similarity")
        multiple = self.members.where(F.col("copies") > 1)
        full = multiple.where(F.col("copies") <= COPIES_IN_FULL).select("id", "rep")
        within = full.select(F.col("id").alias("x"), "rep").join(full.select(F.col("id").alias("y"), "rep"), "rep").where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
        star = multiple.where((F.col("copies") > COPIES_IN_FULL) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("id").alias("y"), F.lit(1.0).alias("similarity"))
        every = between.union(within).union(star)
        return every.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")

    def groups(self) -> DataFrame:
        """One row per record in a group: id, group (least id of it), rep (of its copies), links of its class, the best similarity to another member."""
        copies = self.members.where("copies > 1").groupBy("rep").agg(F.count("*").alias("copies"))
        edges = self.links.select("a", "b").union(copies.select(F.col("rep").alias("a"), F.col("rep").alias("b")))
        groups = components(edges)
        ends = self.links.select(F.col("a").alias("node"), "similarity").union(self.links.select(F.col("b").alias("node"), "similarity"))
        best = ends.groupBy("node").agg(F.count("*").alias("links"), F.max("similarity").alias("best"))
        out = self.members.join(groups.withColumnRenamed("node", "rep"), "rep").join(best.withColumnRenamed("node", "rep"), "rep", "left")
        similarity = F.when(F.col("copies") > 1, 1.0).otherwise(F.col("best"))
        return out.select("id", F.col("component").alias("group"), "rep", F.coalesce("links", F.lit(0)).alias("links"), similarity.alias("similarity"))


#: TESTDATA.md fixes the similarity of this problem's pairs.
P2_SIMILARITY = 0.6


def _p2(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    return NearDuplicates(table(spark, sf_dir, "rendered_notes"), "note_id", "body", "exported_at", P2_SIMILARITY)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p2(spark, sf_dir).pairs().select(F.col("id_a").alias("note_id_a"), F.col("id_b").alias("note_id_b")).distinct()


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_id, group, links, similarity, and duplicate_of: the path of the group's least note, for all its other notes."""
    notes = table(spark, sf_dir, "rendered_notes")
    groups = _p2(spark, sf_dir).groups()
    path = need(notes, "note_id", "path").groupBy("note_id").agg(F.max("path").alias("duplicate_of"))
    out = groups.join(path.withColumnRenamed("note_id", "group"), "group", "left")
    return out.select(F.col("id").alias("note_id"), "group", "links", "similarity", F.when(F.col("id") != F.col("group"), F.col("duplicate_of")).alias("duplicate_of"))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}

_PAIRS = r"""
WITH n AS (SELECT note_id, max_by(body, exported_at) AS body FROM rendered_notes WHERE body IS NOT NULL GROUP BY note_id),
w AS (SELECT note_id, regexp_extract_all(lower(body), '[\p{L}\p{N}]+') AS w FROM n),
s AS (SELECT DISTINCT note_id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM w WHERE len(w) >= 5),
c AS (SELECT note_id, count(*) AS n FROM s GROUP BY note_id),
i AS (SELECT a.note_id AS a, b.note_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.note_id < b.note_id GROUP BY 1, 2)
SELECT a AS note_id_a, b AS note_id_b FROM i JOIN c x ON x.note_id = a JOIN c y ON y.note_id = b WHERE i / (x.n + y.n - i)::DOUBLE >= 0.6
"""
SQL = {"p2_found": _PAIRS}
