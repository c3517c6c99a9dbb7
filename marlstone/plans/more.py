"""Further queries of the engine's own operators: transforms, filters, rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import transforms as X
from ..operators import graph as G
from ..operators import notes as N
from ..operators import select as S
from ..operators import links as L
from ..shared import cut, need, table
from .core import _C, _CODE, _EDGES, _HEAD, _LIST, _LNK, _PR, _TASK, _WORDS, AS_OF, LINKS, NOTES, PROPS, _edges, _q, _resolved, _signal_of, resolved_links

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _rules(name: str, *rules: tuple[str, str]) -> None:
    """A query of texts (as checksums) after rules, and its SQL."""
    sql = "text"
    for pattern, to in rules:
        sql = f"regexp_replace({sql}, '{_q(pattern)}', '{to.replace('$', chr(92))}', 'g')"
    QUERIES[name] = lambda spark, d: N.notes(spark, d).select("doc_id", F.md5(X.apply(F.col("text"), *rules)).alias("text"))
    SQL[name] = NOTES + f"SELECT doc_id, md5({sql}) AS text FROM m"


_rules("trf05_query_blocks", X.QUERY_BLOCK)
_rules("trf08_callouts", X.CALLOUT)
_rules("trf09_tasks_cleared", X.TASK_BOX)
_rules("trf09_tasks_open_only", X.DONE_TASK, X.TASK_BOX)
_rules("trf10_link_labels", X.EMBED, *X.WIKI_LABEL)
_rules("trf11_external_labels", X.EXTERNAL, X.BARE_URL)
_rules("trf11_images_dropped", X.IMAGE)
_rules("trf12_tags_stripped", X.INLINE_TAG)


@query("trf07_headings_shifted", NOTES + "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?m)^(#{1,6}) ', '#\\1 ', 'g'), '(?m)^#{7,12} ', '###### ', 'g')) AS text FROM m")
def _shift(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", F.md5(X.shift_headings(F.col("text"), 1)).alias("text"))


@query("mth01_signal", NOTES + f""", c AS (SELECT doc_id, {_WORDS} AS w, {_C(_LNK)} AS l, {_C(_HEAD)} AS h, {_C(_CODE)} AS k, {_C(_LIST)} AS li, {_C(_TASK)} AS t, len(string_split(text, chr(10))) AS n FROM m)
SELECT doc_id, round(greatest(0, least(1, least(1, log10(greatest(1, w) + 1) / 2.6) * 0.5 + CASE WHEN w > 0 THEN 0.24 ELSE 0 END + least(1, (h * 0.12 + CASE WHEN k > 0 THEN 0.25 ELSE 0 END) / 0.9) * 0.26
 - least(0.55, CASE WHEN w > 0 THEN l / greatest(1, w / 20) ELSE 0 END * 0.3 + li / greatest(n, 1) * 0.2 + t / greatest(n, 1) * 0.35))), 6) AS signal FROM c""")
def _signal(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", F.round(_signal_of(), 6).alias("signal"))


@query("flt04_tags", PROPS + "SELECT doc_id FROM m WHERE doc_id IN (SELECT doc_id FROM tg WHERE tag = 'table' OR starts_with(tag, 'table/')) AND doc_id NOT IN (SELECT doc_id FROM tg WHERE starts_with(tag, 'note'))")
def _by_tags(spark: SparkSession, d: str) -> DataFrame:
    n = N.notes(spark, d)
    t = N.tags(n, "doc_id").groupBy("doc_id").agg(F.collect_set("tag").alias("tags"))  # of one note
    return t.where(S.tag_match(F.col("tags"), "table") & ~S.tag_match(F.col("tags"), "note*")).select("doc_id")


@query("flt06_recent", NOTES + f"SELECT doc_id FROM m WHERE mtime >= TIMESTAMPTZ '{AS_OF} 00:00:00+00' - INTERVAL 90 DAY")
def _recent(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).where(F.col("mtime") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 90 DAYS")).select("doc_id")


@query("flt08_required_key", PROPS + "SELECT DISTINCT doc_id FROM pr WHERE key = 'status' AND value NOT IN ('', 'null', '~')")
def _required(spark: SparkSession, d: str) -> DataFrame:
    return N.properties(N.notes(spark, d), "doc_id").where((F.col("key") == "status") & ~F.col("value").isin("", "null", "~")).select("doc_id").distinct()


@query("flt10_stubs", NOTES + f"SELECT doc_id FROM m WHERE {_WORDS} <= 12")
def _stubs(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).where(T.count_words(F.col("text")) <= 12).select("doc_id")


STALE = ("archived", "deprecated", "obsolete", "superseded")
_STALE = ", ".join(f"'{x}'" for x in STALE)


@query("jon09_stale_references", PROPS + LINKS.removeprefix(NOTES) + f""", st AS (SELECT doc_id, max(lower(value)) AS status FROM pr WHERE key = 'status' GROUP BY 1), ns AS (SELECT m.path, coalesce(status, 'active') AS status FROM m LEFT JOIN st USING (doc_id))
SELECT DISTINCT le.a AS caller, le.b AS stale, y.status FROM le JOIN ns x ON x.path = le.a JOIN ns y ON y.path = le.b WHERE x.status NOT IN ({_STALE}) AND y.status IN ({_STALE})""")
def _stale(spark: SparkSession, d: str) -> DataFrame:
    n = N.notes(spark, d)
    status = N.properties(n, "doc_id").where("key = 'status'").groupBy("doc_id").agg(F.max(F.lower("value")).alias("status"))
    named = n.join(status, "doc_id", "left").select("path", F.coalesce("status", F.lit("active")).alias("status"))
    old = F.col("status").isin(*STALE)
    e = _resolved(spark, d)
    return e.join(named.where(~old).select(F.col("path").alias("a")), "a").join(named.where(old).select(F.col("path").alias("b"), "status"), "b").select(F.col("a").alias("caller"), F.col("b").alias("stale"), "status").distinct()


_EMB = r"!\[\[([^\]|#\n]+)[^\]\n]*\]\]|!\[[^\]\n]*\]\(([^)\s]+)[^)\n]*\)"


@query("agg15_attachments", NOTES + f""", a AS (SELECT DISTINCT doc_id, coalesce(nullif(x, ''), y) AS target FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_q(_EMB)}', 1)) AS x, unnest(regexp_extract_all(text, '{_q(_EMB)}', 2)) AS y FROM m)),
b AS (SELECT doc_id, regexp_extract(target, '([^/]*)$', 1) AS name, lower(regexp_extract(regexp_extract(target, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1)) AS ext FROM a)
SELECT ext, count(DISTINCT name) AS files, count(*) AS refs FROM b WHERE ext NOT IN ('', 'md', 'markdown', 'mdx', 'canvas') GROUP BY ext""")
def _attachments(spark: SparkSession, d: str) -> DataFrame:
    both = F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(_EMB), F.lit(1)).alias("x"), F.regexp_extract_all("text", F.lit(_EMB), F.lit(2)).alias("y"))).alias("e")
    a = N.notes(spark, d).select("doc_id", both).select("doc_id", F.coalesce(F.nullif("e.x", F.lit("")), F.col("e.y")).alias("target")).distinct()
    b = a.select(T.base_name(F.col("target")).alias("name"), T.extension(F.col("target")).alias("ext"))
    return b.where(~F.col("ext").isin("", "md", "markdown", "mdx", "canvas")).groupBy("ext").agg(F.count_distinct("name").alias("files"), F.count("*").alias("refs"))


@query("agg17_transform_counters", "SELECT vault, count(*) AS outputs, sum(boilerplate_lines)::BIGINT AS boilerplate_lines, sum(transclusions)::BIGINT AS transclusions FROM transform_outputs GROUP BY vault")
def _counters(spark: SparkSession, d: str) -> DataFrame:
    t = need(table(spark, d, "transform_outputs"), "vault", "boilerplate_lines", "transclusions")
    return t.groupBy("vault").agg(F.count("*").alias("outputs"), F.sum("boilerplate_lines").alias("boilerplate_lines"), F.sum("transclusions").alias("transclusions"))


@query("srt06_hubs", _EDGES + " SELECT b AS node, count(*) AS in_degree FROM e GROUP BY b ORDER BY count(*) DESC, b LIMIT 25")
def _hubs(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_edges(spark, d)).where("in_degree > 0").orderBy(F.desc("in_degree"), "node").limit(25).select("node", "in_degree")


@query("grf06_dead_ends", LINKS + "SELECT path FROM m WHERE path NOT IN (SELECT a FROM le)")
def _dead(spark: SparkSession, d: str) -> DataFrame:
    """Notes from which no link leads to another note."""
    return N.notes(spark, d).join(_resolved(spark, d).select(F.col("a").alias("path")).distinct(), "path", "left_anti").select("path")


@query("grf06_orphans", LINKS + "SELECT path FROM m WHERE path NOT IN (SELECT a FROM le) AND path NOT IN (SELECT b FROM le)")
def _orphans(spark: SparkSession, d: str) -> DataFrame:
    e = _resolved(spark, d)
    ends = e.select(F.col("a").alias("path")).union(e.select("b")).distinct()
    return N.notes(spark, d).join(ends, "path", "left_anti").select("path")


@query("grf06_maps", LINKS + "SELECT a AS path, count(*) AS out_degree FROM le GROUP BY a HAVING count(*) >= 2 ORDER BY count(*) DESC, a LIMIT 15")
def _maps(spark: SparkSession, d: str) -> DataFrame:
    """The fifteen notes that link to most others, two at least."""
    g = _resolved(spark, d).groupBy(F.col("a").alias("path")).agg(F.count("*").alias("out_degree")).where("out_degree >= 2")
    return g.orderBy(F.desc("out_degree"), "path").limit(15)


_GE = LINKS + ", e AS (SELECT a, b FROM le), v AS (SELECT a AS node FROM e UNION SELECT b FROM e)"


@query("agg18_graph_report", _GE + r""" SELECT (SELECT count(*) FROM m) AS notes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM m WHERE path NOT IN (SELECT node FROM v)) AS orphans,
 (SELECT count(DISTINCT (a, regexp_replace(lower(target), '\.md$', ''))) FROM rs WHERE b IS NULL) AS outside""")
def _graph_report(spark: SparkSession, d: str) -> DataFrame:
    n = N.notes(spark, d)
    r = cut(resolved_links(n), "resolved")
    e = cut(L.edges(r), "edges")
    ends = e.select(F.col("a").alias("path")).union(e.select("b")).distinct()
    one = [n.agg(F.count("*").alias("notes")), e.agg(F.count("*").alias("edges")), n.join(ends, "path", "left_anti").agg(F.count("*").alias("orphans")), r.where("b IS NULL").select("a", F.regexp_replace(F.lower("target"), r"\.md$", "")).distinct().agg(F.count("*").alias("outside"))]
    return reduce(lambda x, y: x.crossJoin(F.broadcast(y)), one)  # of one row each


@query("grf04_link_degrees", _GE + " SELECT node, (SELECT count(*) FROM e WHERE a = node)::BIGINT AS out_degree, (SELECT count(*) FROM e WHERE b = node)::BIGINT AS in_degree FROM v")
def _link_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_resolved(spark, d))


@query("srt09_topology", _GE + _PR.removeprefix(_EDGES) + """, c AS (SELECT node, rank / (SELECT max(rank) FROM r20) AS c FROM r20), i AS (SELECT b, count(*) AS i FROM e GROUP BY b)
SELECT e.a, e.b, round((x.c + y.c) / 2 + 0.1 * i, 6) AS weight FROM e JOIN c x ON x.node = e.a JOIN c y ON y.node = e.b JOIN i ON i.b = e.b ORDER BY round((x.c + y.c) / 2 + 0.1 * i, 6) DESC, e.a, e.b LIMIT 14""".replace(", c AS (SELECT node", ", cc AS (SELECT node").replace("JOIN c x", "JOIN cc x").replace("JOIN c y", "JOIN cc y"))
def _topology(spark: SparkSession, d: str) -> DataFrame:
    """The fourteen links of most weight: the mean rank of their ends and a tenth per link to the second."""
    e = cut(_resolved(spark, d), "edges")
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    r = cut(G.pagerank(nodes, e), "ranks")
    deg = e.groupBy("b").agg(F.count("*").alias("i"))
    out = e.join(r.select(F.col("node").alias("a"), F.col("rank").alias("x")), "a").join(r.select(F.col("node").alias("b"), F.col("rank").alias("y")), "b").join(deg, "b")
    return out.select("a", "b", F.round((F.col("x") + F.col("y")) / 2 + 0.1 * F.col("i"), 6).alias("weight")).orderBy(F.desc("weight"), "a", "b").limit(14)
