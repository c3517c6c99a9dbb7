
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import transforms as X
from ..operators import graph as G
from ..operators import intel as I
from ..operators import links as L
from ..operators import notes as N
from ..operators import pack as P
from ..operators import select as S
from ..operators.incremental import path_key
from ..shared import cut, lookup, need, table
from ..sources.frontmatter import as_json
from ..streaming.refresh import fingerprint

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The day as of which ages are counted.
AS_OF = "2026-01-15"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


NOTES = r"""WITH n AS (SELECT doc_id, coalesce(path, concat('unfiled/', doc_id, '.md')) AS path, coalesce(title, '') AS title, coalesce(source, '') AS source,
  coalesce(lang, '') AS lang, text, mtime FROM documents WHERE text IS NOT NULL),
m AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]*$', '\1') AS stem FROM n)
"""
_STOP = ", ".join("'" + w + "'" for w in T.STOP)
def _q(pattern: str) -> str:
    """A pattern in an SQL literal."""
    return pattern.replace("'", "''")


_WORDS = f"len(regexp_extract_all(text, '{_q(T.WORD)}'))"
_STRIP = "x"
for _p, _t in T.MARKUP:
    _STRIP = f"regexp_replace({_STRIP}, '{_q(_p)}', '{_t.replace('$1', chr(92) + '1')}', 'g')"
_LINE = _STRIP.replace("(x,", "(regexp_replace(line, '^ {0,3}(#{1,6}[ \\t]+|> ?)', ''),", 1)
_TEMPLATE = f"regexp_replace(substr(trim(lower(regexp_replace(regexp_replace({_LINE}, '[*_`~]', '', 'g'), '\\s+', ' ', 'g'))), 1, 160), '[0-9]+', '#', 'g')"
LINES = NOTES + r""", ls AS (SELECT doc_id, folder, path, mtime, string_split(text, chr(10)) AS l FROM m),
li AS (SELECT doc_id, folder, path, mtime, unnest(range(1, len(l) + 1)) AS line_no, regexp_replace(unnest(l), '\r$', '') AS line FROM ls),
fe AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') AS fence FROM li),
oc AS (SELECT * FROM (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS o FROM fe) WHERE NOT fence AND o % 2 = 0)
"""
TERMS = NOTES + f""", tt AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_q(T.TERM)}')) AS term FROM m),
tf AS (SELECT doc_id, term, count(*) AS freq FROM tt WHERE length(term) <= 40 AND term NOT IN ({_STOP.replace("''", "'")}) GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, term) AS rank FROM tf QUALIFY rank <= 14),
df AS (SELECT term, count(*) AS df FROM top GROUP BY term),
nn AS (SELECT count(*) AS n FROM m),
sc AS (SELECT doc_id, term, df, ln(1 + n / (1 + df)) / sqrt(rank) AS weight FROM top JOIN df USING (term), nn WHERE n <= 6 OR df / n <= 0.6),
kt AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS rank FROM sc QUALIFY rank <= 8)
"""
PROPS = NOTES + r""", fl AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_extract(text, '^---\r?\n([\s\S]*?)\r?\n---', 1), '\r?\n')) AS line FROM m),
pr AS (SELECT doc_id, lower(trim(regexp_extract(line, '^([A-Za-z][A-Za-z0-9_ -]*):', 1))) AS key, trim(regexp_extract(line, '^[A-Za-z][A-Za-z0-9_ -]*:(.*)$', 1)) AS value
       FROM fl WHERE regexp_matches(line, '^[A-Za-z][A-Za-z0-9_ -]*:')),
tg AS (SELECT DISTINCT doc_id, lower(trim(unnest(regexp_split_to_array(regexp_replace(value, '[\[\]"'']', '', 'g'), '\s*,\s*')))) AS tag FROM pr WHERE key = 'tags')
"""
_NOTE_EXT = ", ".join(f"'{x}'" for x in ("", *L.NOTE_EXTENSIONS))
_EXT = r"lower(regexp_extract(regexp_extract(target, '([^/]*)$', 1), '^.+\.([^.]*)$', 1))"
#: xl: all links with their parts; lk: the distinct ones that can lead to notes; rs: a, target, b (null if it leads nowhere); le: edges between notes.
LINKS = NOTES + rf""", mk AS (SELECT doc_id, path, regexp_replace(regexp_replace(text, '{_q(L.FENCED)}', '', 'g'), '{_q(L.SPAN)}', '', 'g') AS t FROM m),
wk AS (SELECT doc_id, path, unnest(regexp_extract_all(t, '{_q(L.WIKI)}', 1)) = '!' AS embed, unnest(regexp_extract_all(t, '{_q(L.WIKI)}', 2)) AS x FROM mk),
md AS (SELECT doc_id, path, unnest(regexp_extract_all(t, '{_q(L.MARKDOWN)}', 1)) = '!' AS embed, unnest(regexp_extract_all(t, '{_q(L.MARKDOWN)}', 2)) AS label, unnest(regexp_extract_all(t, '{_q(L.MARKDOWN)}', 3)) AS x FROM mk),
ur AS (SELECT doc_id, path, unnest(regexp_extract_all(t, '{_q(L.URL)}', 1)) AS x, unnest(regexp_extract_all(t, '{_q(L.URL)}', 2)) AS y FROM mk),
an AS (SELECT *, split_part(x, '|', 1) AS dest, nullif(trim(regexp_extract(split_part(x, '|', 1), '^[^#]*#(.*)$', 1)), '') AS anchor FROM wk),
xl0 AS (SELECT doc_id, path, trim(split_part(dest, '#', 1)) AS target, CASE WHEN NOT starts_with(anchor, '^') THEN anchor END AS heading, CASE WHEN starts_with(anchor, '^') THEN substr(anchor, 2) END AS block, nullif(trim(regexp_extract(x, '^[^|]*\|(.*)$', 1)), '') AS alias, embed FROM an
 UNION ALL SELECT doc_id, path, trim(regexp_replace(x, '\s+"[^"]*"$', '')), NULL, NULL, nullif(trim(label), ''), embed FROM md UNION ALL SELECT doc_id, path, coalesce(nullif(x, ''), y), NULL, NULL, NULL, false FROM ur),
xl AS (SELECT *, regexp_matches(target, '(?i)^(?:https?:|mailto:|www\.)') AS external FROM xl0),
lk AS (SELECT DISTINCT doc_id, path AS a, target FROM xl WHERE NOT external AND target <> '' AND {_EXT} IN ({_NOTE_EXT})),
ow AS (SELECT kind, key, arg_min(path, (length(path), path)) AS path FROM (SELECT 'path' AS kind, lower(path) AS key, path FROM m UNION ALL SELECT 'name', lower(regexp_extract(path, '([^/]*)$', 1)), path FROM m UNION ALL SELECT 'name', lower(stem), path FROM m UNION ALL SELECT 'title', lower(trim(title)), path FROM m) WHERE key <> '' GROUP BY ALL),
lp AS (SELECT DISTINCT a, target, lower(target) AS t, lower(regexp_extract(target, '([^/]*)$', 1)) AS name, lower(regexp_extract(a, '^(.*)/[^/]*$', 1)) AS folder FROM lk),
lh AS (SELECT *, CASE WHEN folder = '' THEN name ELSE folder || '/' || name END AS here FROM lp),
la AS (SELECT a, target, unnest([1, 2, 2, 2, 2, 3, 4, 5]) AS rank, unnest(['path', 'path', 'path', 'path', 'path', 'name', 'name', 'title']) AS kind, unnest([t, here, here || '.md', name, name || '.md', name, name || '.md', t]) AS key FROM lh),
lb AS (SELECT a, target, arg_min(path, (rank, length(path), path)) AS b FROM la JOIN ow USING (kind, key) GROUP BY ALL),
rs AS (SELECT lp.a, lp.target, lb.b FROM lp LEFT JOIN lb USING (a, target)), le AS (SELECT DISTINCT a, b FROM rs WHERE b IS NOT NULL AND a <> b)
"""


@query("str01_token_estimate", NOTES + rf"""SELECT doc_id, CASE WHEN length(text) > 0 THEN greatest(1, floor(greatest(0, len(regexp_extract_all(text, '[^ \t\n\r]')) - cjk - sy) / 4 * 0.5 + w * 1.3 * 0.5 + sy * 0.3 + cjk + 0.5))::BIGINT ELSE 0 END AS tokens
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '{_q(T.CJK)}')) AS cjk, len(regexp_extract_all(text, '{_q(T.SYMBOL)}')) AS sy, len([x FOR x IN regexp_extract_all(text, '{_q(T.WORD)}') IF NOT regexp_matches(x, '{_q(T.CJK)}')]) AS w FROM m)""")
def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query("str03_doc_stats", NOTES + rf"SELECT doc_id, {_WORDS}::BIGINT AS words, length(text)::BIGINT AS chars, len(string_split(text, chr(10)))::BIGINT AS lines FROM m")
def _stats(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", T.count_words(F.col("text")).cast("long").alias("words"), F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n", -1)).cast("long").alias("lines"))


@query("str05_strip_markup", NOTES + f"SELECT doc_id, md5({_STRIP.replace('(x,', '(text,', 1)}) AS clean FROM m")
def _strip(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", F.md5(T.strip_inline_markup(F.col("text"))).alias("clean"))


@query("str06_slugs", NOTES + r"SELECT doc_id, regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM m")
def _slugs(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", T.slugify(F.col("title")).alias("slug"))


@query("str08_path_parts", NOTES + "SELECT doc_id, folder, stem FROM m")
def _paths(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", "folder", "stem")


_STEM_SQL = "CASE WHEN length(term) < 5 THEN term " + " ".join(f"WHEN term LIKE '%{s}' AND length(term) - {len(s)} >= 4 THEN substr(term, 1, length(term) - {len(s)})" for s in T.SUFFIXES) + " ELSE term END"


@query("str11_stems", TERMS + f"SELECT DISTINCT term, {_STEM_SQL} AS stem FROM tf")
def _stems(spark: SparkSession, d: str) -> DataFrame:
    return N.terms(N.notes(spark, d), "doc_id").select("term").distinct().withColumn("stem", T.stem_word(F.col("term")))


@query("trf03_without_comments", NOTES + r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<%.*?%>', '', 'g'), '(?s)%%.*?%%', '', 'g'), '(?s)<!--.*?-->', '', 'g')) AS text FROM m")
def _comments(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", F.md5(T.without_comments(F.col("text"))).alias("text"))


@query("trf16_blank_lines", NOTES + r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS text FROM m")
def _blank(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", F.md5(T.collapse_blank_lines(F.col("text"))).alias("text"))


@query("hsh01_exact_duplicates", NOTES + f"SELECT hash, arg_min(path, (-w, path)) AS representative, count(*) AS copies FROM (SELECT md5(text) AS hash, path, {_WORDS} AS w FROM m) GROUP BY hash HAVING count(*) > 1")
def _exact(spark: SparkSession, d: str) -> DataFrame:
    return I.exact_duplicates(N.notes(spark, d))


@query("agg01_line_frequency", LINES + f", t AS (SELECT DISTINCT doc_id, {_TEMPLATE} AS template FROM li) SELECT template, count(*) AS docs FROM t WHERE length(template) BETWEEN 10 AND 300 GROUP BY template HAVING count(*) >= 3")
def _lines(spark: SparkSession, d: str) -> DataFrame:
    return I.line_frequency(N.notes(spark, d))


@query("agg02_top_terms", TERMS + "SELECT doc_id, term, freq, rank FROM top")
def _top(spark: SparkSession, d: str) -> DataFrame:
    return N.top_terms(N.notes(spark, d))


@query("agg04_key_terms", TERMS + "SELECT doc_id, term, rank, round(weight, 6) AS weight FROM kt")
def _key(spark: SparkSession, d: str) -> DataFrame:
    return N.key_terms(N.notes(spark, d)).select("doc_id", "term", "rank", F.round("weight", 6).alias("weight"))


@query("agg07_term_rollup", TERMS + "SELECT term, round(sum(weight), 4) AS weight, count(*) AS notes FROM kt GROUP BY term ORDER BY round(sum(weight), 4) DESC, term LIMIT 40")
def _rollup(spark: SparkSession, d: str) -> DataFrame:
    g = N.key_terms(N.notes(spark, d)).groupBy("term").agg(F.round(F.sum("weight"), 4).alias("weight"), F.count("*").alias("notes"))
    return g.orderBy(F.desc("weight"), "term").limit(40)


@query("agg05_folder_stats", NOTES + f"SELECT folder, count(*) AS notes, sum({_WORDS})::BIGINT AS words FROM m GROUP BY folder")
def _folders(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).groupBy("folder").agg(F.count("*").alias("notes"), F.sum(T.count_words(F.col("text"))).cast("long").alias("words"))


@query("agg06_tag_counts", PROPS + "SELECT tag, count(*) AS notes FROM tg WHERE tag <> '' GROUP BY tag")
def _tags(spark: SparkSession, d: str) -> DataFrame:
    return N.tags(N.notes(spark, d), "doc_id").groupBy("tag").agg(F.count("*").alias("notes"))


@query("agg08_timeline", NOTES + "SELECT coalesce(strftime(mtime AT TIME ZONE 'UTC', '%Y-%m'), 'unknown') AS month, count(*) AS notes FROM m GROUP BY 1")
def _timeline(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).groupBy(F.coalesce(F.date_format("mtime", "yyyy-MM"), F.lit("unknown")).alias("month")).agg(F.count("*").alias("notes"))


@query("agg09_overview", NOTES + f"SELECT count(*) AS notes, sum({_WORDS})::BIGINT AS words, count(DISTINCT folder) AS folders, sum(length(text))::BIGINT AS chars FROM m")
def _overview(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).agg(F.count("*").alias("notes"), F.sum(T.count_words(F.col("text"))).cast("long").alias("words"), F.count_distinct("folder").alias("folders"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("agg10_property_schema", PROPS + r""", ty AS (SELECT DISTINCT doc_id, key, CASE WHEN regexp_matches(value, '^\[.*\]$') THEN 'list' WHEN regexp_matches(value, '^(true|false|True|False)$') THEN 'boolean'
 WHEN regexp_matches(value, '^-?[0-9]+(\.[0-9]+)?$') THEN 'number' WHEN regexp_matches(value, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' ELSE 'string' END AS type FROM pr WHERE value NOT IN ('', 'null', '~', '[]'))
SELECT key, count(DISTINCT doc_id) AS notes, CASE WHEN count(DISTINCT type) > 1 THEN 'mixed' ELSE max(type) END AS type FROM ty GROUP BY key""")
def _schema(spark: SparkSession, d: str) -> DataFrame:
    return N.property_schema(N.notes(spark, d))


_T = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_M = lambda c, p: f"regexp_matches({c}, '{_q(p)}')"


@query("agg11_open_tasks", LINES + rf""", tk AS (SELECT doc_id, line, regexp_extract(line, '^\s*[-*+]\s+\[([ /?])\]\s+(.*)$', 1) AS mark, regexp_extract(line, '^\s*[-*+]\s+\[([ /?])\]\s+(.*)$', 2) AS x FROM oc),
tx AS (SELECT doc_id, line, mark, trim({_STRIP}) AS t FROM tk WHERE mark <> '')
SELECT lower(t) AS text, count(DISTINCT doc_id) AS notes, max(CASE WHEN mark = '/' THEN 'in-progress' ELSE 'task' END) AS kind, max(CASE WHEN {_M("line", N.HIGH)} THEN 1 ELSE 0 END) AS high
FROM tx WHERE length(t) BETWEEN 4 AND 220 GROUP BY 1""")
def _tasks(spark: SparkSession, d: str) -> DataFrame:
    return N.open_tasks(N.notes(spark, d))


@query("agg11_open_items", NOTES + rf""", ib AS (SELECT doc_id, string_split(regexp_replace(text, '^---\r?\n[\s\S]*?\r?\n---', ''), chr(10)) AS l FROM m),
il AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, regexp_replace(unnest(l), '\r$', '') AS line FROM ib),
ig AS (SELECT *, {_M("line", N.FENCE)} AS fence, {_T("line")} AS tr FROM il),
io AS (SELECT *, {_M("tr", N.HEADING)} AS head FROM (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS o FROM ig) WHERE NOT fence AND o % 2 = 0),
iu AS (SELECT *, last_value(CASE WHEN head THEN {_M("tr", N.QUESTION_HEADING)} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS asked FROM io),
ir AS (SELECT doc_id, line, tr, regexp_extract(line, '{_q(N.TASK)}', 1) AS mark, CASE WHEN {_M("line", N.TASK)} THEN 1 WHEN {_M("tr", N.MARKER)} THEN 2 WHEN asked THEN 3 END AS rule FROM iu WHERE NOT head),
ix AS (SELECT *, {_T("CASE rule WHEN 1 THEN regexp_extract(line, '" + _q(N.TASK) + "', 2) WHEN 2 THEN regexp_extract(tr, '" + _q(N.MARKER) + "', 1) ELSE regexp_replace(tr, '^(?:[-*+]|[0-9]+[.)])\\s+', '') END")} AS x FROM ir WHERE rule IS NOT NULL),
iy AS (SELECT *, {_T(_STRIP)} AS t FROM ix),
iz AS (SELECT *, rule = 3 OR rule = 2 AND (ends_with(t, '?') OR regexp_matches(tr, '(?i)^question|❓')) AS question FROM iy
 WHERE CASE rule WHEN 1 THEN length(t) BETWEEN 4 AND 220 WHEN 2 THEN length(t) BETWEEN 6 AND 240 ELSE ends_with(t, '?') AND length(t) BETWEEN 12 AND 240 END)
SELECT lower(t) AS text, CASE WHEN question THEN 'question' WHEN bool_and(mark = '/') THEN 'in-progress' ELSE 'task' END AS kind, count(DISTINCT doc_id) AS notes, max({_M("line", N.HIGH)}::INT) AS high FROM iz GROUP BY lower(t), question""")
def _items(spark: SparkSession, d: str) -> DataFrame:
    """All three rules of AGG-11; agg11_open_tasks has the first."""
    return N.open_items(N.notes(spark, d))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Shared tags as links from a note to the tag: what links there are in the test tables' notes mostly lead nowhere."""
    t = N.tags(N.notes(spark, d), "path")
    return t.select(F.col("path").alias("a"), F.concat(F.lit("#"), "tag").alias("b"))


_EDGES = PROPS + ", e AS (SELECT DISTINCT m.path AS a, concat('#', tag) AS b FROM tg JOIN m USING (doc_id) WHERE tag <> ''), v AS (SELECT a AS node FROM e UNION SELECT b FROM e)"


def resolved_links(n: DataFrame) -> DataFrame:
    return L.resolve(L.internal(n, "path").select(F.col("path").alias("a"), "target"), L.owners(n))


@query("str18_links", LINKS + "SELECT doc_id, target, heading, block, alias, embed, external FROM xl")
def _links(spark: SparkSession, d: str) -> DataFrame:
    return L.extract(N.notes(spark, d), "doc_id")


@query("str18_inline_tags", NOTES + rf"""SELECT DISTINCT doc_id, tag FROM (SELECT doc_id, lower(regexp_replace(unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '{_q(L.FENCED)}', '', 'g'), '{_q(L.SPAN)}', '', 'g'), '{_q(L.TAG)}', 1)), '/+$', '')) AS tag FROM m) WHERE tag <> '' AND NOT regexp_matches(tag, '^[0-9]+$')""")
def _inline_tags(spark: SparkSession, d: str) -> DataFrame:
    return L.inline_tags(N.notes(spark, d), "doc_id")


@query("jon01_resolved_links", LINKS + "SELECT a, b FROM le")
def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return L.edges(resolved_links(N.notes(spark, d)))


@query("jon02_phantoms", LINKS + r"SELECT regexp_replace(lower(target), '\.md$', '') AS target, count(DISTINCT a) AS notes, min(target) AS spelling FROM rs WHERE b IS NULL GROUP BY 1")
def _phantoms(spark: SparkSession, d: str) -> DataFrame:
    lost = resolved_links(N.notes(spark, d)).where("b IS NULL")
    return lost.groupBy(F.regexp_replace(F.lower("target"), r"\.md$", "").alias("target")).agg(F.count_distinct("a").alias("notes"), F.min("target").alias("spelling"))


@query("grf04_degrees", _EDGES + " SELECT node, (SELECT count(*) FROM e WHERE a = node)::BIGINT AS out_degree, (SELECT count(*) FROM e WHERE b = node)::BIGINT AS in_degree FROM v")
def _degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_edges(spark, d))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()


_PR = _EDGES + ", o AS (SELECT v.node, count(e.b) AS o FROM v LEFT JOIN e ON e.a = v.node GROUP BY 1), c AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS MATERIALIZED (SELECT node, o, 1 / n AS rank FROM o, c)"
for _k in range(20):
    _PR += f""", r{_k + 1} AS MATERIALIZED (SELECT r.node, r.o, 0.15 / n + 0.85 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{_k} WHERE o = 0) / n) AS rank
 FROM r{_k} r LEFT JOIN (SELECT e.b AS node, sum(s.rank / s.o) AS got FROM e JOIN r{_k} s ON s.node = e.a GROUP BY 1) g ON g.node = r.node, c)"""


@query("grf02_pagerank", _PR + " SELECT node, round(rank / (SELECT max(rank) FROM r20), 6) AS rank FROM r20")
def _pagerank(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return G.pagerank(_nodes(e), e).select("node", F.round("rank", 6).alias("rank"))


_HITS = _EDGES + ", h0 AS MATERIALIZED (SELECT node, 1::DOUBLE AS hub, 1::DOUBLE AS authority FROM v)"
for _k in range(12):
    _HITS += f""", a{_k} AS MATERIALIZED (SELECT v.node, coalesce(sum(h.hub), 0) AS x FROM v LEFT JOIN e ON e.b = v.node LEFT JOIN h{_k} h ON h.node = e.a GROUP BY 1),
 b{_k} AS MATERIALIZED (SELECT node, x / (SELECT CASE WHEN sum(x * x) > 0 THEN sqrt(sum(x * x)) ELSE 1 END FROM a{_k}) AS authority FROM a{_k}),
 c{_k} AS MATERIALIZED (SELECT v.node, coalesce(sum(b.authority), 0) AS x FROM v LEFT JOIN e ON e.a = v.node LEFT JOIN b{_k} b ON b.node = e.b GROUP BY 1),
 h{_k + 1} AS MATERIALIZED (SELECT c.node, x / (SELECT CASE WHEN sum(x * x) > 0 THEN sqrt(sum(x * x)) ELSE 1 END FROM c{_k}) AS hub, b.authority FROM c{_k} c JOIN b{_k} b USING (node))"""


@query("grf03_hits", _HITS + " SELECT node, round(hub / (SELECT max(hub) FROM h12), 6) AS hub, round(authority / (SELECT max(authority) FROM h12), 6) AS authority FROM h12")
def _hits(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return G.hits(_nodes(e), e).select("node", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


@query("grf05_bridges", _EDGES + r""", f AS (SELECT node, coalesce(nullif(regexp_extract(node, '^(.*)/[^/]*$', 1), ''), '(root)') AS folder FROM v), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e)
SELECT node, count(DISTINCT folder) AS folders FROM (SELECT s.a AS node, f.folder FROM s JOIN f ON f.node = s.b UNION ALL SELECT node, folder FROM f) GROUP BY node""")
def _bridges(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return G.bridges(e, _nodes(e).withColumn("folder", F.coalesce(F.nullif(T.parent(F.col("node")), F.lit("")), F.lit("(root)"))))


@query("grf08_neighbourhood", _EDGES + """, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), h0 AS (SELECT DISTINCT b AS node FROM e WHERE b = (SELECT min(b) FROM e)),
h1 AS (SELECT DISTINCT b AS node FROM s JOIN h0 ON a = node), h2 AS (SELECT DISTINCT b AS node FROM s JOIN h1 ON a = node)
SELECT node, min(hop) AS hop FROM (SELECT node, 0 AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) GROUP BY node""")
def _hops(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return G.neighbourhood(e, e.agg(F.min("b").alias("node")).where(F.col("node").isNotNull()), 2)


GLOBS = ["**/*.md", "!**/archive/**", "!unfiled/"]
_GLOB_SQL = "false"
for _g in GLOBS:
    _GLOB_SQL = f"CASE WHEN regexp_matches(lower(path), '{_q(S.glob_regex(_g.lower()))}') THEN {str(not _g.startswith('!')).lower()} ELSE {_GLOB_SQL} END"


@query("flt02_globs", NOTES + f"SELECT doc_id, path FROM m WHERE {_GLOB_SQL}")
def _globs(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).where(S.glob_match(F.col("path"), GLOBS)).select("doc_id", "path")


@query("flt09_reasons", NOTES + f"""SELECT doc_id, array_to_string([x FOR x IN [CASE WHEN w < 60 THEN 'short' END, CASE WHEN w > 400 THEN 'long' END, CASE WHEN mtime IS NULL OR mtime < TIMESTAMPTZ '{AS_OF} 00:00:00+00' - INTERVAL 180 DAY THEN 'old' END,
 CASE WHEN NOT regexp_matches(text, '^---') THEN 'no-frontmatter' END] IF x IS NOT NULL], ',') AS reasons FROM (SELECT *, {_WORDS} AS w FROM m)""")
def _reasons(spark: SparkSession, d: str) -> DataFrame:
    w = T.count_words(F.col("text"))
    old = F.col("mtime").isNull() | (F.col("mtime") < F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 180 DAYS"))
    rules = {"short": w < 60, "long": w > 400, "old": old, "no-frontmatter": ~F.col("text").startswith("---")}
    return S.with_reasons(N.notes(spark, d), rules).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query("srt01_value_order", NOTES + f"""SELECT doc_id, round(0.6 * pow(0.5, greatest(age, 0) / 180) + 0.3 * log10(w + 1) / greatest(log10(mw + 1), 1e-9), 6) AS value
FROM (SELECT doc_id, coalesce(epoch(TIMESTAMPTZ '{AS_OF} 00:00:00+00') - floor(epoch(mtime)), 86400 * 3650) / 86400 AS age, {_WORDS} AS w, max({_WORDS}) OVER () AS mw FROM m)""")
def _value(spark: SparkSession, d: str) -> DataFrame:
    n = N.notes(spark, d).select("doc_id", "mtime", T.count_words(F.col("text")).alias("words"))
    most = n.agg(F.max("words").alias("_m"))
    age = F.coalesce(F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("mtime"), F.lit(86400 * 3650)) / 86400
    score = S.value_score(F.lit(0.0), F.lit(0.0), age, F.col("words"), F.col("_m"))
    return n.crossJoin(F.broadcast(most)).select("doc_id", F.round(score, 6).alias("value"))


_C = lambda p: f"len(regexp_extract_all(text, '{_q(p)}'))"
_HEAD, _LIST, _TASK, _LNK, _CODE = r"(?m)^ {0,3}#{1,6} ", r"(?m)^\s*[-*+] ", r"(?m)^\s*[-*+] \[[ xX/-]\] ", r"\[\[[^\]\n]+\]\]", r"(?m)^\s*(?:```|~~~)"


def _signal_of() -> F.Column:
    t = F.col("text")
    c = lambda p: T.count(t, p)
    return X.signal(T.count_words(t), c(_LNK), c(_HEAD), c(_CODE) > 0, c(_LIST), c(_TASK), F.size(F.split(t, "\n", -1)))


def _centrality(spark: SparkSession, d: str) -> DataFrame:
    """path, centrality: PageRank over all notes and the links between them, divided by the largest. Notes without links have the base rank."""
    r = G.pagerank(N.notes(spark, d).select(F.col("path").alias("node")).distinct(), _resolved(spark, d))
    return r.select(F.col("node").alias("path"), F.col("rank").alias("centrality"))


_OWN = ", e AS (SELECT a, b FROM le), v AS (SELECT DISTINCT path AS node FROM m)"
_SIGNAL = f"""greatest(0, least(1, least(1, log10(greatest(1, w) + 1) / 2.6) * 0.5 + CASE WHEN w > 0 THEN 0.24 ELSE 0 END + least(1, (h * 0.12 + CASE WHEN k > 0 THEN 0.25 ELSE 0 END) / 0.9) * 0.26
  - least(0.55, CASE WHEN w > 0 THEN l / greatest(1, w / 20) ELSE 0 END * 0.3 + li / greatest(n, 1) * 0.2 + t / greatest(n, 1) * 0.35)))"""


@query("srt01_note_value", LINKS + _OWN + _PR.removeprefix(_EDGES) + f""", sc AS (SELECT doc_id, {_WORDS} AS w, {_C(_LNK)} AS l, {_C(_HEAD)} AS h, {_C(_CODE)} AS k, {_C(_LIST)} AS li, {_C(_TASK)} AS t, len(string_split(text, chr(10))) AS n, mtime, path FROM m),
sg AS (SELECT doc_id, path, w, max(w) OVER () AS mw, coalesce(epoch(TIMESTAMPTZ '{AS_OF} 00:00:00+00') - floor(epoch(mtime)), 86400 * 3650) / 86400 AS age, {_SIGNAL} AS signal FROM sc)
SELECT doc_id, round(signal + rank / (SELECT max(rank) FROM r20) + 0.6 * pow(0.5, greatest(age, 0) / 180) + 0.3 * log10(w + 1) / greatest(log10(mw + 1), 1e-9), 6) AS value FROM sg JOIN r20 ON r20.node = path""")
def _note_value(spark: SparkSession, d: str) -> DataFrame:
    """The value with all four terms; srt01_value_order has age and length only."""
    n = N.notes(spark, d).select("doc_id", "path", "mtime", T.count_words(F.col("text")).alias("words"), _signal_of().alias("signal"))
    most = n.agg(F.max("words").alias("_m"))
    age = F.coalesce(F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("mtime"), F.lit(86400 * 3650)) / 86400
    score = S.value_score(F.col("signal"), F.col("centrality"), age, F.col("words"), F.col("_m"))
    return n.join(_centrality(spark, d), "path").crossJoin(F.broadcast(most)).select("doc_id", F.round(score, 6).alias("value"))


@query("srt02_natural_order")
def _natural(spark: SparkSession, d: str) -> DataFrame:
    """The place of every note when they are sorted as people would."""
    n = N.notes(spark, d).select("doc_id", "path", T.natural_order(F.col("path")).alias("_k"))
    return P.ordinals(n, [F.asc("_k"), F.asc("path"), F.asc("doc_id")]).select("doc_id", "path", "ordinal")


@query("srt04_note_cap", NOTES + f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_WORDS} DESC, path, doc_id) <= 500 THEN 'keep' ELSE 'drop' END AS action FROM m")
def _cap(spark: SparkSession, d: str) -> DataFrame:
    n = N.notes(spark, d).select("doc_id", "path", T.count_words(F.col("text")).alias("words"))
    return S.note_cap(n, [F.desc("words"), F.asc("path"), F.asc("doc_id")], 500).select("doc_id", "action")


@query("win01_citation_ids", NOTES + "SELECT doc_id, printf('S%02d', row_number() OVER (ORDER BY path, doc_id)) AS citation FROM m")
def _cite(spark: SparkSession, d: str) -> DataFrame:
    return P.citation_ids(N.notes(spark, d).select("doc_id", "path"), [F.asc("path"), F.asc("doc_id")]).select("doc_id", "citation")


DQL = 'TABLE source, words AS "Words" FROM -"unfiled" WHERE words > 200 AND contains(lang, "en") SORT words DESC LIMIT 40'


_NAT = r"list_aggregate([CASE WHEN regexp_matches(x, '^[0-9]+$') THEN lpad(regexp_replace(x, '^0+', ''), 12, '0') ELSE x END FOR x IN regexp_extract_all(lower({}), '[0-9]+|[^0-9]+')], 'string_agg', '')"


@query("dql02_table", NOTES + f"""SELECT stem AS "Note", coalesce(replace(source, '|', chr(92) || '|'), '—') AS source, w::VARCHAR AS "Words" FROM (SELECT *, {_WORDS} AS w FROM m)
WHERE NOT starts_with(lower(path), 'unfiled/') AND w > 200 AND contains(lower(lang), 'en') ORDER BY w DESC, {_NAT.format("path")} DESC LIMIT 40""")
def _dql(spark: SparkSession, d: str) -> DataFrame:
    n = N.notes(spark, d).withColumn("words", T.count_words(F.col("text")))
    return S.evaluate_table(S.parse_table(DQL), n, {c: F.col(c) for c in ("source", "lang", "title", "words", "folder")})


@query("dql02_parts", f"""SELECT p_partkey::VARCHAR AS "Note", coalesce(replace(p_brand, '|', chr(92) || '|'), '—') AS p_brand, p_size::VARCHAR AS size FROM part WHERE p_size >= 20 AND NOT contains(lower(p_type), 'brass') ORDER BY p_size DESC, lpad(p_partkey::VARCHAR, 12, '0') DESC LIMIT 30""")
def _dql_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumn("path", F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".md")))
    return S.evaluate_table(S.parse_table('TABLE p_brand, p_size AS size FROM "parts" WHERE p_size >= 20 AND !contains(p_type, "brass") SORT p_size DESC LIMIT 30'), p, {c: F.col(c) for c in ("p_brand", "p_size", "p_type")})


_FOCUS = ("drainage", "seedling", "telescope")


@query("rnk02_focus", TERMS + f""", q AS (SELECT * FROM kt WHERE term IN {_FOCUS}), id AS (SELECT term, ln(1 + n / (1 + max(df))) AS idf FROM q, nn GROUP BY term, n),
ti AS (SELECT DISTINCT doc_id, unnest(list_distinct(regexp_extract_all(lower(title), '{_q(T.TERM)}'))) AS term FROM m),
al AS (SELECT doc_id, term, sum(s) AS s FROM (SELECT doc_id, term, weight AS s FROM q UNION ALL SELECT doc_id, term, 2.5 * idf FROM ti JOIN id USING (term)) GROUP BY ALL),
pn AS (SELECT doc_id, sum(s) * CASE WHEN count(*) > 1 THEN 1 + 0.35 * (count(*) - 1) ELSE 1 END AS score, count(*) AS matched FROM al GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score, matched FROM pn JOIN m USING (doc_id) WHERE NOT contains(lower(title), 'review') AND NOT contains(lower(path), 'review') AND doc_id NOT IN (SELECT doc_id FROM kt WHERE term = 'review') ORDER BY round(score, 9) DESC, path LIMIT 20""")
def _focus(spark: SparkSession, d: str) -> DataFrame:
    n = N.notes(spark, d)
    r = S.rank_by_focus(n, N.key_terms(n), S.parse_focus(" ".join(_FOCUS) + " -review"))
    return r.select("doc_id", F.round("score", 6).alias("score"), "matched")


_KIND_SQL = "CASE WHEN length(line) > 4000 THEN NULL " + " ".join(f"WHEN regexp_matches(line, '{_q(p)}') THEN '{k}'" for k, p in (*I.SECRETS, I.EMAIL)) + " END"


_REDACT = f"regexp_replace(text, '{_q(I.PEM)}', '[redacted: private key block]', 'g')"
for _n, _p in (*I.SECRETS[1:], I.EMAIL):
    _to = r"\\1[redacted]" if _n == "named-secret" else f"[redacted: {_n}]"
    _REDACT = f"regexp_replace({_REDACT}, '{_q(I.NAMED if _n == 'named-secret' else _p)}', '{_to}', 'g')".replace("\\\\", "\\")


@query("sec01_secret_scan", LINES + f"SELECT doc_id, line_no, {_KIND_SQL} AS kind FROM li WHERE {_KIND_SQL} IS NOT NULL")
def _secrets(spark: SparkSession, d: str) -> DataFrame:
    return I.scan_secrets(N.notes(spark, d), pii=True)


@query("trf17_redacted", NOTES + f"SELECT doc_id, md5(clean) AS clean FROM (SELECT doc_id, text, {_REDACT} AS clean FROM m) WHERE clean <> text")
def _redacted(spark: SparkSession, d: str) -> DataFrame:
    n = N.notes(spark, d).withColumn("clean", I.redact(F.col("text"), pii=True))
    return n.where("clean <> text").select("doc_id", F.md5("clean").alias("clean"))


_CLAIMS = LINES + r""", cl AS (SELECT doc_id, line_no, regexp_extract_all(line, '([A-Za-z][A-Za-z0-9@_/-]{1,24})\s*(?:=|:|\bis\b|\bat\b)\s*([0-9]+(?:\.[0-9]+)?)', 1) AS s, regexp_extract_all(line, '([A-Za-z][A-Za-z0-9@_/-]{1,24})\s*(?:=|:|\bis\b|\bat\b)\s*([0-9]+(?:\.[0-9]+)?)', 2) AS v FROM oc WHERE length(line) <= 300),
ce AS (SELECT doc_id, line_no, unnest(range(len(s))) AS pos, lower(unnest(s)) AS subject, unnest(v) AS value FROM cl), cf AS (SELECT doc_id, subject, arg_min(value, (line_no, pos)) AS value FROM ce GROUP BY 1, 2)
"""


@query("drf01_claims", _CLAIMS + "SELECT doc_id, subject, value FROM cf")
def _claims(spark: SparkSession, d: str) -> DataFrame:
    return I.metric_claims(N.notes(spark, d))


@query("jon08_drift", _CLAIMS + """, p AS (SELECT subject, lag(path) OVER w AS older, path AS newer, lag(value) OVER w AS old, value AS new FROM cf JOIN m USING (doc_id) WHERE folder <> '' WINDOW w AS (PARTITION BY folder, subject ORDER BY mtime NULLS FIRST, path))
SELECT * FROM p WHERE old IS NOT NULL AND old <> new""")
def _drift(spark: SparkSession, d: str) -> DataFrame:
    n = N.notes(spark, d)
    return I.drift(n, I.metric_claims(n))


_list = lambda words: ", ".join(f"'{_q(w)}'" for w in words)
_SCALE_SQL = "CASE " + " ".join(f"WHEN value IN ({_list(ends)}) THEN '{name}'" for name, ends in I.SCALES.items()) + " END"
_RELATED = _CLAIMS + "".join(x.removeprefix(NOTES) for x in (TERMS, PROPS, LINKS)) + f""", sl AS (SELECT doc_id, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM oc),
sm AS (SELECT doc_id, line_no, regexp_extract_all(line, '(?i){_q(I.STATUS)}', 1) AS s, regexp_extract_all(line, '(?i){_q(I.STATUS)}', 2) AS v FROM sl WHERE length(line) <= 300),
sx AS (SELECT doc_id, line_no, unnest(range(len(s))) AS pos, lower(unnest(s)) AS s, lower(unnest(v)) AS value FROM sm),
sw AS (SELECT *, [w FOR w IN regexp_split_to_array(regexp_replace(s, '[\\s*_-]+$', ''), '\\s+') IF length(w) > 1 AND w NOT IN ({_list(T.STOP)})] AS w FROM sx),
sj AS (SELECT *, array_to_string(w[greatest(len(w) - 1, 1):], ' ') AS subject FROM sw),
sf AS (SELECT doc_id, subject, arg_min(value, (line_no, pos)) AS value FROM sj WHERE length(subject) >= 3 AND subject NOT IN ({_list(I.GENERIC)}) GROUP BY 1, 2),
ac AS (SELECT 'metric-drift' AS kind, '' AS scale, doc_id, subject, value FROM cf UNION ALL SELECT 'status-conflict', {_SCALE_SQL}, doc_id, subject, value FROM sf),
ed AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM le),
rl AS (SELECT doc_id, 'folder' AS relation, folder AS key FROM m WHERE folder <> '' UNION ALL SELECT doc_id, 'tag', tag FROM tg WHERE tag <> '' UNION ALL SELECT doc_id, 'term', term FROM top WHERE rank <= 12
 UNION ALL SELECT m.doc_id, 'link', concat(a, chr(10), b) FROM ed JOIN m ON m.path IN (a, b)),
rr AS (SELECT kind, subject, relation, key, scale, value, path, mtime FROM ac JOIN rl USING (doc_id) JOIN m USING (doc_id)),
rd AS (SELECT *, min(value) OVER g AS x, max(value) OVER g AS y, first_value(path) OVER (PARTITION BY kind, subject, relation, key, scale, value ORDER BY mtime NULLS FIRST, path) AS first FROM rr WINDOW g AS (PARTITION BY kind, subject, relation, key, scale))
"""


@query("jon08_related_drift", _RELATED + "SELECT kind, subject, relation, key, scale, value, first, path, mtime FROM rd WHERE x <> y")
def _related_drift(spark: SparkSession, d: str) -> DataFrame:
    """All drift between related notes; jon08_drift has each claim and the one before it in its folder."""
    return I.related_drift(N.notes(spark, d), _resolved(spark, d))


@query("cnd01_similar_pairs", NOTES + r""", r AS (SELECT md5(text) AS h, min(doc_id) AS doc_id FROM m GROUP BY 1), w AS (SELECT m.doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM m JOIN r USING (doc_id)),
s AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM w WHERE len(w) >= 5), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT a, b, round(i / (x.n + y.n - i)::DOUBLE, 6) AS similarity FROM i JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE i / (x.n + y.n - i)::DOUBLE >= 0.8""")
def _similar(spark: SparkSession, d: str) -> DataFrame:
    return I.similar_pairs(N.notes(spark, d)).select("a", "b", F.round("similarity", 6).alias("similarity"))


_GROUPS = SQL["cnd01_similar_pairs"].replace("SELECT a, b, round(i / (x.n + y.n - i)::DOUBLE, 6) AS similarity FROM i", ", p AS (SELECT a, b FROM i") + """),
cl AS (SELECT md5(text) AS h, min(doc_id) AS rep, count(*) AS copies FROM m GROUP BY 1), ed AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p UNION SELECT rep, rep FROM cl WHERE copies > 1),
rc AS (WITH RECURSIVE r AS (SELECT x, y FROM ed UNION SELECT r.x, ed.y FROM r JOIN ed ON ed.x = r.y) SELECT x, least(x, min(y)) AS component FROM r GROUP BY x),
nr AS (SELECT x, sum(copies) AS near FROM ed JOIN cl ON cl.rep = y WHERE x <> y GROUP BY x)
SELECT m.doc_id, component, rep AS representative, (copies - 1 + coalesce(near, 0))::BIGINT AS links FROM m JOIN cl ON cl.h = md5(m.text) JOIN rc ON rc.x = rep LEFT JOIN nr ON nr.x = rep"""


@query("set01_similar_groups", _GROUPS)
def _groups(spark: SparkSession, d: str) -> DataFrame:
    return I.similar_groups(N.notes(spark, d))


@query("jon06_nearest", """WITH q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), a AS (SELECT vec_id AS neighbour, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT id, neighbour, list_dot_product(q.v, a.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(a.v, a.v))) AS similarity FROM q, a WHERE id <> neighbour)
SELECT id, neighbour, row_number() OVER (PARTITION BY id ORDER BY round(similarity, 9) DESC, neighbour) AS rank FROM s QUALIFY rank <= 6""")
def _nearest(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return I.nearest(v, v.where("id % 20 = 0")).select("id", "neighbour", "rank")


_RUNS = r"""WITH ok AS (SELECT vault, run_id, row_number() OVER (PARTITION BY vault ORDER BY generated_at DESC, run_id DESC) AS rn FROM export_runs WHERE status = 'ok' AND generated_at IS NOT NULL),
h AS (SELECT DISTINCT ok.vault, rn, regexp_replace(replace(path, chr(92), '/'), '^(\./)+', '') AS path, lower(content_hash) AS hash FROM manifest_hashes m JOIN ok ON ok.run_id = m.run_id AND rn <= 2),
d AS (SELECT coalesce(n.vault, o.vault) AS vault, coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN n.hash <> o.hash THEN 'changed' ELSE 'unchanged' END AS state
 FROM (SELECT * FROM h WHERE rn = 1) n FULL JOIN (SELECT * FROM h WHERE rn = 2) o ON n.vault = o.vault AND n.path = o.path)
"""


def manifest_delta(spark: SparkSession, d: str) -> DataFrame:
    ok = need(table(spark, d, "export_runs"), "run_id", "vault", "status", "generated_at").where("status = 'ok' AND generated_at IS NOT NULL")
    ok = ok.withColumn("rn", F.row_number().over(W.partitionBy("vault").orderBy(F.desc("generated_at"), F.desc("run_id")))).where("rn <= 2").select("vault", "run_id", "rn")
    m = need(table(spark, d, "manifest_hashes"), "run_id", "path", "content_hash").join(lookup(ok), "run_id")
    h = m.select("vault", "rn", path_key(F.col("path")).alias("path"), F.lower("content_hash").alias("hash")).distinct()
    # both runs of a path meet in one group, so one shuffle does a full outer join's work
    g = h.groupBy("vault", "path").agg(F.max(F.when(F.col("rn") == 1, F.col("hash"))).alias("new"), F.max(F.when(F.col("rn") == 2, F.col("hash"))).alias("old"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") != F.col("old"), "changed").otherwise("unchanged")
    return g.select("vault", "path", state.alias("state"))


@query("jon13_manifest_delta", _RUNS + "SELECT vault, path, state FROM d")
def _delta(spark: SparkSession, d: str) -> DataFrame:
    return manifest_delta(spark, d)


@query("agg20_status", _RUNS + "SELECT vault, count(*) FILTER (state = 'added') AS added, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'removed') AS removed, count(*) FILTER (state = 'unchanged') AS unchanged FROM d GROUP BY vault")
def _status(spark: SparkSession, d: str) -> DataFrame:
    return manifest_delta(spark, d).groupBy("vault").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("added", "changed", "removed", "unchanged")))


@query("agg21_fingerprint", "SELECT count(*) AS files, sum(size)::BIGINT AS bytes, sum(('0x' || substr(md5(concat_ws('|', path, coalesce(size::VARCHAR, '-'), coalesce(epoch_us(mtime)::VARCHAR, '-'))), 1, 15))::BIGINT)::VARCHAR AS mark FROM source_files")
def _finger(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint(need(table(spark, d, "source_files"), "path", "size", "mtime"))


@query("agg16_plan_statistics", NOTES + f"SELECT count(*) AS discovered, count(*) FILTER (w >= 60) AS kept, count(*) FILTER (w < 60) AS dropped_short, sum(w) FILTER (w >= 60)::BIGINT AS words FROM (SELECT {_WORDS} AS w FROM m)")
def _plan(spark: SparkSession, d: str) -> DataFrame:
    w = N.notes(spark, d).select(T.count_words(F.col("text")).cast("long").alias("w"))
    return w.agg(F.count("*").alias("discovered"), F.count_if(F.col("w") >= 60).alias("kept"), F.count_if(F.col("w") < 60).alias("dropped_short"), F.sum(F.when(F.col("w") >= 60, F.col("w"))).alias("words"))


@query("set04_newest_states", r"SELECT vault, regexp_replace(replace(path, chr(92), '/'), '^(\./)+', '') AS path, arg_max(lower(content_hash), (recorded_at, run_id, lower(content_hash))) AS hash FROM manifest_hashes GROUP BY 1, 2")
def _union(spark: SparkSession, d: str) -> DataFrame:
    m = need(table(spark, d, "manifest_hashes"), "vault", "run_id", "path", "content_hash", "recorded_at")
    return m.groupBy("vault", path_key(F.col("path")).alias("path")).agg(F.max_by(F.lower("content_hash"), F.struct("recorded_at", "run_id", F.lower("content_hash"))).alias("hash"))


@query("stm02_sessions", """WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start, count(*) AS n FROM y GROUP BY user_id, s""")
def _sessions(spark: SparkSession, d: str) -> DataFrame:
    s = I.sessions(table(spark, d, "events"), "user_id", "ts", "30 minutes")
    return s.select("user_id", F.unix_seconds("start").alias("start"), "n")


@query("snk05_json_records", NOTES + """SELECT doc_id, path, title, lang, md5(content) AS content FROM (SELECT doc_id, path, nullif(title, '') AS title, nullif(lang, '') AS lang, nullif(text, '') AS content FROM m)""")
def _records(spark: SparkSession, d: str) -> DataFrame:
    """Each note's record, written as JSON and read again: what is not in the record is null."""
    r = N.notes(spark, d).select("doc_id", F.from_json(P.json_record(), "path string, title string, lang string, content string").alias("r"))
    return r.select("doc_id", "r.path", "r.title", "r.lang", F.md5("r.content").alias("content"))


@query("snk06_xml", NOTES + """SELECT doc_id, md5(concat('<document path="', replace(replace(replace(replace(path, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '" title="', replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '"><content><![CDATA[', replace(text, ']]>', ']]]]><![CDATA[>'), ']]></content></document>')) AS xml FROM m""")
def _xml(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", F.md5(P.xml_document()).alias("xml"))


@query("snk07_html")
def _html(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def html(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return P.html_articles(texts)

    return N.notes(spark, d).select("doc_id", html("text").alias("html"))


@query("cnd04_lead_summary", NOTES + """SELECT doc_id, CASE WHEN len(s) <= 3 THEN text ELSE trim(array_to_string([trim(x) FOR x IN s[1:3]], ' ')) END AS summary FROM (SELECT doc_id, text, regexp_extract_all(text, '[^.!?…]+[.!?…]+') AS s FROM m)""")
def _lead(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", P.lead_summary(F.col("text")).alias("summary"))


_BUDGET = 40_000


@query("bud01_budget", NOTES + f""", t AS (SELECT doc_id, ceil({_WORDS} * 1.35) AS tokens, round((1 + 0.3 * log10({_WORDS} + 10)) / greatest(ceil({_WORDS} * 1.35), 1), 9) AS density FROM m),
u AS (SELECT *, sum(ceil(tokens * 0.35)) OVER (ORDER BY density DESC, doc_id) AS upto, sum(tokens) OVER () AS f, sum(ceil(tokens * 0.35)) OVER () AS s FROM t)
SELECT doc_id, CASE WHEN f <= {_BUDGET} THEN 'full' WHEN s <= {_BUDGET} OR upto <= {_BUDGET} THEN 'summarize' ELSE 'drop' END AS action FROM u""")
def _budget(spark: SparkSession, d: str) -> DataFrame:
    w = T.count_words(F.col("text"))
    t = N.notes(spark, d).select("doc_id", w.alias("w")).select("doc_id", F.ceil(F.col("w") * P.WORDS_TO_TOKENS).alias("tokens"), "w")
    t = t.withColumn("density", F.round((1 + 0.3 * F.log10(F.col("w") + 10)) / F.greatest(F.col("tokens"), F.lit(1)), 9))
    return P.budget_ladder(t, _BUDGET).select("doc_id", "action")


@query("pck01_parts_per_folder", NOTES + rf""", t AS (SELECT folder, doc_id, CASE WHEN length(text) > 0 THEN greatest(1, floor(greatest(0, len(regexp_extract_all(text, '[^ \t\n\r]')) - cjk - sy) / 4 * 0.5 + w * 1.3 * 0.5 + sy * 0.3 + cjk + 0.5))::BIGINT ELSE 0 END AS tokens
FROM (SELECT folder, doc_id, text, len(regexp_extract_all(text, '{_q(T.CJK)}')) AS cjk, len(regexp_extract_all(text, '{_q(T.SYMBOL)}')) AS sy, len([x FOR x IN regexp_extract_all(text, '{_q(T.WORD)}') IF NOT regexp_matches(x, '{_q(T.CJK)}')]) AS w FROM m)),
o AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY doc_id) AS i FROM t),
r AS (WITH RECURSIVE p AS (SELECT folder, doc_id, tokens, i, tokens AS used, 1 AS part FROM o WHERE i = 1 UNION ALL
 SELECT o.folder, o.doc_id, o.tokens, o.i, CASE WHEN p.used > 0 AND p.used + o.tokens > 3300 THEN o.tokens ELSE p.used + o.tokens END, p.part + CASE WHEN p.used > 0 AND p.used + o.tokens > 3300 THEN 1 ELSE 0 END FROM p JOIN o ON o.folder = p.folder AND o.i = p.i + 1) SELECT * FROM p)
SELECT folder, doc_id, tokens, part FROM r""")
def _parts(spark: SparkSession, d: str) -> DataFrame:
    n = N.notes(spark, d).select("folder", "doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))
    return P.next_fit(n, "folder", "doc_id", "tokens", 3300)


@query("pck06_limits", NOTES + f", p AS (SELECT folder, sum({_WORDS}) AS used FROM m GROUP BY folder) SELECT count(*) AS parts, max(used)::BIGINT AS largest, CASE WHEN count(*) > 500 OR max(used) > 9000 THEN 'error' WHEN count(*) > 450 THEN 'warning' ELSE 'ok' END AS severity FROM p")
def _limits(spark: SparkSession, d: str) -> DataFrame:
    p = N.notes(spark, d).groupBy(F.col("folder").alias("part")).agg(F.sum(T.count_words(F.col("text"))).cast("long").alias("used"))
    return P.limits_check(p, 9000, 500)


@query("jsn01_frontmatter_data")
def _front(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("string")
    def data(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return as_json(texts)

    v = N.notes(spark, d).where(F.col("text").startswith("---")).select("doc_id", F.parse_json(data("text")).alias("v"))
    return v.select("doc_id", F.variant_get("v", "$.status", "string").alias("status"), F.try_variant_get("v", "$.priority", "long").alias("priority"), F.schema_of_variant("v").alias("schema"))


@query("export_slice")
def export_slice(spark: SparkSession, d: str) -> DataFrame:
    """End to end: notes without exact copies, in value order, numbered, within a budget, in parts."""
    n = N.notes(spark, d)
    first = n.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))
    n = n.join(first.select("doc_id"), "doc_id", "left_semi")
    sized = n.select("doc_id", "path", "source", "mtime", T.count_words(F.col("text")).alias("words"), T.estimate_tokens(F.col("text")).alias("tokens"), _signal_of().alias("signal"))
    sized = cut(sized, "sized").where("words >= 8")  # read for the largest and for the order
    most = sized.agg(F.max("words").alias("_m"))
    age = F.coalesce(F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp("mtime"), F.lit(86400 * 3650)) / 86400
    scored = sized.join(_centrality(spark, d), "path").crossJoin(F.broadcast(most)).withColumn("value", F.round(S.value_score(F.col("signal"), F.col("centrality"), age, F.col("words"), F.col("_m")), 6))
    order = [F.desc("value"), F.asc("path"), F.asc("doc_id")]
    cited = P.ordinals(scored, order, {"upto": F.col("tokens")}).withColumn("citation", F.format_string("S%02d", "ordinal"))
    return cited.select("citation", "doc_id", "source", "words", "tokens", (F.floor((F.col("upto") - 1) / 150_000) + 1).cast("int").alias("part"))
