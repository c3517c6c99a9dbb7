"""Queries of condensing, selection and small functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import export as E
from ..functions import text as T
from ..operators import atlas as A
from ..operators import condense as C
from ..operators import intel as I
from ..operators import notes as N
from ..operators import select as S
from ..operators import similar as M
from ..operators import transform as X
from ..operators import links as L
from ..profiles import Profile
from ..shared import table
from .core import _M, _T, _TEMPLATE, _WORDS, LINES, NOTES, PROPS, _q

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


_P = Profile("probe", include=("**/*.md",), exclude=("archive/", "*-9*.md"), depth=3, path_regex="[a-m]", max_bytes=2000)
_G = lambda ps: "CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{_q(S.glob_regex(p))}') THEN true" for p in ps) + " ELSE false END"


@query("flt01_candidates", NOTES + f"""SELECT path FROM m WHERE lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1)) IN ('md', 'markdown', 'mdx', 'canvas') AND len(string_split(path, '/')) <= 4
AND {_G(_P.include)} AND NOT {_G(_P.exclude)} AND length(text) <= 2000 AND regexp_matches(path, '[a-m]')""")
def _candidates(spark: SparkSession, d: str) -> DataFrame:
    n = N.notes(spark, d).select("path", F.length("text").cast("long").alias("size"))
    return E.candidates(n, _P).where(F.size("reasons") == 0).select("path")


@query("flt17_definitions", LINES + f"""SELECT doc_id, line_no FROM (SELECT doc_id, line_no, {_T("line")} AS x FROM oc) WHERE length(x) BETWEEN 12 AND 320 AND NOT {_M("x", r"^\s*(?:[-*+>]|\d+[.)])\s")} AND NOT {_M("x", r"^\p{Ll}")}
AND NOT {_M("x", r"(?i)\b(?:todo|fixme|tbd)\b")} AND ({_M("x", r"(?i)\b(?:is|are|means|refers to|denotes|consists of|est|sont|désigne)\b")} OR {_M("x", "[.!?…]$")})""")
def _definitions(spark: SparkSession, d: str) -> DataFrame:
    at = N.outside_fences(N.lines(N.notes(spark, d), "doc_id")).withColumn("x", F.regexp_replace("line", r"^\s+|\s+$", ""))
    return at.where(C.definition_like(F.col("x"))).select("doc_id", "line_no")


@query("str10_compare_forms", NOTES + r"SELECT doc_id, trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g')) AS form FROM m")
def _compare(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", T.normalize_for_compare(F.col("title")).alias("form"))


@query("str16_masked_code", NOTES + f"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{_q(L.FENCED)}', '', 'g'), '{_q(L.SPAN)}', '', 'g')) AS text FROM m")
def _masked(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", F.md5(L.masked(F.col("text"))).alias("text"))


@query("str02_tokens_of_chars", NOTES + "SELECT doc_id, floor(length(text) / 3.6 + 0.5)::BIGINT AS tokens FROM m")
def _chars(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", T.tokens_of_chars(F.length("text")).alias("tokens"))


@query("mth03_reading_minutes", NOTES + f"SELECT doc_id, round({_WORDS} / 225.0, 1)::DOUBLE AS minutes FROM m")
def _minutes(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", A.reading_minutes(T.count_words(F.col("text"))).alias("minutes"))


@query("dat02_created", PROPS + """, c AS (SELECT doc_id, list_position(['created', 'date', 'created_at', 'ctime'], key) AS rank, trim(regexp_replace(value, '["'']', '', 'g')) AS v FROM pr WHERE key IN ('created', 'date', 'created_at', 'ctime')),
t AS (SELECT doc_id, rank, CASE WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(v AS TIMESTAMP) END AS created FROM c)
SELECT m.doc_id, strftime(x.created, '%Y-%m-%d') AS created FROM m LEFT JOIN (SELECT doc_id, arg_min(created, rank) AS created FROM t WHERE created IS NOT NULL GROUP BY 1) x USING (doc_id)""")
def _created(spark: SparkSession, d: str) -> DataFrame:
    return A.effective_created(N.notes(spark, d)).select("doc_id", F.date_format("created", "yyyy-MM-dd").alias("created"))


@query("arr02_titles", NOTES + r"""SELECT doc_id, coalesce(nullif(regexp_extract(regexp_extract(text, '^---\r?\n([\s\S]*?)\r?\n---', 1), '(?mi)^(?:title|name):[ \t]*["'']?([^\r\n]*?)["'']?[ \t]*\r?$', 1), ''), nullif(trim(regexp_extract(text, '(?m)^ {0,3}#[ \t]+([^\r\n]+?)[ \t#]*\r?$', 1)), ''), stem) AS title FROM m""")
def _titles(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", E.title_of(F.col("text"), F.col("path")).alias("title"))


@query("arr01_tag_sets", PROPS + rf""", it AS (SELECT doc_id, lower(regexp_replace(unnest(regexp_extract_all(regexp_replace(regexp_replace(text, '{_q(L.FENCED)}', '', 'g'), '{_q(L.SPAN)}', '', 'g'), '{_q(L.TAG)}', 1)), '/+$', '')) AS tag FROM m),
al AS (SELECT doc_id, tag FROM tg WHERE tag <> '' UNION SELECT doc_id, tag FROM it WHERE tag <> '' AND NOT regexp_matches(tag, '^[0-9]+$')) SELECT doc_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM al GROUP BY doc_id""")
def _tag_sets(spark: SparkSession, d: str) -> DataFrame:
    return E.all_tags(N.notes(spark, d)).select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("agg14_secret_kinds")
def _secret_kinds(spark: SparkSession, d: str) -> DataFrame:
    from .core import QUERIES as core

    return core["sec01_secret_scan"](spark, d).groupBy("kind").agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("notes"))


@query("cnd05_outlines", LINES + r""", h AS (SELECT doc_id, line_no, length(regexp_extract(line, '^ {0,3}(#{1,6})', 1)) AS level, trim(regexp_replace(regexp_extract(line, '^ {0,3}#{1,6}[ \t]+(.*)$', 1), '[ \t]+#+[ \t]*$', '')) AS title FROM oc WHERE regexp_matches(line, '^ {0,3}#{1,6}[ \t]')),
g AS (SELECT *, min(level) OVER (PARTITION BY doc_id) AS least FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM g WHERE level = least)
SELECT doc_id, string_agg(title, ' / ' ORDER BY line_no) AS outline FROM r WHERE i <= 24 GROUP BY doc_id""")
def _outlines(spark: SparkSession, d: str) -> DataFrame:
    return C.outline(N.notes(spark, d)).select("doc_id", F.array_join("outline", " / ").alias("outline"))


@query("cnd06_truncated", NOTES + r"""SELECT doc_id, md5(CASE WHEN length(text) <= 360 THEN text ELSE rtrim(CASE WHEN length(p) > 180 THEN p WHEN length(s) > 180 THEN s ELSE h END) || chr(10) || chr(10) || '… (cut)' END) AS text
FROM (SELECT *, regexp_extract(h, '(?s)^(.*)\n\n', 1) AS p, regexp_extract(h, '(?s)^(.*[.!?…])\s', 1) AS s FROM (SELECT doc_id, text, substr(text, 1, 360) AS h FROM m))""")
def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return N.notes(spark, d).select("doc_id", F.md5(C.truncated(F.col("text"), F.lit(100))).alias("text"))


@query("cnd02_repeated_lines", LINES + f""", one AS (SELECT md5(text) AS h, min(doc_id) AS doc_id FROM m GROUP BY 1), tm AS (SELECT doc_id, line_no, line, {_TEMPLATE} AS form, {_TEMPLATE.replace("regexp_replace(", "", 1).removesuffix(", '[0-9]+', '#', 'g')")} AS exact FROM li WHERE length(line) >= 10),
hf AS (SELECT form FROM tm JOIN one USING (doc_id) WHERE length(form) BETWEEN 10 AND 300 GROUP BY form HAVING count(DISTINCT doc_id) >= 3), he AS (SELECT exact FROM tm JOIN one USING (doc_id) WHERE length(exact) BETWEEN 10 AND 300 GROUP BY exact HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, line_no FROM tm WHERE length(trim(line)) >= 10 AND length(line) <= 400 AND (exact IN (SELECT exact FROM he) OR (NOT regexp_matches(line, '[0-9]') AND form IN (SELECT form FROM hf)))""")
def _repeated(spark: SparkSession, d: str) -> DataFrame:
    return C.repeated_lines(N.notes(spark, d))


@query("cnd02_without_boilerplate")
def _stripped(spark: SparkSession, d: str) -> DataFrame:
    return C.without_boilerplate(N.notes(spark, d)).select("doc_id", F.md5("text").alias("text"), "removed")


@query("cnd04_centroid_summary")
def _centroid(spark: SparkSession, d: str) -> DataFrame:
    return C.summaries(N.notes(spark, d))


@query("cnd04_keypoints_summary")
def _keypoints(spark: SparkSession, d: str) -> DataFrame:
    return C.summaries(N.notes(spark, d), "keypoints", fixed=8)


@query("cnd04_mmr_summary")
def _mmr(spark: SparkSession, d: str) -> DataFrame:
    return C.summaries(N.notes(spark, d), "mmr")


@query("cnd07_glossary")
def _glossary(spark: SparkSession, d: str) -> DataFrame:
    return C.glossary(N.notes(spark, d))


@query("trf00_transformed")
def _transformed(spark: SparkSession, d: str) -> DataFrame:
    return X.transformed(N.notes(spark, d))


@query("jon11_transcluded")
def _transcluded(spark: SparkSession, d: str) -> DataFrame:
    n = N.notes(spark, d)
    return X.transclude(n, L.owners(n)).select("path", F.md5("text").alias("text"), "transclusions")


@query("hsh03_signatures")
def _signatures(spark: SparkSession, d: str) -> DataFrame:
    return M.signatures(N.notes(spark, d)).select("doc_id", F.xxhash64("signature").alias("signature"))


@query("jon04_banded_pairs")
def _banded(spark: SparkSession, d: str) -> DataFrame:
    return M.banded_pairs(M.signatures(N.notes(spark, d)))


@query("jon05_contained_pairs", NOTES + r""", r AS (SELECT md5(text) AS h, min(doc_id) AS doc_id FROM m GROUP BY 1), w AS (SELECT m.doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM m JOIN r USING (doc_id)),
s AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i+7], ' ') FOR i IN range(1, len(w) - 6)]) AS s FROM w WHERE len(w) >= 8), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
SELECT a, b, round(i / x.n::DOUBLE, 6) AS containment FROM i JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE i / x.n::DOUBLE >= 0.93 AND (y.n > x.n OR (y.n = x.n AND a < b))""")
def _contained(spark: SparkSession, d: str) -> DataFrame:
    return M.contained_pairs(N.notes(spark, d)).select("a", "b", F.round("containment", 6).alias("containment"))


@query("agg13_themes")
def _themes(spark: SparkSession, d: str) -> DataFrame:
    n = N.notes(spark, d)
    return M.themes(M.banded_pairs(M.signatures(n)), N.key_terms(n)).select("theme", "notes", "label")


@query("jon12_attachments", NOTES + r""", e AS (SELECT DISTINCT doc_id, coalesce(nullif(x, ''), y) AS target FROM (SELECT doc_id, unnest(regexp_extract_all(text, '!\[\[([^\]|#\n]+)[^\]\n]*\]\]|!\[[^\]\n]*\]\(([^)\s]+)[^)\n]*\)', 1)) AS x, unnest(regexp_extract_all(text, '!\[\[([^\]|#\n]+)[^\]\n]*\]\]|!\[[^\]\n]*\]\(([^)\s]+)[^)\n]*\)', 2)) AS y FROM m)),
f AS (SELECT lower(regexp_extract(path, '([^/]*)$', 1)) AS name, min(path) AS path, max(size) AS bytes FROM source_files GROUP BY 1)
SELECT lower(regexp_extract(target, '([^/]*)$', 1)) AS name, count(DISTINCT doc_id) AS notes, max(f.bytes) AS bytes, bool_or(f.path IS NOT NULL) AS found FROM e LEFT JOIN f ON f.name = lower(regexp_extract(target, '([^/]*)$', 1)) GROUP BY 1""")
def _attached(spark: SparkSession, d: str) -> DataFrame:
    """Embedded files by name, how many notes embed them, and whether and how large they are listed."""
    emb = r"!\[\[([^\]|#\n]+)[^\]\n]*\]\]|!\[[^\]\n]*\]\(([^)\s]+)[^)\n]*\)"
    both = F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(emb), F.lit(1)).alias("x"), F.regexp_extract_all("text", F.lit(emb), F.lit(2)).alias("y"))).alias("e")
    refs = N.notes(spark, d).select("doc_id", both).select("doc_id", F.lower(T.base_name(F.coalesce(F.nullif("e.x", F.lit("")), F.col("e.y")))).alias("name")).distinct()
    refs = refs.groupBy("name").agg(F.count_distinct("doc_id").alias("notes"))
    files = table(spark, d, "source_files").groupBy(F.lower(T.base_name(F.col("path"))).alias("name")).agg(F.max("size").alias("bytes"), F.lit(True).alias("found"))
    return refs.join(files, "name", "left").select("name", "notes", "bytes", F.coalesce("found", F.lit(False)).alias("found"))
