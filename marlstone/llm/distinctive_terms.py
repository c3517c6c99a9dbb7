"""How distinctive a term is for a record: log-likelihood ratio against all other records.

For a record and a term the two-by-two table is (times of the term here, of other terms here; times of the term elsewhere, of other
terms elsewhere). The weight is G2 = 2 * sum(O * ln(O / E)), negated if the term is rarer here than elsewhere. Terms that many records
use alike have O near E everywhere and get weights near 0.

All sums are plain grouped sums (partially aggregated, so a record or term with a third of all rows is no hot task), joined back on
the record and the term. Defined cases: rows equal in every column count once; terms are compared lower-cased and trimmed; rows with a
null record, term or freq, with an empty term or freq <= 0 count nowhere; a collection of one record has weight 0 everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, lookup, need, table

SPACE = r"^[\s\x{00a0}\x{200b}\x{feff}]+|[\s\x{00a0}\x{200b}\x{feff}]+$"
#: TESTDATA.md: a term marks a note if it makes up this share of it and occurs in so many notes.
MARK_SHARE = 0.15
MARK_NOTES = (2, 12)


def _part(observed: Column, expected: Column) -> Column:
    return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)


def distinctive_terms(df: DataFrame, record: str, term: str, freq: str) -> DataFrame:
    """record, term, freq, record_total, term_total, document_frequency, share, weight."""
    rows = df.distinct().select(F.col(f"`{record}`").alias("record"), F.regexp_replace(F.lower(F.col(f"`{term}`")), SPACE, "").alias("term"), F.col(f"`{freq}`").cast("long").alias("freq"))
    rows = rows.where(F.col("record").isNotNull() & (F.length("term") > 0) & (F.col("freq") > 0))
    cells = cut(rows.groupBy("record", "term").agg(F.sum("freq").alias("freq")), "cells")  # read four times below
    records = cells.groupBy("record").agg(F.sum("freq").alias("record_total"))
    terms = cells.groupBy("term").agg(F.sum("freq").alias("term_total"), F.count("*").alias("document_frequency"))
    whole = cells.agg(F.sum("freq").alias("_n"))  # one row
    out = cells.join(records, "record").join(lookup(terms), "term").crossJoin(F.broadcast(whole))
    a = F.col("freq").cast("double")
    row, col, n = (F.col(c).cast("double") for c in ("record_total", "term_total", "_n"))
    b, c = row - a, col - a
    d = n - row - c
    g2 = 2 * (_part(a, row * col / n) + _part(b, row * (n - col) / n) + _part(c, (n - row) * col / n) + _part(d, (n - row) * (n - col) / n))
    weight = F.when(row >= n, 0.0).when(a * n >= row * col, F.greatest(g2, F.lit(0.0))).otherwise(-F.greatest(g2, F.lit(0.0)))
    return out.select(
        "record", "term", "freq", "record_total", "term_total", "document_frequency", (a / row).alias("share"), weight.alias("weight")
    )


def _p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive_terms(need(table(spark, sf_dir, "term_weights"), "note_id", "term_rank", "term", "freq", "weight"), "note_id", "term", "freq").withColumnRenamed("record", "note_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    least, most = MARK_NOTES
    # a mark must be more frequent here than elsewhere by its weight; 0.15 of the sum is compared in whole numbers
    marks = (F.col("weight") > 0) & (F.col("freq") * 100 >= F.col("record_total") * round(MARK_SHARE * 100)) & F.col("document_frequency").between(least, most)
    return _p4(spark, sf_dir).where(marks).select("note_id", "term")


def p4_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4(spark, sf_dir).select("note_id", "term", "freq", "document_frequency", F.round("weight", 6).alias("weight"))


QUERIES = {"p4_found": p4_found, "p4_weights": p4_weights}

_CELLS = r"""
WITH r AS (SELECT DISTINCT * FROM term_weights),
c AS (SELECT note_id, regexp_replace(lower(term), '^[\s\x{00a0}\x{200b}\x{feff}]+|[\s\x{00a0}\x{200b}\x{feff}]+$', '', 'g') AS term, sum(freq)::BIGINT AS freq
      FROM r WHERE note_id IS NOT NULL AND term IS NOT NULL AND freq > 0 GROUP BY 1, 2),
k AS (SELECT * FROM c WHERE term <> ''),
x AS (SELECT note_id, term, freq, sum(freq) OVER (PARTITION BY note_id)::DOUBLE AS row, sum(freq) OVER (PARTITION BY term)::DOUBLE AS col,
             count(*) OVER (PARTITION BY term) AS document_frequency, sum(freq) OVER ()::DOUBLE AS n FROM k),
p AS (SELECT *, freq::DOUBLE AS a, row - freq AS b, col - freq AS c, n - row - col + freq AS d FROM x),
g AS (SELECT *, 2 * (CASE WHEN a > 0 THEN a * ln(a / (row * col / n)) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b / (row * (n - col) / n)) ELSE 0 END
                     + CASE WHEN c > 0 THEN c * ln(c / ((n - row) * col / n)) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(d / ((n - row) * (n - col) / n)) ELSE 0 END) AS g2 FROM p)
"""
SQL = {
    "p4_found": _CELLS + "SELECT note_id, term FROM g WHERE freq * 100 >= row * 15 AND document_frequency BETWEEN 2 AND 12",
    "p4_weights": _CELLS
    + "SELECT note_id, term, freq, document_frequency, round(CASE WHEN row >= n THEN 0 WHEN a * n >= row * col THEN greatest(g2, 0) ELSE -greatest(g2, 0) END, 6) AS weight FROM g",
}
