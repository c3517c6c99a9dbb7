"""Queries of problem 5 and the SQL they must agree with."""

from ..operators.incremental import p5_changed, p5_found

QUERIES = {"p5_found": p5_found, "p5_changed": p5_changed}

_CASES = """
WITH newest AS (SELECT vault, max(scan_no) AS scan_no FROM source_files GROUP BY vault),
listed AS (
  SELECT s.vault, s.path, lower(s.content_hash) AS h, regexp_replace(replace(s.path, chr(92), '/'), '^(\\./)+', '') AS k,
         row_number() OVER (PARTITION BY s.vault, regexp_replace(replace(s.path, chr(92), '/'), '^(\\./)+', '')
                            ORDER BY s.listed_at DESC, s.path DESC, lower(s.content_hash) DESC) AS rn
  FROM source_files s JOIN newest n ON s.vault = n.vault AND s.scan_no = n.scan_no),
runs AS (SELECT vault, run_id, row_number() OVER (PARTITION BY vault ORDER BY generated_at DESC, run_id DESC) AS rn
         FROM export_runs WHERE status = 'ok' AND generated_at IS NOT NULL),
recorded AS (
  SELECT DISTINCT r.vault, regexp_replace(replace(m.path, chr(92), '/'), '^(\\./)+', '') AS k, lower(m.content_hash) AS h
  FROM manifest_hashes m JOIN runs r ON m.run_id = r.run_id AND r.rn = 1 WHERE m.content_hash IS NOT NULL)
SELECT l.vault, l.path, CASE WHEN EXISTS (SELECT 1 FROM recorded r WHERE r.vault = l.vault AND r.k = l.k) THEN 'changed' ELSE 'new' END AS change
FROM listed l WHERE l.rn = 1 AND NOT EXISTS (SELECT 1 FROM recorded r WHERE r.vault = l.vault AND r.k = l.k AND r.h = l.h)
"""
SQL = {"p5_changed": _CASES, "p5_found": f"SELECT DISTINCT vault, path FROM ({_CASES})"}
