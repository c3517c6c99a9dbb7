"""All queries of the library without the llm subpackage, and their SQL."""

from . import core, extra, more, p5, probes

_PARTS = (core, more, extra, p5, probes)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
