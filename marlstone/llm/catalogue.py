"""The subpackage's queries and their SQL."""

from importlib import import_module

_MODULES = ("segments", "near_duplicates", "site_templates", "distinctive_terms", "boilerplate_chunks", "packing", "mixing", "toxic_spans")
_parts = [import_module(f"{__package__}.{m}") for m in _MODULES]
QUERIES = {name: query for part in _parts for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _parts for name, sql in part.SQL.items()}
