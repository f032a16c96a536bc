"""Registered queries by name, with their SQL where SQL can express them."""

from . import clustering, geometric, mining, recordings, samples, timeline

_AREAS = (timeline, recordings, geometric, mining, clustering, samples)
QUERIES: dict = {name: query for area in _AREAS for name, query in area.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for area in _AREAS for name, sql in area.ORACLE_SQL.items()}
