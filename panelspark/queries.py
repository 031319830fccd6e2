"""All queries of the panel, text and signal operators over the given tables, and their SQL."""

from __future__ import annotations

from .checks import panel, tables, texts

_AREAS = (panel, tables, texts)
QUERIES = {name: run for area in _AREAS for name, run in area.QUERIES.items()}
ORACLE_SQL = {name: text for area in _AREAS for name, text in area.ORACLE_SQL.items()}
