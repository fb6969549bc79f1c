"""All registered queries with their DuckDB twins."""

from __future__ import annotations

from . import analysis, control, extract, lookups, programs, reports, scoring, semantic, stats, texts

FLAGSHIP = "select_entities"
MODULES = (stats, lookups, scoring, texts, programs, reports, extract, control, semantic, analysis)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
