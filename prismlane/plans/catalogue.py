"""Every query of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

from prismlane.plans import queries_folds, queries_joins, queries_more, queries_ordered, queries_scores, queries_tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (queries_scores, queries_ordered, queries_joins, queries_folds, queries_tables, queries_more):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.SQL
