"""All queries and their SQL by name."""

from __future__ import annotations

from . import evidence, korean, tables, text, vectors

PLANS = (evidence, text, vectors, tables, korean)
QUERIES = {name: f for p in PLANS for name, f in p.QUERIES.items()}
ORACLE_SQL = {name: s for p in PLANS for name, s in p.ORACLE_SQL.items()}
