"""The catalogue of queries by name, and the DuckDB SQL that checks each."""

from __future__ import annotations

import importlib

MODULES = ("relational", "discovery", "governed", "ranking", "results", "metrics", "meaning", "streams", "accepted", "rulings", "sourcing", "answers")


def catalogue():
    """All queries and all oracle SQL of this library."""
    queries, oracle = {}, {}
    for name in MODULES:
        m = importlib.import_module(f"{__name__}.{name}")
        queries |= m.QUERIES
        oracle |= m.ORACLE_SQL
    return queries, oracle
