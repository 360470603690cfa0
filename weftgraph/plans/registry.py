"""Where queries and the SQL that must give the same rows are entered, side by side."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def enter(f):
        if name in QUERIES:
            raise ValueError(f"{name} is entered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return enter
