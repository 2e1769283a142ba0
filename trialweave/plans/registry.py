"""Registry of runnable queries and, where SQL can state them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def rnd(expr: str, alias: str | None = None) -> str:
    """SQL text of the report rounding."""
    text = f"round(CAST({expr} AS DOUBLE) + 1e-10, 6) + 0.0"
    return f"{text} AS {alias}" if alias else text
