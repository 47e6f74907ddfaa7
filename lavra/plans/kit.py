"""Collects the queries of a module with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable


def collector() -> tuple[Callable, dict, dict[str, str]]:
    """A decorator that registers a query under its function's name, and what it fills: queries and SQL."""
    queries: dict = {}
    oracle: dict[str, str] = {}

    def query(sql: str = "") -> Callable:
        def keep(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return keep

    return query, queries, oracle
