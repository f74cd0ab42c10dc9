"""The list of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with DuckDB SQL of the same rows where there is any."""

    def add(f: Callable) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"query {f.__name__} exists")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
