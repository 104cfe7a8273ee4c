"""Queries over the test tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL where SQL can express it."""

    def add(f: Query) -> Query:
        _FOUND[name or f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    from . import analytics, core, more, statistics  # noqa: F401

    return {k: f for k, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {k: s for k, (_, s) in _FOUND.items() if s is not None}
