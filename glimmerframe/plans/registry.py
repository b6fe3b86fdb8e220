"""Every registered query of the core, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable:
    """Decorator: make a query known under name; sql is its equivalent for an independent engine."""

    def add(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        assert name not in QUERIES, name
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return add
