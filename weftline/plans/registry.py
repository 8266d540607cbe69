"""The registered queries of the mapping engine, with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_EXAMPLES: dict[str, tuple[Query, str]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def example(name: str, sql: str) -> Callable[[Query], Query]:
    """Keep a question about a specification with the rows that it must give. It reads no table, so it is tested and not registered."""

    def add(f: Query) -> Query:
        _EXAMPLES[name] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    import weftline.plans.history_queries  # noqa: F401  fills the registry
    import weftline.plans.mapping_queries  # noqa: F401
    import weftline.plans.queries  # noqa: F401

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _SQL


def examples() -> dict[str, tuple[Query, str]]:
    queries()
    return _EXAMPLES
