"""Where the query modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Query name -> the operators of the blueprint that it exercises.
COVERS: dict[str, tuple[str, ...]] = {}


def query(*operators: str, sql: str | None = None):
    """Registers a query under its function's name, with the operators it covers and its DuckDB twin."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        COVERS[f.__name__] = operators
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add
