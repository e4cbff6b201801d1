"""The registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under the inventory's id and a name, with the SQL of the same result."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import messages, pages, records, runs, scalars, site, streams, tables, threads, upkeep, vectors, wiki

    assert all((messages, pages, records, scalars, streams, tables, threads, vectors))
    wiki.same_rows()
    return QUERIES, ORACLES
