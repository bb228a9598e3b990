"""The registered queries and, where SQL can express them, their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under `name`, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load_all() -> None:
    """Import every module that registers queries."""
    from sparkloom.plans import analytics, documents, events, ingest, reports, retrieve, rules, scores, streams, structure, texts, verify  # noqa: F401
