"""Registry of runnable queries and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dunlin.plans import sqlbridge

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, same_as: str | None = None):
    """Register a query; ``sql`` may name the domain views of :mod:`dunlin.plans.sqlbridge`.

    ``same_as`` names a registered query whose result this one must reproduce.
    """
    def wrap(fn: Query) -> Query:
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if same_as is not None:
            ORACLES[key] = ORACLES[same_as]
        elif sql is not None:
            ORACLES[key] = sqlbridge.compose(sql)
        return fn
    return wrap
