"""The registered queries: name, Spark plan, and SQL to check it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from replyloom.plans.oracle import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the views of :mod:`replyloom.plans.oracle`."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return function

    return add


def load_all() -> None:
    from replyloom.plans import (  # noqa: F401
        queries_annotation, queries_metrics, queries_models, queries_rows, queries_text,
        queries_threads,
    )
