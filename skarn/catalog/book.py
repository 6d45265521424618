"""Registered queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skarn.catalog.adapters import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``key``, with its DuckDB text."""

    def add(fn: Callable[[Views], DataFrame]):
        QUERIES[key] = lambda spark, folder: fn(Views(spark, folder))
        if sql:
            ORACLES[key] = with_views(sql)
        return fn

    return add
