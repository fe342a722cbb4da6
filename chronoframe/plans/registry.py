"""The named queries over the timeline operators, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under a name."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from chronoframe.plans import files, media, reports, requests, sql, timeline  # noqa: F401

    return QUERIES


def oracle_sql() -> dict[str, str]:
    from chronoframe.plans import files, media, reports, requests, sql, timeline  # noqa: F401

    return SQL
