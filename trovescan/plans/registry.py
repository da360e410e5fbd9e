"""Registered queries, and the SQL that checks each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trovescan.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its check if SQL can state one."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            CHECKS[run.__name__] = with_views(views, sql) if views else sql
        return run

    return register
