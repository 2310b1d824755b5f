"""Registration of named queries, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def key(name: str, sql: str | None = None):
    """Register ``f(views) -> DataFrame`` under a name."""

    def register(f: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql.strip())
        return f

    return register
