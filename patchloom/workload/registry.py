"""Name → query and name → oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from patchloom.workload.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(views) -> DataFrame`` with the statement that must give the same rows."""

    def add(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views)
        return fn

    return add
