"""Named queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pathloom.plans.views import Graph, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Graph], DataFrame]], Callable[[Graph], DataFrame]]:
    """Registers a function of the graph under its name; ``sql`` may use the graph's views."""

    def register(f: Callable[[Graph], DataFrame]) -> Callable[[Graph], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Graph(spark, folder))
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return register
