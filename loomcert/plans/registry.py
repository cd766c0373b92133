"""The table of registered queries: a name, a function of (spark, directory), and the same in SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function that takes (table, spark), where table(name) reads a table."""

    def add(f):
        from ..sources.tables import table

        def run(spark: SparkSession, root: str) -> DataFrame:
            return f(lambda t: table(spark, root, t))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add
