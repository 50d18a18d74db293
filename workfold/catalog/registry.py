"""Where the runnable queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workfold.catalog.inputs import Inputs
from workfold.catalog.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def longs(df: DataFrame, *names: str) -> DataFrame:
    """Wide sums as LONG, for the comparison with SQL; those of the given tables fit."""
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def query(name: str, sql: str | None = None, views: list[str] | None = None):
    """Register ``fn(inputs)`` under a name, with the SQL that must give the same rows."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Inputs(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, views or [])
        return fn

    return add
