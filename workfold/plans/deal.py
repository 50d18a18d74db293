"""Dealing rows by key into tasks that hold a bounded number of them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from workfold.session import rows_per_cell


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into one task for each ``rows_per_cell`` of ``rows``, and no fewer than run at once.

    Spark merges the partitions of a shuffle up to a size in bytes, and the smaller sides of a union into a share of
    the tasks; narrow rows that compress well are then millions a task, all of them in its sorts and hash tables.
    What one cell holds stays as it is. Sides dealt by the same ``rows`` and key meet without another shuffle.
    """
    spark = df.sparkSession
    tasks = -(-rows // rows_per_cell(spark))
    return df.repartition(max(tasks, spark.sparkContext.defaultParallelism), *keys) if tasks > 1 else df
