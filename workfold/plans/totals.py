"""Total and per-task rows in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workfold import model as M

MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


def per_task_and_total(df: DataFrame, aggs: dict[str, tuple[Column, str]], key: str = "task") -> DataFrame:
    """Aggregate per key, then fold the few per-key rows into a '(total)' row as well.

    ``aggs`` maps a name to (aggregate, how its per-key values combine). Expanding after the
    first aggregation keeps the event rows from being doubled.
    """
    per_key = df.groupBy(key).agg(*[agg.alias(name) for name, (agg, _) in aggs.items()])
    folded = per_key.rollup(key).agg(
        *[MERGE[how](name).alias(name) for name, (_, how) in aggs.items()],
        F.grouping(key).alias("_total"),
    )
    return folded.select(
        F.when(F.col("_total") == 1, F.lit(M.TOTAL)).otherwise(F.col(key)).alias(key), *aggs,
    )
