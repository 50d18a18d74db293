"""Unions and differences of logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workfold.functions.exprs import pack_id, terminal


def union_shards(logs: dict[int, DataFrame]) -> DataFrame:
    """All shards' logs in one, each event with its shard and an id unique over the shards."""
    tagged = [log.withColumns({"shard": F.lit(n), "id": pack_id(F.lit(n), "handle")}) for n, log in logs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def undrained(lifecycle: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Submitted items without a terminal event."""
    per = lifecycle.groupBy(*(keys or ["handle"])).agg(
        F.max(F.col("kind") == "QUEUED").alias("submitted"), F.max(terminal()).alias("over"))
    return per.where("submitted and not over").drop("submitted", "over")
