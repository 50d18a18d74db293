"""Orders of a backlog as sort keys, positions and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workfold import model as M
from workfold.functions.exprs import U64, col
from workfold.plans.running import ordinal


def priority_keys() -> list[Column]:
    """Higher priority first, then submission order."""
    return [-F.col("priority").cast("long"), F.col("seq")]


def edf_keys() -> list[Column]:
    """Items with a due time first and by it alone; the others by priority; ties by submission."""
    due = F.nullif("due_ms", F.lit(0).cast("long"))
    none = due.isNull()
    return [none.cast("int"), F.coalesce(F.least(due, F.lit(M.DUE_MAX)), F.lit(0).cast("long")),
            F.when(none, -F.col("priority").cast("long")).otherwise(F.lit(0).cast("long")), F.col("seq")]


def aging_keys(ms_per_level: int) -> list[Column]:
    """priority * ms_per_level - enqueue time, highest first; the product is clamped."""
    product = F.col("priority").cast(U64) * F.lit(ms_per_level).cast("decimal(10,0)")
    clamped = F.greatest(F.lit(-M.AGING_MAX).cast(U64), F.least(product.cast(U64), F.lit(M.AGING_MAX).cast(U64))).cast("long")
    return [F.col("enqueue_ms") - clamped, F.col("seq")]


def router_keys(by_deadline: bool = True) -> list[Column]:
    """Due time where enabled (none: last), then priority, then submission order."""
    due = F.coalesce(F.nullif("due_ms", F.lit(0).cast("long")), F.lit(2**63 - 1)) if by_deadline else F.lit(0).cast("long")
    return [due, *priority_keys()]


def ordered(items: DataFrame, keys: list[Column], out: str = "pos", rows: int | None = None) -> DataFrame:
    """The items with their position under ``keys``, numbered without a global sort in one task."""
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    return ordinal(items.withColumns(named), [], list(named), out, rows=rows).drop(*named)


def topk_per_task(items: DataFrame, keys: list[Column], k: int) -> DataFrame:
    """First ``k`` per task; the limit is applied before the shuffle as well (WindowGroupLimit)."""
    by_task = Window.partitionBy("task").orderBy(*keys)
    return items.withColumn("rank", F.row_number().over(by_task)).where(F.col("rank") <= k)


def _shares(items: DataFrame, max_tenants: int) -> DataFrame:
    """Tenants in the order first seen; those past ``max_tenants`` share one share."""
    seen = items.groupBy("tenant").agg(F.min("seq").alias("_seen"))
    return ordinal(seen, [], ["_seen"], "_nth").select("tenant", (F.col("_nth") > max_tenants).alias("shared"))


def order_fair_share(items: DataFrame, weight: Column | str, max_tenants: int | None = None) -> DataFrame:
    """Weighted interleave of a backlog that is all queued before anything starts.

    The k-th item of a share gets tag (k-1)*floor(2^20/weight); items go by tag, then submission.
    """
    weighed = items.withColumn("shared", F.lit(False)) if max_tenants is None else items.join(_shares(items, max_tenants), "tenant")
    w = F.when(F.col("shared"), F.lit(1)).otherwise(F.least(F.greatest(col(weight), F.lit(1)), F.lit(M.FAIR_SCALE)))
    share = weighed.withColumns({"_share": F.when(F.col("shared"), F.lit(-1).cast("long")).otherwise(F.col("tenant")), "_w": w})
    numbered = ordinal(share, ["shared", "_share"], ["seq"], "_k")
    tag = (F.col("_k") - 1) * F.floor(F.lit(M.FAIR_SCALE) / F.col("_w")).cast("long")
    return ordered(numbered.withColumn("tag", tag), [F.col("tag"), F.col("seq")]).drop("_share", "_w", "_k")


def fair_overflow(items: DataFrame, max_tenants: int) -> DataFrame:
    """How many items and tenants are charged to the shared share."""
    per_tenant = items.groupBy("tenant").agg(F.min("seq").alias("_seen"), F.count("*").alias("n"))
    ranked = ordinal(per_tenant, [], ["_seen"], "_nth").where(F.col("_nth") > max_tenants)
    return ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.count("*").alias("tenants"))
