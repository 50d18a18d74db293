"""Folding measurements: per name and method, per task and in total."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workfold import model as M
from workfold.functions.exprs import U64, measure, measure_method, plus_pct, point, round_mib, saturate
from workfold.plans.pin import pin
from workfold.plans.running import BEFORE, UPTO, running

POINT = ["ts_ms", "arrival"]


def measure_rows(lifecycle: DataFrame) -> DataFrame:
    """One row per measurement on an event; ``nth`` is its place among the event's."""
    one = lifecycle.where(F.size("measures") > 0).select(
        "handle", "task", "attempt", "ts_ms", "arrival", F.posexplode("measures").alias("nth", "m"))
    return one.select("handle", "task", "attempt", "ts_ms", "arrival", "nth", "m.*")


def _fold(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("count"),
        F.sum(F.col("value").cast(U64)).alias("sum"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.max(point()).alias("newest"), F.max_by("value", point()).alias("last"), F.max("ts_ms").alias("last_ms"),
        F.min(F.col("arrival").cast(U64) * 1000 + F.col("nth")).alias("seen"),
    )


def _refold(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.sum("count").alias("count"), F.sum("sum").alias("sum"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.max("newest").alias("newest"), F.max_by("last", "newest").alias("last"), F.max("last_ms").alias("last_ms"),
        F.min("seen").alias("seen"),
    )


def _judged(rows: DataFrame, max_rows: int | None, name_bytes: int | None) -> DataFrame:
    """Folded groups of every (task, name, method, unit, kind), each kept or refused with a reason.

    Refusals only depend on what was first seen, so they are decided on the folded groups: no
    per-value window, and one work type with most of the values is no hot spot.
    """
    keys = ["name", "method", "unit", "kind"]
    per_task = pin(_fold(rows, ["task", *keys]), "measures")
    total = _refold(per_task, keys).withColumn("task", F.lit(M.TOTAL))
    groups = per_task.unionByName(total)
    too_long = F.col("name").isNull() | F.col("method").isNull()
    if name_bytes is not None:
        too_long = too_long | (F.octet_length("name") >= name_bytes) | (F.octet_length("method") >= name_bytes)
    groups = groups.withColumn("too_long", too_long)
    row = Window.partitionBy("task", "name", "method", "too_long")  # at most one row per unit and kind
    groups = groups.withColumn("row_seen", F.min("seen").over(row))
    groups = groups.withColumn("refused", F.when(F.col("too_long"), "name").when(F.col("seen") > F.col("row_seen"), "unit"))
    if max_rows is None:
        return groups
    firsts = groups.where("refused is null").select("task", "row_seen")
    table = Window.partitionBy("task").orderBy("row_seen")
    full_from = firsts.withColumn("n", F.row_number().over(table)).where(F.col("n") <= max_rows).groupBy("task").agg(
        F.max("row_seen").alias("last_row"))
    return groups.join(full_from, "task", "left").withColumn(
        "refused", F.when(F.col("too_long"), "name").when(F.col("row_seen") > F.col("last_row"), "full")
        .otherwise(F.col("refused"))).drop("last_row")


def measure_fold(rows: DataFrame, max_rows: int | None = None, name_bytes: int | None = None) -> DataFrame:
    """Per task and '(total)', per (name, method): count, sum, min, max and last value.

    ``max_rows`` bounds the rows of a table, ``name_bytes`` the length of names; by default neither does.
    """
    return _judged(rows, max_rows, name_bytes).where("refused is null").select(
        "task", "name", "method", "unit", "kind", "count", saturate("sum").alias("sum"), "min", "max",
        "last", "last_ms")


def measure_drops(rows: DataFrame, max_rows: int | None = None, name_bytes: int | None = None) -> DataFrame:
    """Measurements a table refused, by reason; the total's table and each task's refuse on their own."""
    n = F.col("count")
    return _judged(rows, max_rows, name_bytes).groupBy("task").agg(
        *[F.coalesce(F.sum(F.when(F.col("refused") == r, n)), F.lit(0)).alias(f"dropped_{r}") for r in ("name", "unit", "full")])


def measure_combine(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One value per group, name and method, combined as its kind says."""
    by = by or ["handle"]
    per = rows.groupBy(*by, "name", "method", "unit", "kind").agg(
        F.max("value").cast(U64).alias("high"), F.sum(F.col("value").cast(U64)).alias("total"),
        F.max_by("value", point()).alias("latest"))
    latest = F.col("latest").cast(U64)
    value = (F.when(F.col("unit") == "CODE", latest).when(F.col("kind") == "PEAK", F.col("high"))
             .when(F.col("kind") == "TOTAL", saturate("total"))
             .when(F.col("kind") == "FLAG", F.least("high", F.lit(1).cast(U64))).otherwise(latest))
    return per.select(*by, "name", "method", "unit", "kind", value.alias("value"))


def merge_measures(folded: DataFrame, by: str = "task", order: str | None = None) -> DataFrame:
    """Fold measurement rows of several shards into one; empty ones add nothing.

    ``last`` is that of the newest stamp; at one stamp that of the last shard by ``order``.
    """
    newest = F.struct("last_ms", order) if order else F.struct("last_ms", F.lit(0))
    return folded.where(F.col("count") > 0).groupBy(by, "name", "method", "unit", "kind").agg(
        F.sum("count").alias("count"), saturate(F.sum("sum")).alias("sum"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.max_by("last", newest).alias("last"), F.max("last_ms").alias("last_ms"))


def _method(chars: int | None):
    method = measure_method("mem.peak")
    return method if chars is None else F.left(method, F.lit(chars))


def peak_memory(lifecycle: DataFrame, method_chars: int | None = None) -> DataFrame:
    """Highest mem.peak per task since its method last changed.

    The last run of one method starts after the newest value of any other method, so two
    aggregations find it; nothing is sorted per task.
    """
    rows = lifecycle.select("task", *POINT, measure("mem.peak").alias("value"),
                            _method(method_chars).alias("method")).where("method is not null")
    at = point()
    newest = rows.groupBy("task", "method").agg(F.max(at).alias("at"))
    by_task = Window.partitionBy("task").orderBy(F.desc("at"))  # one row per method
    turn = newest.select("task", "method", "at", F.row_number().over(by_task).alias("n"),
                         F.lead("at").over(by_task).alias("since")).where("n = 1").select("task", "method", "since")
    return rows.join(turn, ["task", "method"]).where(F.col("since").isNull() | (at > F.col("since"))).groupBy(
        "task", "method").agg(F.max("value").cast("long").alias("mem_peak"), F.count("*").alias("samples"))


def evidence(lifecycle: DataFrame, method_chars: int | None = None) -> DataFrame:
    """Ended attempts that say something about how much memory a task needs."""
    peak, hit = measure("mem.peak"), measure("mem.cap_hit")
    failed = F.col("kind") == "FAILED"
    stopped = failed & F.col("status").isin("CANCELLED", "TIMEOUT", "SHUTDOWN")
    measured = measure("cpu.user_ms").isNotNull() | peak.isNotNull()
    return lifecycle.where(
        F.col("kind").isin("FINISHED", "FAILED") & measured & ~stopped & measure("start.error").isNull()
    ).select(
        "task", *POINT, "mem_bytes", peak.cast("long").alias("peak"),
        F.when(peak.isNotNull(), F.coalesce(_method(method_chars), F.lit(""))).alias("method"),
        (F.coalesce(hit != 0, F.lit(False)) | (failed & (F.col("status") == "NOMEM"))).alias("was_hit"))


def suggestion(peak, hit_declared, samples, hits, min_samples: int, headroom_pct: int, grow_pct: int, floor_bytes: int):
    """Bytes to declare from the evidence; 0 while there is too little of it."""
    zero = F.lit(0).cast(U64)
    grown = F.greatest(
        F.when(F.col(peak) > 0, plus_pct(peak, headroom_pct)).otherwise(zero),
        F.when(F.col(hit_declared) > 0, plus_pct(hit_declared, grow_pct)).otherwise(zero))
    floored = F.when((grown > 0) & (grown < floor_bytes), F.lit(floor_bytes).cast(U64)).otherwise(grown)
    return F.when((F.col(hits) == 0) & (F.col(samples) < min_samples), zero).otherwise(round_mib(floored))


def suggest_memory(lifecycle: DataFrame, min_samples: int = 5, headroom_pct: int = 25, grow_pct: int = 50,
                   floor_bytes: int = M.MIB, method_chars: int | None = None) -> DataFrame:
    """Memory to declare per task, from its measured attempts.

    Folded per (task, method) first; the method of a task's first peak is then picked among a
    few rows, and other methods' peaks are counted but not used.
    """
    hit = F.col("was_hit")
    groups = evidence(lifecycle, method_chars).groupBy("task", "method").agg(
        F.min("arrival").alias("seen"), F.count("*").alias("n"), F.count_if("was_hit").alias("hits"),
        F.max("peak").alias("peak"), F.max(F.when(hit, F.col("mem_bytes"))).alias("hit_declared"),
        F.max("arrival").alias("at"), F.max_by("mem_bytes", "arrival").alias("declared"),
        F.max(F.when(hit, F.col("arrival"))).alias("hit_at"),
        F.max_by("mem_bytes", F.when(hit, F.col("arrival"))).alias("hit_at_declared"))
    by_task = Window.partitionBy("task")  # one row per method
    groups = groups.withColumn("own_seen", F.min(F.when(F.col("method").isNotNull(), F.col("seen"))).over(by_task))
    own = F.coalesce(F.col("method").isNotNull() & (F.col("seen") == F.col("own_seen")), F.lit(False))
    report = groups.groupBy("task").agg(
        F.max(F.when(own, F.col("method"))).alias("method"),
        F.coalesce(F.max(F.when(own, F.col("peak"))), F.lit(0)).alias("peak"),
        F.sum(F.when(own, F.col("n")).otherwise(F.col("hits"))).alias("samples"),
        F.sum("hits").alias("cap_hits"),
        F.coalesce(F.max("hit_declared"), F.lit(0)).alias("hit_declared"),
        F.max_by(F.when(own, F.col("declared")).otherwise(F.col("hit_at_declared")),
                 F.when(own, F.col("at")).otherwise(F.col("hit_at"))).alias("declared"),
        F.coalesce(F.sum(F.when(~own & F.col("method").isNotNull(), F.col("n"))), F.lit(0)).alias("other_method"))
    return report.withColumn("suggested", suggestion(
        "peak", "hit_declared", "samples", "cap_hits", min_samples, headroom_pct, grow_pct, floor_bytes))


def suggestion_history(lifecycle: DataFrame, min_samples: int = 5, headroom_pct: int = 25, grow_pct: int = 50,
                       floor_bytes: int = M.MIB, method_chars: int | None = None) -> DataFrame:
    """The suggestion after each piece of evidence, kept where it changes."""
    rows = evidence(lifecycle, method_chars)
    methods = rows.where("method is not null").groupBy("task", "method").agg(F.min("arrival").alias("seen"))
    rows = rows.join(methods.groupBy("task").agg(F.min_by("method", "seen").alias("own")), "task", "left")
    rows = rows.withColumn("own_peak", F.when(F.col("method") == F.col("own"), F.col("peak")))
    rows = rows.where(F.col("own_peak").isNotNull() | F.col("was_hit")).select(
        "task", *POINT, "mem_bytes", "own_peak", "was_hit")
    one, hit = F.lit(1).cast("long"), F.col("was_hit").cast("long")
    hit_mem = F.when(F.col("was_hit"), F.col("mem_bytes"))
    aggs = {}
    for tag, frame in (("", UPTO), ("_was", BEFORE)):
        aggs[f"peak{tag}_"] = ("max", F.col("own_peak"), frame)
        aggs[f"hit{tag}_"] = ("max", hit_mem, frame)
        aggs[f"n{tag}_"] = ("sum", one, frame)
        aggs[f"hits{tag}_"] = ("sum", hit, frame)
    run = running(rows, ["task"], ["arrival"], aggs)
    knobs = (min_samples, headroom_pct, grow_pct, floor_bytes)
    filled = run.withColumns({c: F.coalesce(c, F.lit(0)) for c in aggs})
    now = suggestion("peak_", "hit_", "n_", "hits_", *knobs)
    before = suggestion("peak_was_", "hit_was_", "n_was_", "hits_was_", *knobs)
    return filled.select("task", *POINT, now.alias("suggested"), before.alias("was")).where("suggested <> was")
