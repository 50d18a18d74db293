"""Values over time: gauges, peaks, rates, occupancy. Stamps are folded first, then carried forward in cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workfold import model as M
from workfold.functions.exprs import U64, event_class
from workfold.plans.attempts import attempt_pivot, cycled, run_ms
from workfold.plans.pin import pin
from workfold.plans.running import ALL, BEFORE, UPTO, ordinal, running


def _change(ts, pending: int, in_flight: int):
    return F.struct(ts.alias("ts_ms"), F.lit(pending).alias("dp"), F.lit(in_flight).alias("df"))


def gauge_changes(lifecycle: DataFrame) -> DataFrame:
    """What each stamp does to the gauges, per task and '(total)': one row per task and stamp."""
    pivot = attempt_pivot(lifecycle)
    queued, started = F.col("queued_ms"), F.col("started_ms")
    end = F.coalesce("ended_ms", "closed_ms")
    changes = F.array(
        _change(F.when(queued.isNotNull(), F.least(queued, started)), 1, 0),
        _change(F.when(queued.isNotNull(), F.coalesce(started, F.when(end.isNotNull(), F.greatest(queued, end)))), -1, 0),
        _change(started, 0, 1),
        _change(F.when(started.isNotNull() & end.isNotNull(), F.greatest(started, end)), 0, -1),
    )
    rows = pivot.select("task", F.inline(changes)).where("ts_ms is not null")
    per_task = rows.groupBy("task", "ts_ms").agg(F.sum("dp").alias("dp"), F.sum("df").alias("df"))
    both = per_task.select(F.explode(F.array("task", F.lit(M.TOTAL))).alias("task"), "ts_ms", "dp", "df")
    return both.groupBy("task", "ts_ms").agg(F.sum("dp").alias("dp"), F.sum("df").alias("df"))


def inflight_series(lifecycle: DataFrame) -> DataFrame:
    """Pending and in flight after each stamp, per task and '(total)'."""
    return running(gauge_changes(lifecycle), ["task"], ["ts_ms"], {
        "pending": ("sum", F.col("dp"), UPTO), "in_flight": ("sum", F.col("df"), UPTO),
    }).select("task", "ts_ms", "pending", "in_flight", (F.col("in_flight") - F.col("df")).alias("in_flight_before"))


def inflight_peak(lifecycle: DataFrame) -> DataFrame:
    """Highest in flight per task and '(total)'."""
    return inflight_series(lifecycle).groupBy("task").agg(F.max("in_flight").alias("peak"))


def inflight_peak_window(lifecycle: DataFrame, window_ms: int) -> DataFrame:
    """Highest in flight per window, and the value shown: this window's or the one before's.

    Windows in which nothing changes give no row; the level carried into a window stands for them.
    """
    series = inflight_series(lifecycle).withColumn("window", F.expr(f"ts_ms div {int(window_ms)}"))
    per = series.groupBy("task", "window").agg(
        F.max(F.greatest("in_flight", "in_flight_before")).alias("peak"),
        F.min_by("in_flight_before", "ts_ms").alias("carried"))
    prior = per.select("task", (F.col("window") + 1).alias("window"), F.col("peak").alias("_prior"))
    return per.join(prior, ["task", "window"], "left").select(
        "task", "window", "peak", F.greatest("peak", F.coalesce("_prior", "carried")).alias("shown"))


def done_rate(lifecycle: DataFrame, window_s: int = 10) -> DataFrame:
    """Completions per second over the last ``window_s`` seconds, sampled every max(1 s, window/32).

    Completions are counted per step before the steps are spread over the windows they are in.
    """
    step = max(1000, window_s * 1000 // 32)
    steps = -(-window_s * 1000 // step)
    cells = lifecycle.where(F.col("kind") == "FINISHED").groupBy(F.expr(f"ts_ms div {step}").alias("cell")).agg(
        F.count("*").alias("n"))
    spread = cells.select(F.explode(F.sequence("cell", F.col("cell") + steps - 1)).alias("step"), "n")
    return spread.groupBy("step").agg(F.sum("n").alias("done")).select(
        ((F.col("step") + 1) * step).alias("sample_ms"), "done",
        F.round(F.col("done") * 1000 / F.lit(steps * step), 6).alias("per_s"))


def _running_spans(lifecycle: DataFrame) -> DataFrame:
    kind = F.col("kind")
    spans = cycled(lifecycle).where(kind.isin("STARTED", "FINISHED", "FAILED", "DEAD_LETTERED", "DROPPED")).groupBy(
        "handle", "cycle", "task", "attempt").agg(
        F.min(F.when(kind == "STARTED", F.col("ts_ms"))).alias("started_ms"),
        F.min(F.when(kind != "STARTED", F.col("ts_ms"))).alias("ended_ms"),
        F.max("mem_bytes").alias("mem_bytes"))
    return spans.where("started_ms is not null")


def occupancy_costs(lifecycle: DataFrame, task_costs: DataFrame) -> DataFrame:
    """What each attempt reserves while it runs: its memory and every named resource."""
    spans = _running_spans(lifecycle)
    memory = spans.select("handle", "attempt", F.lit("memory").alias("resource"), F.col("mem_bytes").alias("amount"))
    named = spans.join(task_costs, "task").select("handle", "attempt", F.col("name").alias("resource"), F.col("cost").alias("amount"))
    return memory.unionByName(named)


def occupancy_series(lifecycle: DataFrame, task_costs: DataFrame, resources: DataFrame) -> DataFrame:
    """Each resource in use after each stamp, with its budget and whether it is exceeded.

    Ends free before starts reserve at one stamp, so the level after the stamp is also its peak.
    Stamps are folded per task before the costs join.
    """
    spans = _running_spans(lifecycle)
    marks = spans.select("task", F.inline(F.array(
        F.struct(F.col("started_ms").alias("ts_ms"), F.lit(1).alias("n"), F.col("mem_bytes").alias("mem")),
        F.struct(F.greatest("started_ms", "ended_ms").alias("ts_ms"), F.lit(-1).alias("n"), (-F.col("mem_bytes")).alias("mem")),
    )), "ended_ms").where((F.col("n") == 1) | F.col("ended_ms").isNotNull())
    folded = marks.groupBy("task", "ts_ms").agg(F.sum("n").alias("n"), F.sum("mem").alias("mem"))
    # A task's costs are as many as there are resources.
    named = task_costs.groupBy("task").agg(F.collect_list(F.struct("name", "cost")).alias("costs"))
    memory = F.struct(F.lit("memory").alias("resource"), F.col("mem").alias("delta"))
    rest = F.transform("costs", lambda c: F.struct(c["name"].alias("resource"), (F.col("n") * c["cost"]).alias("delta")))
    spread = folded.join(named, "task", "left").select(
        "ts_ms", F.inline(F.when(F.col("costs").isNull(), F.array(memory)).otherwise(F.concat(F.array(memory), rest))))
    deltas = spread.groupBy("resource", "ts_ms").agg(F.sum("delta").alias("delta"))
    level = running(deltas, ["resource"], ["ts_ms"], {"in_use": ("sum", F.col("delta"), UPTO)})
    budget = resources.select(F.col("name").alias("resource"), "budget")
    return level.join(budget, "resource", "left").select(
        "resource", "ts_ms", "in_use", "budget", F.coalesce(F.col("in_use") > F.col("budget"), F.lit(False)).alias("over"))


def occupancy_peak(series: DataFrame) -> DataFrame:
    return series.groupBy("resource").agg(F.max("in_use").alias("peak"), F.max("budget").alias("budget"),
                                          F.count_if("over").alias("stamps_over"))


def round_robin(items: DataFrame, shards: int, order: str = "seq") -> DataFrame:
    """The n-th item in submission order goes to shard (n-1) mod N."""
    return ordinal(items, [], [order], "_n").withColumn("shard", ((F.col("_n") - 1) % shards).cast("int")).drop("_n")


def balance_buckets(items: DataFrame, weight: str, buckets: int, order: str = "seq") -> DataFrame:
    """Consecutive items into ``buckets`` of nearly equal weight, by the weight before each item."""
    w = F.col(weight).cast(U64)
    run = running(items, [], [order], {"_before": ("sum", w, BEFORE), "_all": ("sum", w, ALL)})
    return run.withColumn("bucket", F.expr(f"_before * {int(buckets)} div _all").cast("int")).drop("_before", "_all")


def recent_log(lifecycle: DataFrame, problems: int, activities: int, since_ms: int) -> DataFrame:
    """Newest problems and activities merged, newest first, and how many since an instant are not shown.

    At one stamp a problem counts as the newer. ``pos`` 0 rows carry the counts in ``n``.
    """
    rows = lifecycle.select("kind", "handle", "task", "ts_ms", "arrival", event_class().alias("class")).where("class is not null")

    newest = Window.partitionBy("class").orderBy(F.desc("ts_ms"), F.desc("arrival"))  # cut before the shuffle (WindowGroupLimit)
    limit = F.when(F.col("class") == "problem", problems).otherwise(activities)
    top = rows.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= max(problems, activities))
    shown = top.where(F.col("_n") <= limit).drop("_n")
    at_most = Window.partitionBy(F.lit(0)).orderBy(F.desc("ts_ms"), F.desc("class"), F.desc("arrival"))  # problems + activities rows
    listed = shown.withColumn("pos", F.row_number().over(at_most)).withColumn("n", F.lit(1).cast("long"))
    late = F.col("ts_ms") >= since_ms
    there = shown.where(late).groupBy("class").agg(F.count("*").alias("_shown"))
    hidden = rows.where(late).groupBy("class").agg(F.count("*").alias("n")).join(there, "class", "left").select(
        F.lit("(not shown)").alias("kind"), F.lit(None).cast("long").alias("handle"), F.lit(None).cast("string").alias("task"),
        F.lit(since_ms).cast("long").alias("ts_ms"), "class", F.lit(0).alias("pos"), (F.col("n") - F.coalesce("_shown", F.lit(0))).alias("n"))
    return listed.drop("arrival").unionByName(hidden)


def deadline_overrun(lifecycle: DataFrame, policies: DataFrame, items: DataFrame) -> DataFrame:
    """Attempts that ran past their limit and items finished past due, ranked by how far.

    The limit is an item's own timeout_ms where it has one, else its task's timeout_s (0: none).
    Ranks come from counts per distinct overrun, so equal overruns share one.
    """
    pivot = attempt_pivot(lifecycle)
    own = F.col("timeout_ms") if "timeout_ms" in items.columns else F.lit(None).cast("long")
    limits = items.select("handle", "due_ms", own.alias("_own"))
    timed = pivot.withColumn("run_ms", run_ms()).join(policies.select("task", "timeout_s"), "task", "left").join(limits, "handle", "left")
    limit = F.coalesce(F.nullif("_own", F.lit(0)), F.nullif(F.col("timeout_s").cast("long") * 1000, F.lit(0)))
    late = F.when(F.col("finished"), F.col("ended_ms") - F.col("due_ms"))
    rows = timed.select("handle", "task", "attempt", F.inline(F.array(
        F.struct(F.lit("timeout").alias("why"), (F.col("run_ms") - limit).alias("over_ms")),
        F.struct(F.lit("late").alias("why"), late.alias("over_ms")),
    ))).where("over_ms > 0")
    rows = pin(rows, "overruns")
    values = rows.groupBy("why", "over_ms").agg(F.count("*").alias("_n")).withColumn("_down", -F.col("over_ms"))
    ranks = running(values, ["why"], ["_down"], {"_before": ("sum", F.col("_n"), BEFORE)}).select(
        "why", "over_ms", (F.col("_before") + 1).alias("rank"))
    return rows.join(ranks, ["why", "over_ms"])
