"""Aggregations over the life-cycle log: counters, gauges, latencies, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workfold import model as M
from workfold.functions.exprs import U64, bucket_upper, code_of, log2_bucket, measure, name_of, point, shard_of, terminal, why
from workfold.plans.attempts import (
    ENDING, QUEUING, attempt_pivot, cycled, pivot_once, queuing, reached, run_ms, state_of_handle, state_once, unless_requeued, wait_ms, with_cycle)
from workfold.plans.pin import pin
from workfold.plans.running import ALL, UPTO, ordinal, running
from workfold.plans.totals import per_task_and_total

COUNTED = {
    "queued": "QUEUED", "started": "STARTED", "finished": "FINISHED", "failed": "FAILED",
    "retried": "RETRIED", "dead_lettered": "DEAD_LETTERED", "dropped": "DROPPED",
}


def _again() -> tuple:
    """Counts items with more than one first start."""
    return F.count_if(F.col("opened") > 1), "sum"


def _counter_aggs(when=None):
    live = F.lit(True) if when is None else when
    aggs = {name: (F.count_if(live & (F.col("kind") == kind)), "sum") for name, kind in COUNTED.items()}
    aggs["cancelled"] = (F.count_if(live & (F.col("kind") == "FAILED") & (F.col("status") == "CANCELLED")), "sum")
    aggs["terminal"] = (F.count_if(live & terminal()), "sum")
    return aggs


def counters(lifecycle: DataFrame) -> DataFrame:
    """Events by kind, per task and '(total)'."""
    return per_task_and_total(lifecycle, _counter_aggs())


def _gauges() -> dict:
    return {"pending": (F.count_if(F.col("state") == "pending"), "sum"), "in_flight": (F.count_if(F.col("state") == "in_flight"), "sum")}


def gauge_totals(lifecycle: DataFrame, keys: list[str]) -> DataFrame:
    """The gauges of a log taken as free of requeues, and how many items were (``_again``)."""
    return per_task_and_total(state_once(lifecycle, keys), {**_gauges(), "_again": _again()})


def gauges(lifecycle: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Items pending and in flight at the end of the log, per task and '(total)'."""
    keys = keys or ["handle"]

    def ordered() -> DataFrame:
        return per_task_and_total(state_of_handle(lifecycle, keys), _gauges())

    return ordered() if "cycle" in lifecycle.columns else unless_requeued(gauge_totals(lifecycle, keys), ordered)


def _latency(name: str, sample, live=None):
    value = sample if live is None else F.when(live, sample)
    return {
        f"{name}_samples": (F.count(value), "sum"),
        # a DECIMAL: milliseconds of enough attempts do not fit a LONG
        f"{name}_ms_sum": (F.coalesce(F.sum(value.cast("decimal(20,0)")), F.lit(0)).cast(U64), "sum"),
        f"{name}_ms_max": (F.coalesce(F.max(value), F.lit(0)).cast("long"), "max"),
    }


def wait_totals(lifecycle: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The waits of a log taken as free of requeues, and how many items were (``_again``)."""
    return per_task_and_total(pivot_once(lifecycle, keys), {**_latency("wait", wait_ms(queuing())), "_again": _again()})


def wait_latency(lifecycle: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Queued or retried until started."""
    def ordered() -> DataFrame:
        return per_task_and_total(attempt_pivot(lifecycle, keys), _latency("wait", wait_ms(queuing())))

    return ordered() if "cycle" in lifecycle.columns else unless_requeued(wait_totals(lifecycle, keys), ordered)


def cycle_waits(cycled: DataFrame, carry: bool = True) -> DataFrame:
    """Wait per attempt of a log with requeues (after ``with_cycle``).

    A requeue announces nothing, so the start that opens a later cycle has no queuing event of
    its own: its wait then runs from the handle's latest one, earlier runs included, or is NULL
    with ``carry=False``.
    """
    base = F.when(F.col("kind") == "STARTED", F.col("base_ms"))
    pivot = cycled.groupBy("handle", "task", "cycle", F.greatest("attempt", F.lit(1)).alias("attempt")).agg(
        F.min(F.when(F.col("kind").isin("QUEUED", "RETRIED"), F.col("ts_ms"))).alias("queued_ms"),
        F.min(F.when(F.col("kind") == "STARTED", F.col("ts_ms"))).alias("started_ms"),
        F.min(base).alias("base_ms"),
    )
    start = F.coalesce("queued_ms", "base_ms") if carry else F.col("queued_ms")
    return pivot.where(F.col("started_ms").isNotNull()).select(
        "handle", "task", "cycle", "attempt",
        F.greatest(F.lit(0).cast("long"), F.col("started_ms") - start).alias("wait_ms") if carry
        else F.when(start.isNotNull(), F.greatest(F.lit(0).cast("long"), F.col("started_ms") - start)).alias("wait_ms"),
    )


def attempt_waits(lifecycle: DataFrame, carry: bool = True) -> DataFrame:
    """Wait per attempt (``cycle_waits``) of a log whose cycles are not numbered yet.

    Only starts and what queues them decide a wait, so only those are ordered, without their payload.
    """
    waiting = lifecycle.where(F.col("kind").isin("STARTED", *QUEUING)).select("handle", "task", "kind", "ts_ms", "attempt", "arrival")
    return cycle_waits(with_cycle(waiting), carry)


def run_latency(lifecycle: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Started until finished or failed, per attempt."""
    return per_task_and_total(attempt_pivot(lifecycle, keys), _latency("run", run_ms()))


def finish_times(lifecycle: DataFrame) -> DataFrame:
    """One row per finished item: ``finish_ms`` from queued to finished, never below 0."""
    kind = F.col("kind")
    per = lifecycle.where(kind.isin("QUEUED", "FINISHED")).groupBy("handle", "task").agg(
        F.max(F.when(kind == "QUEUED", F.col("ts_ms"))).alias("queued_ms"),
        F.min(F.when(kind == "FINISHED", F.col("ts_ms"))).alias("finished_ms"),
    )
    return per.where("queued_ms is not null and finished_ms is not null").select(
        "handle", "task", F.greatest(F.lit(0).cast("long"), F.col("finished_ms") - F.col("queued_ms")).alias("finish_ms")
    )


def finish_latency(lifecycle: DataFrame) -> DataFrame:
    out = per_task_and_total(finish_times(lifecycle), _latency("finish", F.col("finish_ms")))
    return out.withColumn("finish_ms_avg", F.round(F.col("finish_ms_sum").cast("double") / F.col("finish_samples"), 6))


def latency_histogram(lifecycle: DataFrame) -> DataFrame:
    """Finished items per task and log2 bucket of their latency."""
    return finish_times(lifecycle).groupBy("task", log2_bucket("finish_ms").alias("bucket")).agg(F.count("*").alias("n"))


def histogram_percentile(lifecycle: DataFrame, percents=(50, 95, 99)) -> DataFrame:
    """The bucket each percentile falls in, from at most 32 rows per task."""
    by_task = Window.partitionBy("task")
    hist = latency_histogram(lifecycle).select(
        "task", "bucket",
        F.sum("n").over(by_task).alias("total"),
        F.sum("n").over(by_task.orderBy("bucket")).alias("upto"),
    )
    ranked = hist.withColumn("pct", F.explode(F.array(*[F.lit(p) for p in percents])))
    rank = F.greatest(F.lit(1).cast("long"), F.expr("(total * pct + 99) div 100"))
    hit = ranked.where(F.col("upto") >= rank).groupBy("task", "pct").agg(F.min("bucket").alias("bucket"))
    return hit.withColumn("below_ms", bucket_upper("bucket"))


def exact_percentile(lifecycle: DataFrame, percents=(50, 95, 99)) -> DataFrame:
    """The latency at each percentile's rank, exactly.

    Counted per value first, so what is ordered is distinct values, in cells (``plans.running``):
    no task holds all the samples of one work type.
    """
    counted = finish_times(lifecycle).groupBy("task", "finish_ms").agg(F.count("*").alias("n"))
    run = running(counted, ["task"], ["finish_ms"], {
        "upto": ("sum", F.col("n"), UPTO), "total": ("sum", F.col("n"), ALL),
    })
    ranked = run.withColumn("pct", F.explode(F.array(*[F.lit(p) for p in percents])))
    rank = F.greatest(F.lit(1).cast("long"), F.expr("(total * pct + 99) div 100"))
    return ranked.where(F.col("upto") >= rank).groupBy("task", "pct").agg(F.min("finish_ms").alias("finish_ms"))


def approx_percentile(lifecycle: DataFrame, percents=(50, 95, 99), accuracy: int = 10000) -> DataFrame:
    """The same by a mergeable sketch: one pass, bounded memory, rank error 1/accuracy."""
    shares = F.array(*[F.lit(p / 100) for p in percents])
    sketch = finish_times(lifecycle).groupBy("task").agg(
        F.percentile_approx("finish_ms", shares, accuracy).alias("v"))
    return sketch.select("task", F.posexplode("v").alias("i", "finish_ms")).select(
        "task", F.element_at(F.array(*[F.lit(p) for p in percents]), F.col("i") + 1).alias("pct"), "finish_ms")


def quantile_snapshot(values: DataFrame, by: list[str], value: str, k: int = 400) -> DataFrame:
    """One KLL sketch of ``value`` per group: a few kilobytes, however many rows, that ``merge_quantiles`` can fold.

    ``k`` sets the size; the rank error of any quantile, merged or not, stays under 2.5 / k at 99 % confidence
    (0.7 % of the rows for 400).
    """
    return values.groupBy(*by).agg(F.kll_sketch_agg_bigint(F.col(value).cast("long"), F.lit(k)).alias("sketch"), F.count(value).alias("n"))


def merge_quantiles(snapshots: DataFrame, by: list[str], k: int = 400) -> DataFrame:
    """Fold sketches of several shards or micro-batches into one a group, without going back to the rows."""
    return snapshots.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"))


def quantiles(snapshots: DataFrame, percents=(50, 95, 99)) -> DataFrame:
    """The value at each percentile's rank, read off the sketches; their other columns stay."""
    found = [F.struct(F.lit(p).alias("pct"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(p / 100)).alias("value")) for p in percents]
    return snapshots.where("n > 0").select("*", F.inline(F.array(*found))).drop("sketch")


def snapshot(lifecycle: DataFrame, by: list[str]) -> DataFrame:
    """Counters and latencies per group, in columns that ``merge_counters`` can fold."""
    keys = [*by, "handle"] if "shard" in by else ["handle"]
    pivot = attempt_pivot(lifecycle, [k for k in keys if k != "task"])
    counted = lifecycle.groupBy(*by).agg(*[agg.alias(name) for name, (agg, _) in _counter_aggs().items()])
    timed = pivot.groupBy(*by).agg(
        *[agg.alias(name) for part in (("wait", wait_ms(queuing())), ("run", run_ms()))
          for name, (agg, _) in _latency(*part).items()])
    return counted.join(timed, by)


SNAPSHOT_MAXIMA = ["wait_ms_max", "run_ms_max"]


def merge_counters(snapshots: DataFrame, by: str = "task") -> DataFrame:
    """Fold snapshots of several shards: sums add, maxima take the larger."""
    folded = [c for c in snapshots.columns if c not in (by, "shard")]
    return snapshots.groupBy(by).agg(
        *[(F.max if c in SNAPSHOT_MAXIMA else F.sum)(c).alias(c) for c in folded])


def statistics(lifecycle: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Counters, gauges and latencies per task and '(total)', from one scan of the log.

    With ``since_ms`` counters and latencies start at that instant; the gauges stay live.
    """
    since = F.lit(True) if since_ms is None else F.col("ts_ms") >= since_ms
    kind, counts = F.col("kind"), _counter_aggs(since)
    lifecycle = cycled(lifecycle)
    base = F.col("base_ms") if "base_ms" in lifecycle.columns else F.lit(None).cast("long")
    per_attempt = lifecycle.groupBy("handle", "cycle", "task", F.greatest("attempt", F.lit(1)).alias("attempt")).agg(
        F.min(F.when(kind == "STARTED", base)).alias("base_ms"),
        *[agg.alias(name) for name, (agg, _) in counts.items()],
        F.min(F.when(kind.isin(*QUEUING), F.col("ts_ms"))).alias("queued_ms"),
        F.min(F.when(kind == "STARTED", F.col("ts_ms"))).alias("started_ms"),
        F.min(F.when(kind.isin(*ENDING), F.col("ts_ms"))).alias("ended_ms"),
        F.max(reached(lifecycle)).alias("reached"), F.max(terminal()).alias("over"))
    from_then = F.lit(True) if since_ms is None else F.greatest(F.col("started_ms"), queuing()) >= since_ms
    ended_then = F.lit(True) if since_ms is None else F.col("ended_ms") >= since_ms
    times = {**_latency("wait", wait_ms(queuing()), from_then), **_latency("run", run_ms(), ended_then)}
    per_item = per_attempt.groupBy("handle", "task").agg(
        *[F.sum(name).alias(name) for name in counts], *[agg.alias(name) for name, (agg, _) in times.items()],
        F.max("reached").alias("reached"), F.max("over").alias("over"))
    live, at = ~F.col("over"), F.col("reached") % 4
    return per_task_and_total(per_item, {
        **{name: (F.sum(name), "sum") for name in counts},
        **{name: ((F.max if how == "max" else F.sum)(name), how) for name, (_, how) in times.items()},
        "pending": (F.count_if(live & (at == 0)), "sum"), "in_flight": (F.count_if(live & (at == 1)), "sum")})


def stats_since(lifecycle: DataFrame, since_ms: int) -> DataFrame:
    """Counters and latencies of what happened from an instant on; the gauges stay live."""
    return statistics(lifecycle, since_ms)


def task_table(lifecycle: DataFrame) -> DataFrame:
    """One report row per task: outcomes, success share, latency and memory peak."""
    rows = lifecycle.groupBy("task").agg(
        *[F.count_if(F.col("kind") == k).alias(n) for n, k in COUNTED.items() if n not in ("queued", "retried")],
        F.max(measure("mem.peak")).cast("long").alias("mem_peak"),
    )
    timed = finish_times(lifecycle).groupBy("task").agg(
        F.expr("sum(cast(finish_ms as decimal(20,0))) div count(*)").alias("avg_ms"), F.max("finish_ms").alias("max_ms"))
    closed = F.col("finished") + F.col("dead_lettered") + F.col("dropped")
    return rows.join(timed, "task", "left").withColumn(
        "ok_pct", F.when(closed > 0, F.expr("100 * finished div (finished + dead_lettered + dropped)")))


def fold_other(lifecycle: DataFrame, rows: int | None = None) -> DataFrame:
    """Task types beyond the first ``rows`` seen fold into '(other)'; without a number none does."""
    per = lifecycle.groupBy("task").agg(
        F.min("arrival").alias("seen"),
        *[F.count_if(F.col("kind") == k).alias(n) for n, k in COUNTED.items()])
    if rows is None:
        return per.select("task", *COUNTED, F.lit(0).cast("long").alias("folded_types"))
    ranked = ordinal(per, [], ["seen", "task"], "rank")
    name = F.when(F.col("rank") <= rows, F.col("task")).otherwise(M.OTHER)
    return ranked.groupBy(name.alias("task")).agg(
        *[F.sum(n).alias(n) for n in COUNTED],
        F.count_if(F.col("rank") > rows).alias("folded_types"))


def dead_letter_counts(lifecycle: DataFrame, cap: int | None = None) -> DataFrame:
    """Dead letters kept per task when only the newest ``cap`` (0: none; None: all) are retained."""
    dead = lifecycle.where(F.col("kind") == "DEAD_LETTERED").select(
        "task", "handle", (-F.col("ts_ms")).alias("_new"), (-F.col("arrival")).alias("_late"))
    if cap is None:
        return dead.groupBy("task").agg(F.count("*").alias("retained"), F.lit(0).cast("long").alias("evicted"))
    ranked = ordinal(dead, [], ["_new", "_late"], "rank")
    kept = F.col("rank") <= cap
    return ranked.groupBy("task").agg(F.count_if(kept).alias("retained"), F.count_if(~kept).alias("evicted"))


def cpu_cores_used(lifecycle: DataFrame) -> DataFrame:
    """Average cores an attempt kept busy, per task, and the share of run time it was held back."""
    kind = F.col("kind")
    cpu = F.when(kind.isin("FINISHED", "FAILED") & (measure("cpu.user_ms").isNotNull() | measure("cpu.sys_ms").isNotNull()),
                 F.coalesce(measure("cpu.user_ms"), F.lit(0)) + F.coalesce(measure("cpu.sys_ms"), F.lit(0)))
    per = cycled(lifecycle).where(kind.isin("STARTED", "FINISHED", "FAILED")).groupBy(
        "handle", "cycle", "task", "attempt").agg(
        F.min(F.when(kind == "STARTED", F.col("ts_ms"))).alias("started_ms"),
        F.min(F.when(kind != "STARTED", F.col("ts_ms"))).alias("ended_ms"),
        F.max(cpu).cast("long").alias("cpu_ms"),
        F.max(measure("cpu.throttled_ms")).cast("long").alias("throttled_ms"),
    ).withColumn("run_ms", run_ms())
    timed = per.where((F.col("run_ms") > 0) & F.col("cpu_ms").isNotNull())
    return timed.groupBy("task").agg(
        F.count("*").alias("attempts"),
        F.round(F.avg(F.col("cpu_ms") / F.col("run_ms")), 6).alias("cores_mean"),
        F.count("throttled_ms").alias("capped"),
        F.round(F.sum(F.col("throttled_ms").cast("double"))
                / F.sum(F.when(F.col("throttled_ms").isNotNull(), F.col("run_ms")).cast("double")), 6)
        .alias("throttled_share"))


def declared_vs_used(lifecycle: DataFrame) -> DataFrame:
    """Per task: memory declared, memory measured, what is left over, and whether methods differ."""
    ended = lifecycle.where(F.col("kind").isin("FINISHED", "FAILED"))
    peaks = ended.select("task", "mem_bytes", F.inline(F.filter("measures", lambda m: m["name"] == "mem.peak")))
    return peaks.groupBy("task").agg(
        F.max("mem_bytes").alias("declared"), F.max("value").cast("long").alias("used"),
        (F.count_distinct("method") > 1).alias("methods_mixed"),
    ).withColumn("headroom", F.col("declared") - F.col("used"))


def run_report(lifecycle: DataFrame, by: str = "handle", refused: DataFrame | None = None) -> DataFrame:
    """One row per job: first start, end, tries, peak and what became of it.

    ``refused`` holds (``by``, status) of jobs that were never accepted.
    """
    kind = F.col("kind")
    over = kind.isin("FINISHED", "DEAD_LETTERED", "DROPPED")
    statuses = list(M.STATUS_TEXT)
    verdict = F.when(over, code_of("status", statuses) * 2 + (kind == "FINISHED").cast("long"))
    jobs = lifecycle.groupBy(by).agg(
        F.min(F.when(kind == "STARTED", F.col("ts_ms"))).alias("start_ms"),
        F.max(F.when(over, F.col("ts_ms"))).alias("end_ms"),
        F.coalesce(F.max(F.when(kind == "STARTED", F.col("attempt"))), F.lit(0)).alias("tries"),
        F.max(measure("mem.peak")).cast("long").alias("peak"),
        F.max_by(verdict, F.when(over, point())).alias("last"),
    )
    finished = F.col("last") % 2 == 1
    status = F.coalesce(name_of(F.floor(F.col("last") / 2), statuses), F.lit("?"))
    text = (F.when(finished & (F.col("tries") > 1), "finished after a retry").when(finished, "finished")
            .when(F.col("last").isNotNull(), F.concat(F.lit("dead letter: "), status)))
    if refused is not None:
        jobs = jobs.join(refused.select(by, F.col("status").alias("_refused")), by, "full")
        text = F.when(F.col("_refused").isNotNull(), F.concat(F.lit("refused: "), F.col("_refused"))).otherwise(text)
    return jobs.select(by, "start_ms", "end_ms", F.coalesce("tries", F.lit(0)).alias("tries"), "peak",
                       F.coalesce(text, F.lit("open")).alias("result"))


def service_report(lifecycle: DataFrame, retire_on_ok: bool = False) -> DataFrame:
    """Per supervised handle: runs, clean exits, crashes, restarts, up time and the final stop.

    With ``retire_on_ok`` the service is over at its first FINISHED.
    """
    kind = F.col("kind")
    cut = lifecycle
    if retire_on_ok:
        done = lifecycle.where(kind == "FINISHED").groupBy("handle").agg(F.min("ts_ms").alias("_done"))
        cut = lifecycle.join(done, "handle", "left").where(F.col("_done").isNull() | (F.col("ts_ms") <= F.col("_done")))
    ended = kind.isin("FINISHED", "FAILED")
    crash = (kind == "FAILED") & (F.col("status") != "CANCELLED")
    stamp = F.col("ts_ms").cast("decimal(20,0)")
    per = cut.groupBy("handle", "task").agg(
        F.count_if(kind == "STARTED").alias("runs"), F.count_if(kind == "FINISHED").alias("clean_exits"),
        F.count_if(crash).alias("crashes"),
        F.coalesce(F.sum(F.when(ended, stamp).when(kind == "STARTED", -stamp)), F.lit(0)).alias("_up"),
        F.count_if(ended).alias("_ends"),
        F.max(F.when(kind == "STARTED", F.col("ts_ms"))).alias("_last_start"),
        F.max(F.when(terminal(), F.col("ts_ms"))).alias("stopped_ms"),
    )
    running_now = F.col("runs") > F.col("_ends")  # its open run has no up time yet
    return per.select(
        "handle", "task", "runs", "clean_exits", "crashes",
        F.greatest(F.lit(0).cast("long"), F.col("runs") - 1).alias("restarts"),
        (F.col("_up") + F.when(running_now, F.col("_last_start")).otherwise(F.lit(0))).cast("long").alias("up_ms"), "stopped_ms")


def failure_reasons(lifecycle: DataFrame, k: int = 3, tail_chars: int | None = None) -> DataFrame:
    """The ``k`` most frequent failure reasons of each task; ``tail_chars`` of an error tail are read (None: all)."""
    reason = why(measure("start.error"), measure("exit.code"), measure("exit.signal"), "status", "stderr_tail", tail_chars)
    failed = lifecycle.where(F.col("kind") == "FAILED").select("task", "handle", "ts_ms", reason.alias("reason"))
    # Per handle first: the distinct count then adds up without gathering handles.
    per_handle = failed.groupBy("task", "reason", "handle").agg(
        F.count("*").alias("attempts"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    per = per_handle.groupBy("task", "reason").agg(
        F.sum("attempts").alias("attempts"), F.count("*").alias("handles"),
        F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
    top = Window.partitionBy("task").orderBy(F.desc("attempts"), "reason")
    return per.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)


def exit_codes(lifecycle: DataFrame) -> DataFrame:
    """Attempts by task, kind of code and code, with subtotals (NULL)."""
    ended = lifecycle.where(F.col("kind").isin("FINISHED", "FAILED"))
    codes = ended.select("task", F.inline(F.filter(
        "measures", lambda m: m["name"].isin("exit.code", "exit.signal", "start.error"))))
    per = codes.groupBy("task", F.col("name").alias("code_kind"), F.col("value").cast("long").alias("code")).agg(
        F.count("*").alias("attempts"))
    return per.rollup("task", "code_kind", "code").agg(F.sum("attempts").alias("attempts"))


def shard_load(items: DataFrame, weight: str, shards: int, key: str = "tenant", order: str = "seq") -> DataFrame:
    """Work per shard under round-robin and under keyed routing, against an even split."""
    placed = ordinal(items, [], [order], "_n").select(
        F.col(weight).cast("decimal(20,0)").alias("w"),
        F.explode(F.array(
            F.struct(F.lit("round_robin").alias("policy"), ((F.col("_n") - 1) % shards).cast("int").alias("shard")),
            F.struct(F.lit("keyed").alias("policy"), shard_of(key, shards).alias("shard")),
        )).alias("to"))
    load = placed.groupBy("to.policy", "to.shard").agg(F.count("*").alias("items"), F.sum("w").cast(U64).alias("work"))
    work = F.col("work").cast("double")
    every = Window.partitionBy("policy")  # at most `shards` rows per policy
    return load.select(
        "policy", "shard", "items", "work",
        F.expr(f"sum(work) over (partition by policy) div {shards}").alias("ideal"),
        F.round(F.max(work).over(every) * shards / F.sum(work).over(every), 6).alias("factor"))
