"""Queries: counters, gauges, latencies and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from workfold.catalog.registry import longs, query
from workfold.catalog.rules import OVER, REASON
from workfold.operators import aggregates as A
from workfold.operators import validation as V
from workfold.session import fresh_path

TERMINAL = "(kind IN ('FINISHED','DROPPED','DEAD_LETTERED') OR (kind = 'FAILED' AND status = 'CANCELLED'))"
COUNTS = ", ".join(f"count(*) FILTER (kind = '{k}') AS {n}" for n, k in A.COUNTED.items())
COUNTS_ALL = (COUNTS + ", count(*) FILTER (kind = 'FAILED' AND status = 'CANCELLED') AS cancelled, "
              f"count(*) FILTER ({TERMINAL}) AS terminal")
TASK = "CASE WHEN grouping(task) = 1 THEN '(total)' ELSE task END AS task"
ROLL = "GROUP BY GROUPING SETS ((task), ())"
WAIT = "CASE WHEN started_ms IS NOT NULL AND queued_ms IS NOT NULL THEN greatest(0, started_ms - queued_ms) END"
REQUEUED_WAIT = WAIT.replace("queued_ms", "coalesce(queued_ms, base_ms)")
RUN = "CASE WHEN ended_ms >= started_ms THEN ended_ms - started_ms END"


def latency(name: str, x: str) -> str:
    return (f"count({x}) AS {name}_samples, CAST(coalesce(sum({x}), 0) AS BIGINT) AS {name}_ms_sum, "
            f"coalesce(max({x}), 0) AS {name}_ms_max")


FINISH = """SELECT handle, task, greatest(0, min(ts_ms) FILTER (kind = 'FINISHED') - max(ts_ms) FILTER (kind = 'QUEUED')) AS finish_ms
 FROM fx_lifecycle GROUP BY ALL HAVING min(ts_ms) FILTER (kind = 'FINISHED') IS NOT NULL AND max(ts_ms) FILTER (kind = 'QUEUED') IS NOT NULL"""
BUCKET = "CAST(CASE WHEN finish_ms <= 0 THEN 0 ELSE least(31, length(bin(finish_ms))) END AS INT)"


def both_logs(fx, operator):
    """An operator over the log where items are retried, and the one where some start over."""
    return operator(fx.lifecycle).withColumn("log", F.lit("retried")).unionByName(operator(fx.requeued).withColumn("log", F.lit("requeued")))


@query("counters", f"SELECT {TASK}, {COUNTS_ALL} FROM fx_lifecycle {ROLL}", ["fx_lifecycle"])
def _(fx):
    return A.counters(fx.lifecycle)


@query("gauges", f"""
SELECT 'retried' AS log, * FROM (WITH h AS (SELECT handle, task, max(CASE WHEN {TERMINAL} THEN 1 ELSE 0 END) AS closed,
  max(greatest(attempt, 1) * 4 + CASE WHEN kind IN ('QUEUED','RETRIED') THEN 0 WHEN kind = 'STARTED' THEN 1 ELSE 2 END) % 4 AS phase
  FROM fx_lifecycle GROUP BY ALL)
SELECT {TASK}, count(*) FILTER (closed = 0 AND phase = 0) AS pending, count(*) FILTER (closed = 0 AND phase = 1) AS in_flight
FROM h {ROLL})
UNION ALL SELECT 'requeued', {TASK}, count(*) FILTER (state = 'pending'), count(*) FILTER (state = 'in_flight') FROM fx_requeued_state {ROLL}""", ["fx_lifecycle", "fx_requeued_state"])
def _(fx):
    return both_logs(fx, A.gauges)


@query("wait_latency", f"""SELECT 'retried' AS log, {TASK}, {latency('wait', WAIT)} FROM fx_pivot {ROLL}
UNION ALL SELECT 'requeued', {TASK}, {latency('wait', REQUEUED_WAIT)} FROM fx_requeued_pivot {ROLL}""", ["fx_pivot", "fx_requeued_pivot"])
def _(fx):
    return longs(both_logs(fx, A.wait_latency), "wait_ms_sum")


@query("run_latency", f"SELECT {TASK}, {latency('run', RUN)} FROM fx_pivot {ROLL}", ["fx_pivot"])
def _(fx):
    return longs(A.run_latency(fx.lifecycle), "run_ms_sum")


@query("finish_latency", f"""
WITH f AS ({FINISH}) SELECT {TASK}, {latency('finish', 'finish_ms')}, round(sum(finish_ms) / count(*), 6) AS finish_ms_avg
FROM f {ROLL}""", ["fx_lifecycle"])
def _(fx):
    return longs(A.finish_latency(fx.lifecycle), "finish_ms_sum")


@query("latency_histogram", f"""
WITH f AS ({FINISH}) SELECT task, {BUCKET} AS bucket, count(*) AS n FROM f GROUP BY ALL""", ["fx_lifecycle"])
def _(fx):
    return A.latency_histogram(fx.lifecycle)


@query("fn_log2_bucket", f"""
WITH f AS ({FINISH}) SELECT handle, finish_ms, {BUCKET} AS bucket,
  CASE WHEN {BUCKET} = 0 THEN CAST(0 AS BIGINT) WHEN {BUCKET} < 31 THEN CAST(2 AS BIGINT) ** {BUCKET} END::BIGINT AS below_ms FROM f""", ["fx_lifecycle"])
def _(fx):
    from workfold.functions.exprs import bucket_upper, log2_bucket

    return A.finish_times(fx.lifecycle).select("handle", "finish_ms", log2_bucket("finish_ms").alias("bucket")).withColumn(
        "below_ms", bucket_upper("bucket"))


@query("histogram_percentile", f"""
WITH f AS ({FINISH}), h AS (SELECT task, {BUCKET} AS bucket, count(*) AS n FROM f GROUP BY ALL),
c AS (SELECT task, bucket, CAST(sum(n) OVER (PARTITION BY task ORDER BY bucket) AS BIGINT) AS upto,
      CAST(sum(n) OVER (PARTITION BY task) AS BIGINT) AS total FROM h)
SELECT task, pct, min(bucket) AS bucket, CASE WHEN min(bucket) = 0 THEN 0 WHEN min(bucket) < 31 THEN CAST(2 AS BIGINT) ** min(bucket) END::BIGINT AS below_ms
FROM c, (VALUES (50), (95), (99)) p(pct) WHERE upto >= greatest(1, (total * pct + 99) // 100) GROUP BY task, pct""", ["fx_lifecycle"])
def _(fx):
    return A.histogram_percentile(fx.lifecycle)


@query("exact_percentile", f"""
WITH f AS ({FINISH}), r AS (SELECT task, finish_ms, row_number() OVER (PARTITION BY task ORDER BY finish_ms) AS rn,
  count(*) OVER (PARTITION BY task) AS total FROM f)
SELECT task, pct, finish_ms FROM r, (VALUES (50), (95), (99)) p(pct) WHERE rn = greatest(1, (total * pct + 99) // 100)""", ["fx_lifecycle"])
def _(fx):
    return A.exact_percentile(fx.lifecycle)


# A sketch's value may differ; its rank may not be off by more than the accuracy allows.
@query("approx_percentile", f"""
WITH f AS ({FINISH}) SELECT task, pct, TRUE AS near FROM (SELECT DISTINCT task FROM f), (VALUES (50), (95), (99)) p(pct)""", ["fx_lifecycle"])
def _(fx):
    found = A.approx_percentile(fx.lifecycle).withColumnRenamed("finish_ms", "value")
    ranked = A.finish_times(fx.lifecycle).join(found, "task").groupBy("task", "pct").agg(
        F.count_if(F.col("finish_ms") < F.col("value")).alias("below"), F.count_if(F.col("finish_ms") <= F.col("value")).alias("upto"), F.count("*").alias("n"))
    rank, slack = F.ceil(F.col("n") * F.col("pct") / 100), F.ceil(F.col("n") / 10000) + 1
    return ranked.select("task", "pct", ((F.col("below") <= rank + slack) & (F.col("upto") >= rank - slack)).alias("near"))


# Four shards are sketched alone, kept as a snapshot, read back and merged: a value's rank is off by under 0.7 %.
@query("merged_percentile", f"""
WITH f AS ({FINISH}) SELECT task, pct, n, TRUE AS near FROM (SELECT task, count(*) AS n FROM f GROUP BY task), (VALUES (50), (95), (99)) p(pct)""", ["fx_lifecycle"])
def _(fx):
    times = A.finish_times(fx.lifecycle)
    path = fresh_path(fx.spark, "quantiles")
    for shard in range(4):
        A.quantile_snapshot(times.where(F.col("handle") % 4 == shard), ["task"], "finish_ms").write.mode("append").parquet(path)
    found = A.quantiles(A.merge_quantiles(fx.spark.read.parquet(path), ["task"]))
    ranked = times.join(found, "task").groupBy("task", "pct", "n").agg(
        F.count_if(F.col("finish_ms") < F.col("value")).alias("below"), F.count_if(F.col("finish_ms") <= F.col("value")).alias("upto"))
    rank, slack = F.ceil(F.col("n") * F.col("pct") / 100), F.ceil(F.col("n") * 0.007) + 1
    return ranked.select("task", "pct", "n", ((F.col("below") <= rank + slack) & (F.col("upto") >= rank - slack)).alias("near"))


SNAP = f"""SELECT task, {COUNTS_ALL} FROM fx_lifecycle GROUP BY task"""
SNAP_T = f"SELECT task, {latency('wait', WAIT)}, {latency('run', RUN)} FROM fx_pivot GROUP BY task"


@query("merge_counters", f"WITH a AS ({SNAP}), b AS ({SNAP_T}) SELECT * FROM a JOIN b USING (task)", ["fx_lifecycle", "fx_pivot"])
def _(fx):
    shards = fx.lifecycle.withColumn("shard", F.col("handle") % 4)
    return longs(A.merge_counters(A.snapshot(shards, ["shard", "task"])), "wait_ms_sum", "run_ms_sum")


SINCE = 126230400000  # 1999-01-01 in the fixtures' clock (ms since 1995-01-01)


@query("stats_since", f"""
WITH a AS (SELECT {TASK}, {", ".join(f"count(*) FILTER (kind = '{k}' AND ts_ms >= {SINCE}) AS {n}" for n, k in A.COUNTED.items())},
  count(*) FILTER (kind = 'FAILED' AND status = 'CANCELLED' AND ts_ms >= {SINCE}) AS cancelled,
  count(*) FILTER ({TERMINAL} AND ts_ms >= {SINCE}) AS terminal FROM fx_lifecycle {ROLL}),
b AS (SELECT {TASK}, {latency('wait', f"CASE WHEN greatest(started_ms, queued_ms) >= {SINCE} THEN {WAIT} END")},
  {latency('run', f"CASE WHEN ended_ms >= {SINCE} THEN {RUN} END")} FROM fx_pivot {ROLL}),
h AS (SELECT handle, task, max(CASE WHEN {TERMINAL} THEN 1 ELSE 0 END) AS closed,
  max(greatest(attempt, 1) * 4 + CASE WHEN kind IN ('QUEUED','RETRIED') THEN 0 WHEN kind = 'STARTED' THEN 1 ELSE 2 END) % 4 AS phase
  FROM fx_lifecycle GROUP BY ALL),
g AS (SELECT {TASK}, count(*) FILTER (closed = 0 AND phase = 0) AS pending, count(*) FILTER (closed = 0 AND phase = 1) AS in_flight FROM h {ROLL})
SELECT * FROM a JOIN b USING (task) JOIN g USING (task)""", ["fx_lifecycle", "fx_pivot"])
def _(fx):
    return longs(A.stats_since(fx.lifecycle, SINCE), "wait_ms_sum", "run_ms_sum")


@query("task_table", f"""
WITH f AS ({FINISH}), t AS (SELECT task, CAST(sum(finish_ms) // count(*) AS BIGINT) AS avg_ms, max(finish_ms) AS max_ms FROM f GROUP BY task),
p AS (SELECT task, max(value) AS mem_peak FROM fx_measures WHERE name = 'mem.peak' GROUP BY task),
c AS (SELECT task, {", ".join(f"count(*) FILTER (kind = '{k}') AS {n}" for n, k in A.COUNTED.items() if n not in ("queued", "retried"))}
  FROM fx_lifecycle GROUP BY task)
SELECT *, 100 * finished // nullif(finished + dead_lettered + dropped, 0) AS ok_pct FROM c LEFT JOIN t USING (task) LEFT JOIN p USING (task)""",
       ["fx_lifecycle", "fx_measures"])
def _(fx):
    return A.task_table(fx.lifecycle)


@query("fold_other", f"""
WITH c AS (SELECT task, min(arrival) AS seen, {COUNTS} FROM fx_lifecycle GROUP BY task),
r AS (SELECT *, row_number() OVER (ORDER BY seen) AS rank FROM c)
SELECT CASE WHEN rank <= 3 THEN task ELSE '(other)' END AS task, {", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in A.COUNTED)},
  count(*) FILTER (rank > 3) AS folded_types FROM r GROUP BY 1""", ["fx_lifecycle"])
def _(fx):
    return A.fold_other(fx.lifecycle, rows=3)


@query("dead_letter_counts", """
WITH r AS (SELECT task, row_number() OVER (ORDER BY ts_ms DESC, arrival DESC) AS rank FROM fx_lifecycle WHERE kind = 'DEAD_LETTERED')
SELECT task, count(*) FILTER (rank <= 1024) AS retained, count(*) FILTER (rank > 1024) AS evicted FROM r GROUP BY task""", ["fx_lifecycle"])
def _(fx):
    return A.dead_letter_counts(fx.lifecycle, cap=1024)


@query("cpu_cores_used", """
WITH u AS (SELECT handle, attempt, max(value) FILTER (name = 'cpu.user_ms') AS cpu_ms, max(value) FILTER (name = 'cpu.throttled_ms') AS held_ms FROM fx_measures GROUP BY ALL)
SELECT p.task, count(*) AS attempts, round(avg(cpu_ms / (ended_ms - started_ms)), 6) AS cores_mean,
  count(held_ms) AS capped, round(CAST(sum(held_ms) AS DOUBLE) / CAST(sum(ended_ms - started_ms) FILTER (held_ms IS NOT NULL) AS DOUBLE), 6) AS throttled_share
FROM fx_pivot p JOIN u USING (handle, attempt) WHERE ended_ms > started_ms GROUP BY p.task""", ["fx_pivot", "fx_measures"])
def _(fx):
    return A.cpu_cores_used(fx.lifecycle)


@query("declared_vs_used", """
SELECT task, max(mem_bytes) AS declared, max(value) AS used, count(DISTINCT method) > 1 AS methods_mixed,
  max(mem_bytes) - max(value) AS headroom FROM fx_measures WHERE name = 'mem.peak' GROUP BY task""", ["fx_measures"])
def _(fx):
    return A.declared_vs_used(fx.lifecycle)


@query("run_report", f"""
WITH {OVER}, p AS (SELECT handle, max(value) AS peak FROM fx_measures WHERE name = 'mem.peak' GROUP BY handle),
j AS (SELECT handle, min(ts_ms) FILTER (kind = 'STARTED') AS start_ms,
  max(ts_ms) FILTER (kind IN ('FINISHED','DEAD_LETTERED','DROPPED')) AS end_ms,
  coalesce(max(attempt) FILTER (kind = 'STARTED'), 0) AS tries,
  max(kind) FILTER (kind IN ('FINISHED','DEAD_LETTERED','DROPPED')) AS k,
  max(status) FILTER (kind IN ('FINISHED','DEAD_LETTERED','DROPPED')) AS s FROM fx_lifecycle GROUP BY handle)
SELECT handle, start_ms, end_ms, tries, peak, CASE WHEN k = 'FINISHED' AND tries > 1 THEN 'finished after a retry'
  WHEN k = 'FINISHED' THEN 'finished' WHEN k IS NOT NULL THEN 'dead letter: ' || s ELSE 'open' END AS result
FROM j LEFT JOIN p USING (handle)
UNION ALL SELECT -i.handle, NULL, NULL, 0, NULL, 'refused: ' || CASE WHEN p.paused IS NULL OR p.paused THEN 'NOTFOUND' ELSE 'BUDGET' END
FROM fx_items i LEFT JOIN policies p ON p.task = i.task WHERE p.paused IS NULL OR p.paused OR i.mem_bytes > p.max_mem OR i.task IN (SELECT task FROM over_budget)""",
       ["fx_lifecycle", "fx_measures", "fx_items", "policies", "task_costs", "resources"])
def _(fx):
    """The jobs of the log, and a second submission of every item, as far as it was refused."""
    again = fx.items.withColumn("handle", -F.col("handle"))
    screened = V.screen_submissions(again, fx.policies, fx.task_costs, fx.resources)
    return A.run_report(fx.lifecycle, refused=screened.where("verdict <> 'OK'").select("handle", F.col("verdict").alias("status")))


@query("service_report", f"""
WITH s AS (SELECT handle, task, count(*) FILTER (kind = 'STARTED') AS runs, count(*) FILTER (kind = 'FINISHED') AS clean_exits,
  count(*) FILTER (kind = 'FAILED' AND status <> 'CANCELLED') AS crashes,
  max(ts_ms) FILTER ({TERMINAL}) AS stopped_ms FROM fx_lifecycle GROUP BY handle, task),
u AS (SELECT handle, sum(ended_ms - started_ms) AS up FROM fx_attempts GROUP BY handle)
SELECT handle, task, runs, clean_exits, crashes, greatest(0, runs - 1) AS restarts, CAST(coalesce(up, 0) AS BIGINT) AS up_ms, stopped_ms
FROM s LEFT JOIN u USING (handle)""", ["fx_lifecycle", "fx_attempts"])
def _(fx):
    return A.service_report(fx.lifecycle)


@query("failure_reasons", f"""
WITH f AS (SELECT handle, task, ended_ms AS ts_ms, {REASON} AS reason FROM fx_attempts WHERE status <> 'OK'),
g AS (SELECT task, reason, count(*) AS attempts, count(DISTINCT handle) AS handles, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM f GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY task ORDER BY attempts DESC, reason) AS INT) AS rank FROM g)
SELECT * FROM r WHERE rank <= 3""", ["fx_attempts"])
def _(fx):
    return A.failure_reasons(fx.lifecycle)


@query("exit_codes", """
SELECT task, name AS code_kind, value AS code, count(*) AS attempts FROM fx_measures
WHERE name IN ('exit.code','exit.signal','start.error') GROUP BY ROLLUP (task, name, value)""", ["fx_measures"])
def _(fx):
    return A.exit_codes(fx.lifecycle)


@query("shard_load", """
WITH p AS (SELECT mem_bytes AS w, CAST((row_number() OVER (ORDER BY seq) - 1) % 5 AS INT) AS rr, CAST(tenant % 5 AS INT) AS ky FROM fx_items),
l AS (SELECT 'round_robin' AS policy, rr AS shard, count(*) AS items, sum(w) AS work FROM p GROUP BY rr
  UNION ALL SELECT 'keyed', ky, count(*), sum(w) FROM p GROUP BY ky)
SELECT policy, shard, items, CAST(work AS BIGINT) AS work, CAST(sum(work) OVER (PARTITION BY policy) // 5 AS BIGINT) AS ideal,
  round(max(work) OVER (PARTITION BY policy) * 5 / sum(work) OVER (PARTITION BY policy), 6) AS factor FROM l""", ["fx_items"])
def _(fx):
    return longs(A.shard_load(fx.items, "mem_bytes", 5), "work")
