"""Queries: series over time, orders, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from workfold.catalog.aggregates import both_logs
from workfold.catalog.registry import query
from workfold.functions.exprs import unpack_handle, unpack_shard
from workfold.operators import aggregates as A
from workfold.operators import ordering as O
from workfold.operators import series as S
from workfold.operators import sets as X

SERIES = """d AS (
  SELECT task, CASE WHEN started_ms IS NULL THEN queued_ms ELSE least(queued_ms, started_ms) END AS ts_ms, 1 AS p, 0 AS f FROM fx_pivot WHERE queued_ms IS NOT NULL
  UNION ALL SELECT task, coalesce(started_ms, CASE WHEN coalesce(ended_ms, closed_ms) IS NOT NULL THEN greatest(queued_ms, coalesce(ended_ms, closed_ms)) END), -1, 0 FROM fx_pivot WHERE queued_ms IS NOT NULL
  UNION ALL SELECT task, started_ms, 0, 1 FROM fx_pivot
  UNION ALL SELECT task, greatest(started_ms, coalesce(ended_ms, closed_ms)), 0, -1 FROM fx_pivot WHERE started_ms IS NOT NULL AND coalesce(ended_ms, closed_ms) IS NOT NULL),
b AS (SELECT task, ts_ms, sum(p) AS p, sum(f) AS f FROM (SELECT * FROM d UNION ALL SELECT '(total)', ts_ms, p, f FROM d) WHERE ts_ms IS NOT NULL GROUP BY ALL),
s AS (SELECT task, ts_ms, CAST(sum(p) OVER w AS BIGINT) AS pending, CAST(sum(f) OVER w AS BIGINT) AS in_flight,
  CAST(sum(f) OVER w - f AS BIGINT) AS in_flight_before FROM b WINDOW w AS (PARTITION BY task ORDER BY ts_ms))"""


@query("inflight_series", f"SELECT 'retried' AS log, * FROM (WITH {SERIES} SELECT * FROM s) UNION ALL SELECT 'requeued', * FROM (WITH {SERIES.replace('fx_pivot', 'fx_requeued_pivot')} SELECT * FROM s)",
       ["fx_pivot", "fx_requeued_pivot"])
def _(fx):
    return both_logs(fx, S.inflight_series)


@query("inflight_peak", f"""WITH {SERIES},
w AS (SELECT task, ts_ms // 604800000 AS window, max(greatest(in_flight, in_flight_before)) AS peak, arg_min(in_flight_before, ts_ms) AS carried FROM s GROUP BY task, ts_ms // 604800000)
SELECT a.task, a.window, a.peak, greatest(a.peak, coalesce(b.peak, a.carried)) AS shown, (SELECT max(in_flight) FROM s WHERE s.task = a.task) AS highest
FROM w a LEFT JOIN w b ON b.task = a.task AND b.window + 1 = a.window""", ["fx_pivot"])
def _(fx):
    windows = S.inflight_peak_window(fx.lifecycle, 604800000)
    return windows.withColumn("highest", F.max("peak").over(Window.partitionBy("task")))


@query("done_rate", """
WITH c AS (SELECT ts_ms // 225000 AS cell, count(*) AS n FROM fx_lifecycle WHERE kind = 'FINISHED' GROUP BY 1),
x AS (SELECT cell + i AS slot, n FROM c, range(32) r(i))
SELECT CAST((slot + 1) * 225000 AS BIGINT) AS sample_ms, CAST(sum(n) AS BIGINT) AS done, round(sum(n) * 1000 / 7200000, 6) AS per_s FROM x GROUP BY slot""", ["fx_lifecycle"])
def _(fx):
    return S.done_rate(fx.lifecycle, window_s=7200)


OCC = """span AS (SELECT handle, task, attempt, mem_bytes, started_ms, ended_ms FROM fx_attempts),
c AS (SELECT handle, attempt, 'memory' AS resource, mem_bytes AS amount, started_ms, ended_ms FROM span
  UNION ALL SELECT handle, attempt, name, cost, started_ms, ended_ms FROM span JOIN task_costs USING (task))"""


@query("occupancy_costs", f"WITH {OCC} SELECT handle, attempt, resource, CAST(amount AS BIGINT) AS amount FROM c", ["fx_attempts", "task_costs"])
def _(fx):
    return S.occupancy_costs(fx.lifecycle, fx.task_costs)


@query("occupancy_series", f"""
WITH {OCC}, d AS (SELECT resource, started_ms AS ts_ms, amount FROM c UNION ALL SELECT resource, ended_ms, -amount FROM c),
g AS (SELECT resource, ts_ms, sum(amount) AS delta FROM d GROUP BY ALL),
l AS (SELECT resource, ts_ms, CAST(sum(delta) OVER (PARTITION BY resource ORDER BY ts_ms) AS BIGINT) AS in_use FROM g)
SELECT resource, ts_ms, in_use, CAST(budget AS BIGINT) AS budget, coalesce(in_use > budget, FALSE) AS over
FROM l LEFT JOIN (SELECT * FROM resources UNION ALL SELECT 'memory', 8000000000) r ON r.name = l.resource""", ["fx_attempts", "task_costs", "resources"])
def _(fx):
    budgets = fx.resources.unionByName(fx.rows([("memory", 8000000000)], "name string, budget long"))
    return S.occupancy_series(fx.lifecycle, fx.task_costs, budgets)


def requeued(log):
    """The log as a policy of two retries and then a requeue would have written it."""
    attempt = F.col("attempt")
    turn = F.when(attempt > 0, (attempt - 1) % 3 + 1).otherwise(attempt)
    return log.where(~((F.col("kind") == "RETRIED") & ((attempt - 1) % 3 == 0))).withColumn("attempt", turn.cast("int"))


@query("attempt_cycle", """
WITH l AS (SELECT * REPLACE (CAST(CASE WHEN attempt > 0 THEN (attempt - 1) % 3 + 1 ELSE attempt END AS INT) AS attempt),
  CASE WHEN kind IN ('QUEUED','RETRIED') THEN 0 WHEN kind = 'STARTED' THEN 1 WHEN kind IN ('FINISHED','FAILED') THEN 2 ELSE 3 END AS ph
  FROM fx_lifecycle WHERE NOT (kind = 'RETRIED' AND (attempt - 1) % 3 = 0)),
c AS (SELECT *, greatest(1, CAST(sum(CASE WHEN kind = 'STARTED' AND attempt <= 1 THEN 1 ELSE 0 END) OVER w AS BIGINT)) AS cycle,
  max(CASE WHEN ph = 0 THEN ts_ms END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base
  FROM l WINDOW w AS (PARTITION BY handle ORDER BY ts_ms, attempt, ph, arrival)),
p AS (SELECT handle, task, cycle, greatest(attempt, 1) AS attempt, min(ts_ms) FILTER (ph = 0) AS q, min(ts_ms) FILTER (ph = 1) AS s, min(base) FILTER (ph = 1) AS b
  FROM c GROUP BY handle, task, cycle, greatest(attempt, 1))
SELECT handle, task, cycle, attempt, greatest(0, s - coalesce(q, b)) AS wait_ms FROM p WHERE s IS NOT NULL""", ["fx_lifecycle"])
def _(fx):
    return A.attempt_waits(requeued(fx.lifecycle))


@query("round_robin", "SELECT handle, seq, CAST((row_number() OVER (ORDER BY seq) - 1) % 7 AS INT) AS shard FROM fx_items", ["fx_items"])
def _(fx):
    return S.round_robin(fx.items.select("handle", "seq"), 7)


@query("balance_buckets", """
WITH c AS (SELECT handle, mem_bytes, sum(mem_bytes) OVER (ORDER BY seq) - mem_bytes AS before, sum(mem_bytes) OVER () AS total FROM fx_items)
SELECT handle, mem_bytes, CAST(before * 16 // total AS INT) AS bucket FROM c""", ["fx_items"])
def _(fx):
    return S.balance_buckets(fx.items.select("handle", "mem_bytes", "seq"), "mem_bytes", 16).drop("seq")


SINCE = 220000000000


@query("recent_log", f"""
WITH r AS (SELECT kind, handle, task, ts_ms, arrival, CASE WHEN kind IN ('QUEUED','STARTED','FINISHED') THEN 'activity' ELSE 'problem' END AS class FROM fx_lifecycle),
n AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY ts_ms DESC, arrival DESC) AS rn FROM r),
s AS (SELECT * FROM n WHERE rn <= CASE class WHEN 'problem' THEN 40 ELSE 25 END)
SELECT kind, handle, task, ts_ms, class, CAST(row_number() OVER (ORDER BY ts_ms DESC, class DESC, arrival DESC) AS INT) AS pos, CAST(1 AS BIGINT) AS n FROM s
UNION ALL SELECT '(not shown)', NULL, NULL, {SINCE}, class, 0, count(*) FILTER (rn > CASE class WHEN 'problem' THEN 40 ELSE 25 END) FROM n WHERE ts_ms >= {SINCE} GROUP BY class""", ["fx_lifecycle"])
def _(fx):
    return S.recent_log(fx.lifecycle, 40, 25, SINCE)


@query("deadline_overrun", """
WITH t AS (SELECT p.*, CASE WHEN ended_ms >= started_ms THEN ended_ms - started_ms END AS run_ms, nullif(timeout_s, 0) * 1000 AS lim, due_ms
  FROM fx_pivot p JOIN policies USING (task) JOIN fx_items i USING (handle)),
f AS (SELECT DISTINCT handle, attempt FROM fx_lifecycle WHERE kind = 'FINISHED'),
r AS (SELECT handle, task, attempt, 'timeout' AS why, run_ms - lim AS over_ms FROM t WHERE run_ms > lim
  UNION ALL SELECT t.handle, t.task, t.attempt, 'late', ended_ms - due_ms FROM t JOIN f USING (handle, attempt) WHERE ended_ms > due_ms)
SELECT *, rank() OVER (PARTITION BY why ORDER BY over_ms DESC) AS rank FROM r""".replace("SELECT p.*,", "SELECT p.handle, p.task, p.attempt, p.started_ms, p.ended_ms,"),
       ["fx_pivot", "policies", "fx_items", "fx_lifecycle"])
def _(fx):
    return S.deadline_overrun(fx.lifecycle, fx.policies, fx.items)


BACKLOG = ["handle", "tenant", "priority", "due_ms", "enqueue_ms", "seq"]
PRIO = "priority DESC, seq"
EDF = "due_ms IS NULL, due_ms, CASE WHEN due_ms IS NULL THEN priority END DESC, seq"


def _order_sql(order: str) -> str:
    return f"SELECT handle, row_number() OVER (ORDER BY {order}) AS pos FROM fx_items"


def _ordered(fx, keys):
    return O.ordered(fx.items.select(*BACKLOG), keys).select("handle", "pos")


@query("order_priority", _order_sql(PRIO), ["fx_items"])
def _(fx):
    return _ordered(fx, O.priority_keys())


@query("order_edf", _order_sql(EDF), ["fx_items"])
def _(fx):
    return _ordered(fx, O.edf_keys())


@query("order_aging", _order_sql("priority * 86400000 - enqueue_ms DESC, seq"), ["fx_items"])
def _(fx):
    return _ordered(fx, O.aging_keys(86400000))


@query("order_router", _order_sql(f"due_ms NULLS LAST, {PRIO}"), ["fx_items"])
def _(fx):
    return _ordered(fx, O.router_keys())


FAIR = """n AS (SELECT tenant, row_number() OVER (ORDER BY min(seq)) > 64 AS shared FROM fx_items GROUP BY tenant),
s AS (SELECT handle, i.tenant, seq, shared, CASE WHEN shared THEN -1 ELSE i.tenant END AS share, CASE WHEN shared THEN 1 ELSE i.tenant % 3 + 1 END AS w FROM fx_items i JOIN n ON n.tenant = i.tenant)"""


@query("order_fair_share", f"""
WITH {FAIR}, t AS (SELECT handle, seq, (row_number() OVER (PARTITION BY share ORDER BY seq) - 1) * (1048576 // w) AS tag FROM s)
SELECT handle, CAST(tag AS BIGINT) AS tag, row_number() OVER (ORDER BY tag, seq) AS pos FROM t""", ["fx_items"])
def _(fx):
    return O.order_fair_share(fx.items.select(*BACKLOG), F.col("tenant") % 3 + 1, max_tenants=64).select("handle", "tag", "pos")


@query("fair_overflow", f"WITH {FAIR} SELECT count(*) AS items, count(DISTINCT tenant) AS tenants FROM s WHERE shared", ["fx_items"])
def _(fx):
    return O.fair_overflow(fx.items, max_tenants=64)


@query("topk_per_task", f"""
SELECT task, handle, rank FROM (SELECT task, handle, CAST(row_number() OVER (PARTITION BY task ORDER BY {EDF}) AS INT) AS rank FROM fx_items) WHERE rank <= 20""", ["fx_items"])
def _(fx):
    return O.topk_per_task(fx.items, O.edf_keys(), 20).select("task", "handle", "rank")


@query("union_shards", """
SELECT kind, handle, ts_ms, 0 AS shard, handle AS id, 0 AS shard_back, handle AS handle_back FROM fx_lifecycle
UNION ALL SELECT 'SAMPLE', handle, ts_ms, 1, handle + 281474976710656, 1, handle FROM fx_samples""", ["fx_lifecycle", "fx_samples"])
def _(fx):
    logs = {0: fx.lifecycle, 1: fx.samples.withColumn("kind", F.lit("SAMPLE"))}
    return X.union_shards({n: log.select("kind", "handle", "ts_ms") for n, log in logs.items()}).withColumns(
        {"shard_back": unpack_shard("id"), "handle_back": unpack_handle("id")})


@query("undrained", """
SELECT handle FROM fx_items WHERE handle NOT IN (SELECT handle FROM fx_lifecycle WHERE kind IN ('FINISHED','DROPPED','DEAD_LETTERED')
  OR (kind = 'FAILED' AND status = 'CANCELLED'))""", ["fx_items", "fx_lifecycle"])
def _(fx):
    return X.undrained(fx.lifecycle)
