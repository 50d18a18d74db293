"""Queries: measurement folds and memory sizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from workfold import model as M
from workfold.catalog.registry import longs, query
from workfold.operators import measures as P


FOLD = """count(*) AS count, CAST(sum(value) AS BIGINT) AS sum, min(value) AS min, max(value) AS max,
 arg_max(value, {k}) AS last, max(ts_ms) AS last_ms"""
KEY = "ts_ms * 1000000000 + arrival"
NUM = ["sum", "min", "max", "last"]


@query("measure_fold", f"""
SELECT CASE WHEN grouping(task) = 1 THEN '(total)' ELSE task END AS task, name, method, unit, kind, {FOLD.format(k="CAST(ts_ms AS HUGEINT) * 1000000000 + arrival")}
FROM fx_measures GROUP BY GROUPING SETS ((task, name, method, unit, kind), (name, method, unit, kind))""", ["fx_measures"])
def _(fx):
    return longs(P.measure_fold(P.measure_rows(fx.lifecycle)), *NUM)


# Measurements with a second unit for one name, an over-long name and more names than rows.
def _unruly(fx):
    rows = P.measure_rows(fx.lifecycle)
    odd = F.when(F.col("handle") % 11 == 0, F.lit("MIB")).otherwise(F.col("unit"))
    name = (F.when(F.col("handle") % 13 == 0, F.concat(F.col("name"), F.repeat(F.lit("x"), F.lit(60))))
            .when(F.col("handle") % 17 == 0, F.concat(F.col("name"), F.lit("."), (F.col("handle") % 40).cast("string")))
            .otherwise(F.col("name")))
    return rows.withColumns({"unit": odd, "name": name})


UNRULY = """u AS (SELECT * REPLACE (CASE WHEN handle % 11 = 0 THEN 'MIB' ELSE unit END AS unit,
  CASE WHEN handle % 13 = 0 THEN name || repeat('x', 60) WHEN handle % 17 = 0 THEN name || '.' || (handle % 40) ELSE name END AS name) FROM fx_measures),
b AS (SELECT * FROM u UNION ALL SELECT * REPLACE ('(total)' AS task) FROM u),
v AS (SELECT *, length(name) >= 64 OR length(method) >= 64 AS too_long,
  first_value(unit) OVER w AS unit1, first_value(kind) OVER w AS kind1, first_value(arrival * 10 + nth) OVER w AS seen
  FROM b WINDOW w AS (PARTITION BY task, name, method ORDER BY arrival * 10 + nth)),
t AS (SELECT task, name, method, row_number() OVER (PARTITION BY task ORDER BY min(seen)) AS rn FROM v WHERE NOT too_long GROUP BY task, name, method),
j AS (SELECT v.*, CASE WHEN too_long THEN 'name' WHEN rn > 32 THEN 'full' WHEN unit <> unit1 OR kind <> kind1 THEN 'unit' END AS refused
  FROM v LEFT JOIN t USING (task, name, method))"""


@query("measure_drops", f"""
WITH {UNRULY} SELECT task, count(*) FILTER (refused = 'name') AS dropped_name, count(*) FILTER (refused = 'unit') AS dropped_unit,
 count(*) FILTER (refused = 'full') AS dropped_full FROM j GROUP BY task""", ["fx_measures"])
def _(fx):
    return P.measure_drops(_unruly(fx), max_rows=M.MEASURE_ROWS, name_bytes=M.NAME_MAX)


@query("measure_combine", f"""
SELECT handle, name, method, unit, kind, CASE WHEN unit = 'CODE' THEN arg_max(value, {KEY}) WHEN kind = 'PEAK' THEN max(value)
 WHEN kind = 'TOTAL' THEN CAST(sum(value) AS BIGINT) WHEN kind = 'FLAG' THEN least(max(value), 1) ELSE arg_max(value, {KEY}) END AS value
FROM fx_measures GROUP BY handle, name, method, unit, kind""".replace(KEY, "CAST(ts_ms AS HUGEINT) * 1000000000 + arrival"), ["fx_measures"])
def _(fx):
    return longs(P.measure_combine(P.measure_rows(fx.lifecycle)), "value")


@query("merge_measures", f"""
WITH s AS (SELECT task, handle % 4 AS shard, name, method, unit, kind, {FOLD.format(k="CAST(ts_ms AS HUGEINT) * 1000000000 + arrival")} FROM fx_measures GROUP BY ALL)
SELECT task, name, method, unit, kind, CAST(sum(count) AS BIGINT) AS count, CAST(sum(sum) AS BIGINT) AS sum, min(min) AS min, max(max) AS max,
 arg_max(last, last_ms * 10 + shard) AS last, max(last_ms) AS last_ms FROM s GROUP BY task, name, method, unit, kind""", ["fx_measures"])
def _(fx):
    rows = P.measure_rows(fx.lifecycle)
    tagged = rows.withColumn("task", F.concat_ws("|", (F.col("handle") % 4).cast("string"), "task"))
    shards = P.measure_fold(tagged).where(F.col("task") != "(total)")
    shards = shards.withColumns({"task": F.substring_index("task", "|", -1), "shard": F.substring_index("task", "|", 1)})
    return longs(P.merge_measures(shards, order="shard"), *NUM)


@query("peak_memory", """
WITH r AS (SELECT task, ts_ms, arrival, value, method, CASE WHEN lag(method) OVER w IS DISTINCT FROM method THEN 1 ELSE 0 END AS turn
  FROM fx_measures WHERE name = 'mem.peak' WINDOW w AS (PARTITION BY task ORDER BY ts_ms, arrival)),
i AS (SELECT *, sum(turn) OVER (PARTITION BY task ORDER BY ts_ms, arrival) AS island FROM r),
l AS (SELECT task, max(island) AS island FROM i GROUP BY task)
SELECT task, method, max(value) AS mem_peak, count(*) AS samples FROM i JOIN l USING (task, island) GROUP BY task, method""", ["fx_measures"])
def _(fx):
    return P.peak_memory(fx.lifecycle)


EVIDENCE = """e AS (SELECT a.task, a.handle, a.attempt, a.ended_ms AS ts_ms, a.handle * 1000 + a.attempt * 10 + CASE WHEN a.status = 'OK' THEN 3 ELSE 4 END AS arrival,
  a.mem_bytes, a.mem_peak AS peak, a.method, (a.method = 'cgroup.job.resident' AND a.mem_peak > a.mem_bytes) AS was_hit
  FROM fx_attempts a WHERE a.status <> 'CANCELLED' AND NOT (a.status = 'TASK' AND a.exit_code = 7)),
o AS (SELECT task, arg_min(method, arrival) AS own FROM e GROUP BY task),
x AS (SELECT e.*, own, CASE WHEN method = own THEN peak END AS own_peak FROM e JOIN o USING (task))"""
SUGGEST = """CASE WHEN {hits} = 0 AND {n} < 5 THEN 0 ELSE CAST(ceil(greatest(1048576, greatest({peak} // 100 * 125 + ({peak} % 100) * 125 // 100,
  {hit} // 100 * 150 + ({hit} % 100) * 150 // 100)) / 1048576) AS BIGINT) * 1048576 END"""


@query("suggest_memory", f"""
WITH {EVIDENCE}, g AS (SELECT task, any_value(own) AS method, coalesce(max(own_peak), 0) AS peak,
  count(*) FILTER (own_peak IS NOT NULL OR was_hit) AS samples, count(*) FILTER (was_hit) AS cap_hits,
  coalesce(max(mem_bytes) FILTER (was_hit), 0) AS hit_declared,
  arg_max(mem_bytes, arrival) FILTER (own_peak IS NOT NULL OR was_hit) AS declared, count(*) FILTER (method <> own) AS other_method FROM x GROUP BY task)
SELECT *, {SUGGEST.format(hits='cap_hits', n='samples', peak='peak', hit='hit_declared')} AS suggested FROM g""", ["fx_attempts"])
def _(fx):
    return longs(P.suggest_memory(fx.lifecycle), "suggested")


def _run(tag: str, frame: str) -> str:
    w = f"(PARTITION BY task ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND {frame})"
    return (f"coalesce(max(own_peak) OVER {w}, 0) AS peak{tag}, coalesce(max(CASE WHEN was_hit THEN mem_bytes END) OVER {w}, 0) AS hit{tag}, "
            f"count(*) OVER {w} AS n{tag}, coalesce(sum(CASE WHEN was_hit THEN 1 ELSE 0 END) OVER {w}, 0) AS hits{tag}")


@query("suggestion_history", f"""
WITH {EVIDENCE}, r AS (SELECT task, ts_ms, arrival, {_run('0', 'CURRENT ROW')}, {_run('1', '1 PRECEDING')} FROM x WHERE own_peak IS NOT NULL OR was_hit),
s AS (SELECT task, ts_ms, arrival, {SUGGEST.format(hits='hits0', n='n0', peak='peak0', hit='hit0')} AS suggested,
  {SUGGEST.format(hits='hits1', n='n1', peak='peak1', hit='hit1')} AS was FROM r)
SELECT * FROM s WHERE suggested <> was""", ["fx_attempts"])
def _(fx):
    return longs(P.suggestion_history(fx.lifecycle), "suggested", "was")
