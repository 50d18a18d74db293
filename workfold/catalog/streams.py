"""Queries: the streams, run over the derived log and compared with their batch twins' SQL; sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from workfold import model as M
from workfold.catalog.aggregates import COUNTS_ALL, REQUEUED_WAIT, ROLL, RUN, TASK, latency
from workfold.catalog.registry import longs, query
from workfold.catalog.rules import LEDGER, terminal_facts
from workfold.operators import aggregates as A
from workfold.operators import measures as P
from workfold.plans.pin import pin, swept
from workfold.session import fresh_path
from workfold.sources import lifecycle as L
from workfold.streaming import aggregates as G
from workfold.streaming import state as S
from workfold.streaming.run import drain, newest


ORIGIN = 788918400000  # 1995-01-01, stamp 0 of the derived log


def written(df, label: str) -> str:
    """The derived log as files in the shared folder, so that it can be streamed."""
    path = fresh_path(df.sparkSession, label)
    with swept(df.sparkSession):
        df.write.parquet(path)
    return path


ROWS_PER_FILE = 250_000


ROWS_PER_SLICE = 2_500_000


def slices_of(rows: int, rows_per_slice: int | None = None) -> int:
    """Into how many slices a log goes whose joins hold a slice in the executors' memory: five, or more where one would be large."""
    return max(5, -(-rows // (rows_per_slice or ROWS_PER_SLICE)))


def written_in_order(df, label: str, slices: int = 5, rows_per_file: int = ROWS_PER_FILE) -> tuple[str, int]:
    """The rows as files in order of ``ts_ms``, equally many for each of a few slices, as a source writes that goes on:
    a stream with a watermark takes what comes much later than the newest event as late. The path, and the files of
    a slice; a stream that takes so many at a time takes whole slices. ``df`` is read several times."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    size = df.agg(F.percentile_approx("ts_ms", [i / slices for i in range(1, slices)], 1000).alias("cuts"), F.count("*").alias("rows")).first()
    files = max(1, min(-(-size.rows // (slices * rows_per_file)), df.rdd.getNumPartitions()))
    cuts = size.cuts or [0] * (slices - 1)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = df if low is None else df.where(F.col("ts_ms") > low)
        part = part if high is None else part.where(F.col("ts_ms") <= high)
        before = len(_files(spark, path, df.schema))
        part.coalesce(files).write.mode("append").parquet(path)
        for _ in range(files - len(_files(spark, path, df.schema)) + before):  # a task without rows writes no file
            df.limit(0).coalesce(1).write.mode("append").parquet(path)
    return path, files


def _files(spark, path: str, schema) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)
    return spark.read.schema(schema).parquet(path).inputFiles() if there else []


def beating(log):
    """The log, and a sample of nobody long after its end, which moves the watermark past all that happened."""
    last = log.groupBy().agg((F.max("ts_ms") + 400 * 86400000).alias("ts_ms"))
    return log.unionByName(last.select(F.lit("SAMPLE").alias("kind"), "ts_ms"), allowMissingColumns=True)


STATES = ["kind", "handle", "task", "ts_ms", "status", "attempt", "arrival"]  # what streams of life cycles read


def streamed(fx, log=None, files_per_batch: int = 3, batches: int = 5):
    """The log as a stream of ``files_per_batch`` files at a time, or more where there would be more than so many ``batches``:
    each goes through the whole state. Columns that ``log`` does not bring are NULL in the stream."""
    path = written(fx.lifecycle if log is None else log, "log")
    files = len(_files(fx.spark, path, M.LIFECYCLE))
    return L.stream_lifecycle(fx.spark, path, files_per_batch=max(files_per_batch, -(-files // batches)))


def in_order(fx, log=None):
    """The log as five micro-batches in order of time, the last with the heartbeat."""
    path, files = written_in_order(beating(pin(fx.lifecycle if log is None else log, "log")), "log")
    return L.stream_lifecycle(fx.spark, path, files_per_batch=files)


@query("src_lifecycle", """
SELECT kind, count(*) AS n, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, CAST(sum(attempt) AS BIGINT) AS attempts, count(*) AS no_shard FROM fx_lifecycle GROUP BY kind""", ["fx_lifecycle"])
def _(fx):
    # Kinds and columns the reader does not know are in the files as well.
    odd = fx.table("events").select(F.upper("event_type").alias("kind"), F.col("user_id").alias("handle"), F.lit(0).alias("attempt"),
                                    F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("props").alias("note"))
    log = fx.lifecycle.drop("flags").unionByName(odd, allowMissingColumns=True)
    read = L.read_lifecycle(fx.spark, written(log, "log"))
    return read.groupBy("kind").agg(
        F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.sum("attempt").alias("attempts"),
        F.count_if(F.col("shard").isNull() & F.col("flags").isNull()).alias("no_shard"))


@query("sink_snapshot", f"""
WITH c AS (SELECT {TASK}, {COUNTS_ALL} FROM fx_lifecycle {ROLL}),
m AS (SELECT task, count(*) AS measure_rows FROM (SELECT DISTINCT task, name, method, unit, kind FROM fx_measures
  UNION ALL SELECT DISTINCT '(total)', name, method, unit, kind FROM fx_measures) GROUP BY task)
SELECT * FROM c LEFT JOIN m USING (task)""", ["fx_lifecycle", "fx_measures"])
def _(fx):
    path = fresh_path(fx.spark, "snapshot")
    L.write_snapshot(A.counters(fx.lifecycle), P.measure_fold(P.measure_rows(fx.lifecycle)), path)
    measures = fx.spark.read.parquet(f"{path}/measures").groupBy("task").agg(F.count("*").alias("measure_rows"))
    return fx.spark.read.parquet(f"{path}/counters").join(measures, "task", "left")


@query("sink_dead_letter", """
SELECT l.handle, l.task, l.ts_ms AS dead_ms, l.status, l.attempt AS attempts, l.mem_bytes, m.value AS peak, i.priority, l.task || ':' || l.handle AS payload,
 CASE WHEN i.due_ms IS NOT NULL THEN greatest(0, i.due_ms - l.ts_ms) END AS due_in_ms FROM fx_lifecycle l JOIN fx_items i ON i.handle = l.handle
JOIN fx_measures m ON m.handle = l.handle AND m.attempt = l.attempt AND m.name = 'mem.peak' WHERE l.kind = 'DEAD_LETTERED'""", ["fx_lifecycle", "fx_measures", "fx_items"])
def _(fx):
    from workfold.functions.exprs import measure

    path = fresh_path(fx.spark, "dead")
    items = fx.items.select("handle", "priority", "due_ms", F.concat("task", F.lit(":"), F.col("handle").cast("string")).alias("payload"))
    L.write_dead_letters(L.dead_letters(fx.lifecycle, items), path)
    back = fx.spark.read.parquet(path)
    return back.select("handle", "task", "dead_ms", "status", "attempts", "mem_bytes", measure("mem.peak").cast("long").alias("peak"),
                       "priority", "payload", "due_in_ms")


@query("stream_counters", f"SELECT {TASK}, {COUNTS_ALL} FROM fx_lifecycle {ROLL}", ["fx_lifecycle"])
def _(fx):
    return newest(drain(G.stream_counters(streamed(fx)), "counters"), ["task"])


@query("stream_lifecycle_state", f"""
WITH g AS (SELECT {TASK}, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'in_flight') AS in_flight FROM fx_requeued_state {ROLL}),
l AS (SELECT {TASK}, {latency('wait', REQUEUED_WAIT)}, {latency('run', RUN)} FROM fx_requeued_pivot {ROLL})
SELECT * FROM g JOIN l USING (task)""", ["fx_requeued_state", "fx_requeued_pivot"])
def _(fx):
    changes = drain(S.stream_lifecycle_state(streamed(fx, fx.requeued.select(*STATES))), "changes", machine=True)
    return S.fold_changes(changes).drop("expired")


@query("stream_attempts", f"""
WITH g AS (SELECT {TASK}, count(*) FILTER (state = 'pending') AS pending, count(*) FILTER (state = 'in_flight') AS in_flight FROM fx_requeued_state {ROLL}),
l AS (SELECT {TASK}, {latency('wait', REQUEUED_WAIT)}, {latency('run', RUN)} FROM fx_requeued_pivot {ROLL})
SELECT * FROM g JOIN l USING (task)""", ["fx_requeued_state", "fx_requeued_pivot"])
def _(fx):
    events = newest(drain(G.stream_attempts(streamed(fx, fx.requeued.select(*STATES))), "attempts", machine=True), ["handle", "task"])
    return longs(G.lifecycle_now(events), "wait_ms_sum", "run_ms_sum")


@query("stream_state_ttl", """
WITH e AS (SELECT handle, task, min(ts_ms) AS over_ms FROM fx_lifecycle
  WHERE kind IN ('FINISHED','DROPPED','DEAD_LETTERED') OR (kind = 'FAILED' AND status = 'CANCELLED') GROUP BY handle, task)
SELECT e.over_ms // 86400000 * 86400000 AS from_ms, task, count(*) AS expired FROM e JOIN fx_items i USING (handle, task)
WHERE handle % 3 = 0 OR enqueue_ms < over_ms - 2592000000 OR enqueue_ms > over_ms + 3600000 GROUP BY over_ms // 86400000, task""", ["fx_lifecycle", "fx_items"])
def _(fx):
    # Of every third item nobody saw the QUEUED; some others were queued too long before to be remembered.
    log = fx.lifecycle.where((F.col("kind") != "QUEUED") | (F.col("handle") % 3 != 0))
    stream = S.stream_expired_markers(in_order(fx, log), ttl="1 HOUR", lifetime="30 DAYS", origin_ms=ORIGIN)
    return drain(stream, "ttl", "append", each=S.expired_per_day).groupBy("from_ms", "task").agg(F.sum("expired").alias("expired"))


@query("stream_done_rate", """
WITH c AS (SELECT ts_ms // 225000 AS cell, count(*) AS n FROM fx_lifecycle WHERE kind = 'FINISHED' GROUP BY 1),
x AS (SELECT cell + i AS slot, n FROM c, range(32) r(i))
SELECT 'sliding' AS how, CAST((slot + 1) * 225000 AS BIGINT) AS sample_ms, CAST(sum(n) AS BIGINT) AS done, round(sum(n) * 1000 / 7200000, 6) AS per_s FROM x GROUP BY slot
UNION ALL SELECT 'tumbling', (ts_ms // 7200000 + 1) * 7200000, count(*), round(count(*) * 1000 / 7200000, 6) FROM fx_lifecycle WHERE kind = 'FINISHED' GROUP BY ts_ms // 7200000""", ["fx_lifecycle"])
def _(fx):
    path, files = written_in_order(beating(pin(fx.lifecycle, "log")), "log")

    def rate(step, how):
        stream = L.stream_lifecycle(fx.spark, path, files_per_batch=files)
        table = drain(G.stream_done_rate(stream, "7200 seconds", step, origin_ms=ORIGIN), "rate", "append")
        return table.drop("batch").withColumn("how", F.lit(how))

    return rate("225 seconds", "sliding").unionByName(rate(None, "tumbling"))


@query("stream_measure_fold", """
SELECT (ts_ms + 788918400000) // 2592000000 * 2592000000 - 788918400000 AS from_ms, task, name, method, unit, kind, count(*) AS count, CAST(sum(value) AS BIGINT) AS sum, min(value) AS min, max(value) AS max,
 arg_max(value, CAST(ts_ms AS HUGEINT) * 1000000000 + arrival) AS last FROM fx_measures GROUP BY (ts_ms + 788918400000) // 2592000000, task, name, method, unit, kind""", ["fx_measures"])
def _(fx):
    table = drain(G.stream_measure_fold(in_order(fx), "30 days", origin_ms=ORIGIN), "fold")
    rows = newest(table, ["from_ms", "task", "name", "method", "unit", "kind"])
    return rows.withColumns({c: F.col(c).cast("long") for c in ("sum", "min", "max", "last")})


@query("stream_first_terminal", "SELECT * FROM fx_outcomes", ["fx_outcomes"])
def _(fx):
    table = drain(S.stream_first_terminal(in_order(fx), "30 days", origin_ms=ORIGIN), "first")
    return S.outcomes_now(newest(table, ["handle", "from_ms"]))


@query("stream_ledger", f"WITH {LEDGER} SELECT * FROM led", ["fx_submissions", "fx_damaged"])
def _(fx):
    ids = fx.submissions.select("business_id", "round", "handle")
    last = pin(fx.damaged.groupBy().agg((F.max("ts_ms") + 400 * 86400000).alias("ts_ms")).withColumns({
        "business_id": F.lit(""), "round": F.lit(0), "handle": F.lit(0).cast("long")}), "last")

    def streamed_in_order(rows, label):
        rows = pin(rows, label).unionByName(last, allowMissingColumns=True)
        path, files = written_in_order(rows, label)
        return fx.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)

    subs = streamed_in_order(fx.submissions, "subs")
    facts = streamed_in_order(fx.damaged.transform(terminal_facts).join(ids, "handle"), "facts")
    # A fact may come up to seven years after the round that cut it off, in this log.
    stream = S.stream_ledger(subs, facts, horizon="2600 DAYS", origin_ms=ORIGIN)
    return S.ledger_now(drain(stream, "ledger", "append", each=S.folded_facts)).where("business_id <> ''")


@query("stream_gates", """
SELECT gate, count(*) AS deps, max(ended_ms) AS release_ms FROM fx_gate_deps LEFT JOIN fx_outcomes ON handle = dep GROUP BY gate HAVING count(*) = count(ended_ms)""",
       ["fx_gate_deps", "fx_outcomes"])
def _(fx):
    return drain(S.stream_gates(in_order(fx), fx.gate_deps, origin_ms=ORIGIN), "gates", "append", machine=True).drop("batch")


@query("stream_overrun_alert", """
WITH e AS (SELECT handle, attempt, started_ms, started_ms + timeout_s * 1000 AS deadline_ms,
  (SELECT min(ts_ms) FROM fx_lifecycle l WHERE l.handle = a.handle AND l.attempt = a.attempt AND l.kind IN ('FINISHED', 'FAILED') AND l.ts_ms >= a.started_ms AND l.handle % 13 <> 0) AS ended_ms
  FROM fx_attempts a JOIN policies USING (task) WHERE timeout_s > 0)
SELECT handle, attempt, deadline_ms, 'open' AS what, CAST(NULL AS BIGINT) AS over_ms FROM e WHERE ended_ms IS NULL OR ended_ms > deadline_ms
UNION ALL SELECT handle, attempt, deadline_ms, 'ended', ended_ms - deadline_ms FROM e WHERE ended_ms > deadline_ms AND ended_ms <= deadline_ms + 7 * 86400000""",
       ["fx_attempts", "fx_lifecycle", "policies"])
def _(fx):
    # Some items never end.
    log = pin(fx.lifecycle.where((F.col("handle") % 13 != 0) | F.col("kind").isin("QUEUED", "STARTED")).select(*STATES), "log")
    limits = fx.policies.where("timeout_s > 0").select("task", (F.col("timeout_s").cast("long") * 1000).alias("limit_ms"))
    # Starts and ends each move the watermark; both come to an end of the log, long after the last.
    last = log.groupBy().agg((F.max("ts_ms") + 400 * 86400000).alias("ts_ms")).withColumns({
        "handle": F.lit(0).cast("long"), "attempt": F.lit(1), "task": F.lit("2-HIGH"), "kind": F.explode(F.array(F.lit("STARTED"), F.lit("FINISHED")))})
    path, files = written_in_order(log.unionByName(last, allowMissingColumns=True), "log", slices_of(log.count()))
    alerts = drain(S.stream_overrun_alert(L.stream_lifecycle(fx.spark, path, files_per_batch=files), limits, horizon="7 DAYS", origin_ms=ORIGIN), "alerts", "append")
    return S.alerts_now(alerts).where("handle > 0")


@query("stream_latest_sample", """
SELECT handle, CAST(arrival % 5 + 1 AS INT) AS attempt, count(*) AS samples, arg_max(value, CAST(ts_ms AS HUGEINT) * 1000000000 + arrival) AS current, max(ts_ms) AS sampled_ms
FROM fx_samples s WHERE NOT EXISTS (SELECT 1 FROM fx_attempts a WHERE a.handle = s.handle AND a.attempt = s.arrival % 5 + 1 AND a.handle % 3 = 0)
GROUP BY handle, CAST(arrival % 5 + 1 AS INT)""", ["fx_samples", "fx_attempts"])
def _(fx):
    sample = F.struct("name", F.col("value").cast("decimal(20,0)").alias("value"), F.lit("BYTES").alias("unit"), F.lit("CURRENT").alias("kind"), "method")
    log = fx.samples.select(F.lit("SAMPLE").alias("kind"), "handle", (F.col("arrival") % 5 + 1).cast("int").alias("attempt"), "ts_ms", "arrival",
                            F.array(sample.cast(M.MEASURE)).alias("measures"))
    ends = fx.attempts.where("handle % 3 = 0").select(F.lit("FINISHED").alias("kind"), "handle", "attempt", F.col("ended_ms").alias("ts_ms"),
                                                      F.lit(0).cast("long").alias("arrival"), F.lit(None).cast(log.schema["measures"].dataType).alias("measures"))
    log = log.unionByName(ends)
    stream = in_order(fx, log).select("kind", "handle", "attempt", "ts_ms", "arrival", F.explode_outer("measures").alias("m")).select(
        "kind", "handle", "attempt", "ts_ms", "arrival", "m.name", "m.value")
    table = drain(G.stream_latest_sample(stream, span="30 days", origin_ms=ORIGIN).select("*", F.unix_millis("w.start").alias("from_ms")).drop("w"), "samples")
    out = G.samples_now(newest(table, ["handle", "attempt", "from_ms"]))
    return out.withColumn("current", F.col("current").cast("long"))
