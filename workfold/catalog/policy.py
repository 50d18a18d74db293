"""Queries: failure policies, re-drives and fault-isolated mapping."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import functions as F

from workfold.catalog.registry import query
from workfold.catalog.rules import FAILED, LEDGER, NOW, RULED, failures, terminal_facts
from workfold.operators import joins as J
from workfold.operators import mapping as P
from workfold.operators import policy as Q
from workfold.sources.lifecycle import dead_letters

# The task bodies below travel with the plan.
register_pickle_by_value(sys.modules[__name__])

DISPOSED = """CASE WHEN status = 'CANCELLED' THEN 'CANCELLED' WHEN attempt <= max_retries THEN 'RETRIED' WHEN on_failure = 'requeue' THEN 'REQUEUED'
 WHEN on_failure = 'drop' THEN 'DROPPED' ELSE 'DEAD_LETTERED' END"""
JUDGED = f"""d AS (SELECT m.*, backoff_s, {DISPOSED} AS step FROM m JOIN policies p ON p.task = m.task),
j AS (SELECT handle, task, attempt, ts_ms, status, step, wait_ms, CAST(CASE step WHEN 'RETRIED' THEN attempt + 1 WHEN 'REQUEUED' THEN 1 END AS INT) AS next_attempt,
  CASE step WHEN 'RETRIED' THEN ts_ms + backoff_s * 1000 WHEN 'REQUEUED' THEN ts_ms + greatest(backoff_s * 1000, 100) END AS due_ms FROM d)"""


@query("failure_disposition", f"WITH {FAILED}{RULED}, {JUDGED} SELECT handle, task, attempt, ts_ms, status, step, next_attempt, due_ms FROM j",
       ["fx_attempts", "retry_rules", "policies"])
def _(fx):
    return Q.failure_disposition(failures(fx).drop("exit_code", "start_error"), fx.policies)


@query("retry_decision", f"""
WITH {FAILED}{RULED}, {JUDGED}, n AS (SELECT *, step IN ('RETRIED','REQUEUED') AS goes, coalesce(wait_ms = 4294967295, FALSE) AS never FROM j)
SELECT handle, task, attempt, step, next_attempt, goes AND never AS denied, CASE WHEN goes AND NOT never THEN due_ms + coalesce(wait_ms, 0) ELSE due_ms END AS due_ms,
 CASE WHEN goes AND never THEN 'DEAD_LETTERED' WHEN NOT goes THEN step END AS final, CASE WHEN goes AND never THEN 'DENIED' WHEN NOT goes THEN status END AS final_status FROM n""",
       ["fx_attempts", "retry_rules", "policies"])
def _(fx):
    return Q.retry_decision(failures(fx), fx.policies, fx.retry_rules).select(
        "handle", "task", "attempt", "step", "next_attempt", "denied", "due_ms", "final", "final_status")


@query("redrive_plan", f"""
WITH {LEDGER}, x AS (SELECT i.handle, priority, task || ':' || handle AS payload, CASE WHEN due_ms IS NOT NULL THEN greatest(l.ts_ms, due_ms) END AS due
  FROM fx_items i JOIN fx_damaged l USING (handle, task) WHERE l.kind = 'DEAD_LETTERED')
SELECT business_id, x.handle, rounds, priority, payload, CASE WHEN rounds >= 2 THEN 'declined' WHEN due < {NOW} THEN 'late' ELSE 'resubmit' END AS plan,
 CASE WHEN rounds < 2 AND due >= {NOW} THEN due - {NOW} END AS due_in_ms
FROM x JOIN led ON led.handle = x.handle""",
       ["fx_submissions", "fx_damaged", "fx_items"])
def _(fx):
    rows = J.ledger(fx.submissions, terminal_facts(fx.damaged))
    items = fx.items.select("handle", "priority", "due_ms", F.concat("task", F.lit(":"), F.col("handle").cast("string")).alias("payload"))
    return Q.redrive_plan(rows, dead_letters(fx.damaged, items), bound=2, now_ms=NOW, drop_late=True)


def measure_text(text: str, attempt: int) -> str:
    """A task body with repeatable trouble: some texts fail once, some always."""
    n = len(text)
    if n % 11 == 0:
        raise ValueError(f"length {n}")
    if n % 7 == 0 and attempt == 1:
        raise RuntimeError("not ready")
    return str(n)


@query("map_dead_letter", """
WITH d AS (SELECT doc_id AS key, text, length(text) AS n FROM documents), a AS (SELECT key, text, n, i AS attempt FROM d, (VALUES (1), (2), (3)) t(i)),
r AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'TASK' WHEN n % 7 = 0 AND attempt = 1 THEN 'TASK' ELSE 'OK' END AS status,
  CASE WHEN n % 11 = 0 THEN 'ValueError: length ' || n WHEN n % 7 = 0 AND attempt = 1 THEN 'RuntimeError: not ready' END AS error,
  CASE WHEN n % 11 = 0 THEN 3 WHEN n % 7 = 0 THEN 2 ELSE 1 END AS tries FROM a)
SELECT 'attempt' AS kind, key, attempt, status, CAST(NULL AS VARCHAR) AS result, error, CAST(NULL AS VARCHAR) AS payload FROM r WHERE attempt <= tries
UNION ALL SELECT 'result', key, attempt, status, CAST(n AS VARCHAR), NULL, NULL FROM r WHERE attempt = tries AND status = 'OK'
UNION ALL SELECT 'dead_letter', key, attempt, status, NULL, error, text FROM r WHERE attempt = tries AND status <> 'OK'""")
def _(fx):
    return P.map_dead_letter(fx.table("documents"), "doc_id", "text", measure_text, max_retries=2)


@query("sharded_map", "SELECT conv_id, 1::BIGINT AS partitions, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def _(fx):
    def size(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"conv_id": batch["conv_id"], "chars": batch["text"].str.len().astype("int64")})

    mapped = P.sharded_map(fx.table("conversations").select("conv_id", "text"), "conv_id", 8, size, "conv_id long, chars long")
    return mapped.withColumn("p", F.spark_partition_id()).groupBy("conv_id").agg(
        F.count_distinct("p").alias("partitions"), F.count("*").alias("turns"), F.sum("chars").alias("chars"))
