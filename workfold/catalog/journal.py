"""Queries: journals folded into state and back."""

from __future__ import annotations

from pyspark.sql import functions as F

from workfold.catalog.registry import query
from workfold.operators import journal as J
from workfold.operators import validation as V
from workfold.plans.pin import pin
from workfold.plans.running import ordinal
from workfold.session import fresh_path
from workfold.sources.lifecycle import read_journal


@query("src_journal", "SELECT file, type, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM fx_journal GROUP BY ALL", ["fx_journal"])
def _(fx):
    # A type that a later writer added is in the files as well.
    odd = fx.journal.where("type = 'P'").withColumn("type", F.lit("Z"))
    path = fresh_path(fx.spark, "journal")
    fx.journal.unionByName(odd).write.parquet(path)
    read = read_journal(fx.spark, path)
    return read.groupBy("file", "type").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


OPTS = "opts.priority AS priority, opts.timeout_ms AS timeout_ms, opts.due_ms AS due_ms, opts.flags AS flags"


def plain(df):
    """Payload as text and the options as columns."""
    return df.withColumn("payload", F.col("payload").cast("string")).select("*", "opts.*").drop("opts")


def mixed(fx):
    """The journal with a type that a later writer added, and seqs no writer makes."""
    heads = fx.journal.where("type = 'P' AND seq % 3 = 0")
    return fx.journal.unionByName(heads.withColumn("type", F.lit("Z"))).unionByName(heads.withColumns({"seq": -F.col("seq"), "pos": F.col("pos") + 50}))


@query("journal_validate", """
SELECT file, pos, type, seq, 'seq does not rise' AS damage FROM (SELECT *, max(seq) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
  FROM fx_journal WHERE type = 'P') WHERE seq <= coalesce(above, 0)
UNION ALL SELECT file, pos + 50, type, -seq, 'seq too large' FROM fx_journal WHERE type = 'P' AND seq % 3 = 0""", ["fx_journal"])
def _(fx):
    return V.journal_validate(mixed(fx).where(F.col("type") != "Z"))


@query("journal_replay", f"SELECT file, seq, name, payload, done, quarantined, inflight, crashes, {OPTS} FROM fx_state", ["fx_state"])
def _(fx):
    path = fresh_path(fx.spark, "journal")
    mixed(fx).write.parquet(path)
    return plain(J.journal_replay(read_journal(fx.spark, path)))


@query("journal_next_seq", "SELECT file, max(seq) + 1 AS next_seq FROM fx_journal WHERE NOT (type = 'P' AND name = 'stale') GROUP BY file", ["fx_journal"])
def _(fx):
    return J.journal_next_seq(fx.journal)


@query("journal_crash_loop", "SELECT file, seq, state, crashes, quarantined, inflight FROM fx_opened", ["fx_opened"])
def _(fx):
    return J.journal_crash_loop(J.journal_replay(fx.journal)).select("file", "seq", "state", "crashes", "quarantined", "inflight")


def _opened(fx):
    return J.journal_crash_loop(J.journal_replay(fx.journal))


NOW = 3_000_000


@query("journal_recover", f"""
SELECT file, seq, name, payload, opts.priority AS priority, opts.timeout_ms AS timeout_ms, CASE WHEN opts.due_ms IS NOT NULL THEN greatest(0, opts.due_ms - {NOW}) END AS due_in_ms, CASE WHEN state = 'suspect' THEN row_number() OVER (PARTITION BY file, state ORDER BY seq) ELSE 0 END AS turn
FROM fx_opened WHERE state IN ('pending', 'suspect')""", ["fx_opened"])
def _(fx):
    return J.journal_recover(pin(_opened(fx), "opened"), now_ms=NOW).withColumn("payload", F.col("payload").cast("string"))


@query("journal_pending", "SELECT file, seq, name FROM fx_state WHERE NOT done AND NOT quarantined", ["fx_state"])
def _(fx):
    return J.journal_pending(fx.journal)


COMPACT = """SELECT file, pos, type, seq, name, k, payload, {o} FROM (
SELECT file, seq * 8 AS pos, 'P' AS type, seq, name, CAST(NULL AS BIGINT) AS k, payload, CAST(NULL AS STRUCT(priority INT, timeout_ms BIGINT, due_ms BIGINT, flags INT)) AS opts FROM {t} WHERE {w}
UNION ALL SELECT file, seq * 8 + 1, 'O', seq, NULL, NULL, NULL, opts FROM {t} WHERE {w} AND opts.flags > 0
UNION ALL SELECT file, seq * 8 + 2, 'K', seq, NULL, crashes, NULL, NULL FROM {t} WHERE {w} AND crashes > 0
UNION ALL SELECT file, seq * 8 + 3, 'S', seq, NULL, NULL, NULL, NULL FROM {t} WHERE {w} AND inflight
UNION ALL SELECT file, seq * 8 + 4, 'Q', seq, NULL, NULL, NULL, NULL FROM {t} WHERE {w} AND quarantined)""".replace("{o}", OPTS)


@query("journal_compact", COMPACT.format(t="fx_opened", w="NOT done"), ["fx_opened"])
def _(fx):
    return plain(J.journal_compact(_opened(fx)))


def _records(fx):
    numbered = ordinal(fx.items.select("handle", (F.col("handle") % 4).alias("f")), ["f"], ["handle"], "seq", rows=fx.table("orders").count())
    return numbered.select(F.concat(F.lit("j"), F.col("f").cast("string")).alias("file"), "seq", "handle")


RECORDS = "SELECT 'j' || (handle % 4) AS file, row_number() OVER (PARTITION BY handle % 4 ORDER BY handle) AS seq, handle FROM fx_items"
MARKS = f"""rec AS ({RECORDS}),
mk AS (SELECT file, seq, handle, type, ts_ms FROM rec JOIN (
  SELECT handle, 'S' AS type, started_ms AS ts_ms FROM fx_attempts
  UNION ALL SELECT handle, 'F', ended_ms FROM fx_attempts WHERE status <> 'OK'
  UNION ALL SELECT handle, CASE kind WHEN 'DEAD_LETTERED' THEN 'Q' ELSE 'D' END, ts_ms FROM fx_lifecycle WHERE kind = 'FINISHED' OR kind IN ('DROPPED','DEAD_LETTERED') AND handle % 9 <> 2
  UNION ALL SELECT handle, 'D', ended_ms FROM fx_attempts WHERE status = 'CANCELLED' AND handle % 4 = 1) USING (handle))"""


@query("journal_apply_events", f"WITH {MARKS} SELECT * FROM mk", ["fx_items", "fx_attempts", "fx_lifecycle"])
def _(fx):
    return J.journal_apply_events(_records(fx), fx.lifecycle)


@query("journal_retract", f"""
WITH {MARKS}, gone AS (SELECT r.file, r.seq FROM rec r JOIN fx_items i USING (handle) WHERE i.due_ms IS NULL)
SELECT file, seq, type FROM mk WHERE type IN ('D','Q') AND (file, seq) NOT IN (SELECT (file, seq) FROM gone) UNION ALL SELECT file, seq, 'D' FROM gone""",
       ["fx_items", "fx_attempts", "fx_lifecycle"])
def _(fx):
    gone = _records(fx).join(fx.items.where("due_ms is null").select("handle"), "handle", "left_semi")
    return J.journal_retract(J.journal_apply_events(_records(fx), fx.lifecycle), gone)


@query("quarantine_drain", f"""
SELECT 'drained' AS out, file, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS type, seq, name, crashes AS k, payload, {OPTS} FROM fx_opened WHERE quarantined AND NOT done
UNION ALL SELECT 'journal', * FROM ({COMPACT.format(t='fx_opened', w='NOT done AND NOT quarantined')})""", ["fx_opened"])
def _(fx):
    drained, rest = J.quarantine_drain(pin(_opened(fx), "opened"))
    out = drained.select(F.lit("drained").alias("out"), "file", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("type"),
                         "seq", "name", F.col("crashes").alias("k"), "payload", "opts")
    return plain(out.unionByName(J.journal_compact(rest).withColumn("out", F.lit("journal"))))
