"""Screening work and checking rule-driven tables and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workfold import model as M
from workfold.functions.exprs import U64, has_flag, terminal
from workfold.plans.running import BEFORE, running
from workfold.plans.short import rule_table


def _over_budget(task_costs: DataFrame, resources: DataFrame) -> DataFrame:
    """Tasks with a cost above the whole budget of its resource."""
    return task_costs.join(resources, "name").where(F.col("cost") > F.col("budget")).select("task").distinct()


def screen_submissions(items: DataFrame, tasks: DataFrame, task_costs: DataFrame, resources: DataFrame) -> DataFrame:
    """The first check each submission fails, or OK.

    ``tasks`` holds task, max_mem and paused. Items may bring ``cost_status``, the status of a
    cost function that failed on them.
    """
    known = tasks.select("task", "max_mem", "paused")
    broke = _over_budget(task_costs, resources).withColumn("_broke", F.lit(True))
    joined = items.join(known, "task", "left").join(broke, "task", "left")
    cost_failed = F.col("cost_status") if "cost_status" in items.columns else F.lit(None).cast("string")
    verdict = (
        F.when(F.col("paused").isNull() | F.col("paused"), "NOTFOUND")
        .when(cost_failed.isNotNull() & (cost_failed != "OK"), cost_failed)
        .when(F.col("mem_bytes") > F.col("max_mem"), "BUDGET")
        .when(F.col("_broke"), "BUDGET")
        .otherwise("OK"))
    return joined.select(*items.columns, verdict.alias("verdict"))


def never_fits(items: DataFrame, task_costs: DataFrame, resources: DataFrame, memory_bytes: int | None = None) -> DataFrame:
    """Queued items that can no longer run: their memory exceeds all of it, or a cost its whole budget."""
    broke = _over_budget(task_costs, resources).withColumn("_broke", F.lit(True))
    too_large = F.lit(False) if memory_bytes is None else F.coalesce(F.col("mem_bytes") > memory_bytes, F.lit(False))
    return items.join(broke, "task", "left").where(too_large | F.coalesce("_broke", F.lit(False))).select(*items.columns)


def shed_late(items: DataFrame, now_ms: int, grace_ms: int) -> DataFrame:
    """Refuse items more than a grace past due; without a due time nothing is late."""
    due = F.nullif("due_ms", F.lit(0).cast("long"))
    late = F.coalesce(F.lit(now_ms) - due > grace_ms, F.lit(False))
    return items.withColumn("verdict", F.when(late, "DENIED").otherwise("OK"))


def setting_problem(value: Column, rule) -> Column:
    """Why a value breaks its setting's rule, NULL when it does not. ``rule`` maps a rule column to a Column."""
    kind = rule("type")
    whole, number = value.rlike(r"^[+-]?[0-9]+$"), value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    big = value.try_cast(U64)
    real = value.try_cast("double")
    low, high = rule("min"), rule("max")

    def outside(x):
        return rule("has_range") & ((x < low) | (x > high))

    def bad_whole(lowest: int, highest: int):
        beyond = big.isNull() | (big < F.lit(str(lowest)).cast(U64)) | (big > F.lit(str(highest)).cast(U64))
        return (F.when(~whole, "not a number").when(beyond, "beyond its type")
                .when(outside(big.cast("double")), "out of range"))

    return (
        F.when(value.isNull() | (F.octet_length(value) >= M.VALUE_MAX), "too long")
        .when(kind == "INT", bad_whole(-(2**63), 2**63 - 1))
        .when(kind == "UINT", F.when(whole & value.startswith("-"), "negative").otherwise(bad_whole(0, M.U64_MAX)))
        .when(kind == "DOUBLE", F.when(~number, "not a number")
              .when(F.abs(real) == float("inf"), "beyond its type").when(outside(real), "out of range"))
        .when((kind == "BOOL") & ~value.isin("true", "false"), "not true or false")
        .when((kind == "ENUM") & ~F.coalesce(F.array_contains(F.split(rule("choices"), r"\|"), value), F.lit(False)), "not a choice")
    )


def validate_settings(values: DataFrame, schema: DataFrame) -> DataFrame:
    """Every value that has a rule, with what is wrong with it (NULL: nothing). All problems are reported."""
    joined = values.join(rule_table(schema), "key")
    return joined.select(*values.columns, setting_problem(F.col("value"), F.col).alias("problem"))


def audit_lifecycle(lifecycle: DataFrame, complete: bool = True, exempt_tasks: list[str] | None = None) -> DataFrame:
    """Where a log breaks the event contract: one row per handle and kind of violation.

    ``complete`` also reports items without a terminal event. Services and requeued types are
    exempt: name their tasks. Counts fold per attempt and then per handle; nothing is windowed.
    """
    log = lifecycle.where(F.col("kind") != "SAMPLE")
    if exempt_tasks:
        log = log.where(~F.col("task").isin(*exempt_tasks))
    kind, cancelled = F.col("kind"), (F.col("kind") == "FAILED") & (F.col("status") == "CANCELLED")
    attempt = F.greatest("attempt", F.lit(1))
    disposed = kind.isin("DEAD_LETTERED", "DROPPED")
    repeated = (F.size("measures") > F.size(F.array_distinct(F.transform("measures", lambda m: m["name"])))
                if "measures" in lifecycle.columns else F.lit(False))
    # A RETRIED names the next attempt: it also answers the failure of the one before.
    at = F.explode(F.when(kind == "RETRIED", F.array(attempt, attempt - 1)).otherwise(F.array(attempt)))
    rows = log.select(
        "handle", "kind", "status", "ts_ms", attempt.alias("own"), at.alias("attempt"),
        F.coalesce(has_flag(M.FLAG_SHUTDOWN) & ~disposed, F.lit(False)).alias("bad_flag"),
        F.coalesce(repeated, F.lit(False)).alias("repeated"))
    mine = F.col("own") == F.col("attempt")
    per_attempt = rows.groupBy("handle", "attempt").agg(
        F.min(F.when(kind == "STARTED", F.col("ts_ms"))).alias("started"),
        F.min(F.when(kind.isin("FINISHED", "FAILED"), F.col("ts_ms"))).alias("ended"),
        F.max(cancelled).alias("cancelled"), F.max((kind == "FAILED") & ~cancelled).alias("failed"),
        F.max(disposed | ((kind == "RETRIED") & ~mine)).alias("answered"),
        F.count_if(terminal() & mine).alias("terminals"), F.max(kind == "QUEUED").alias("queued"),
        F.count_if(F.col("bad_flag") & mine).alias("bad_flags"), F.count_if(F.col("repeated") & mine).alias("repeats"))
    unstarted = F.col("started").isNull()
    per_handle = per_attempt.groupBy("handle").agg(
        F.sum("terminals").alias("terminals"), F.max("queued").alias("queued"),
        F.count_if(F.col("ended") < F.col("started")).alias("early"),
        F.count_if(F.col("ended").isNotNull() & unstarted & ~F.col("cancelled")).alias("unstarted"),
        F.count_if(F.col("failed") & ~F.col("answered")).alias("unanswered"),
        F.count("started").alias("starts"),
        F.coalesce(F.max(F.when(~unstarted, F.col("attempt"))), F.lit(0)).alias("last"),
        F.sum("bad_flags").alias("bad_flags"), F.sum("repeats").alias("repeats"))

    def found(name, n):
        return F.struct(F.lit(name).alias("violation"), n.cast("long").alias("n"))

    checks = [
        F.when(F.col("terminals") > 1, found("many terminal events", F.col("terminals"))),
        F.when(F.col("early") > 0, found("ended before started", F.col("early"))),
        F.when(F.col("unstarted") > 0, found("ended without start", F.col("unstarted"))),
        F.when(F.col("unanswered") > 0, found("failure unanswered", F.col("unanswered"))),
        F.when(F.col("starts") != F.col("last"), found("attempt missing", F.col("last") - F.col("starts"))),
        F.when(F.col("bad_flags") > 0, found("shutdown flag misplaced", F.col("bad_flags"))),
        F.when(F.col("repeats") > 0, found("measure repeated", F.col("repeats"))),
    ]
    if complete:
        checks.append(F.when(F.col("queued") & (F.col("terminals") == 0), found("no terminal event", F.lit(1))))
    return per_handle.select("handle", F.inline(F.array_compact(F.array(*checks))))


def judged_submits(journal: DataFrame) -> DataFrame:
    """The 'P' records whose seq a LONG holds, with ``damage`` where it does not rise.

    A 'P' must exceed every valid 'P' before it in its file. An invalid one never exceeds the
    running maximum, so that maximum can run over all of them; a giant file is cut into cells.
    """
    submits = journal.where((F.col("type") == "P") & (F.col("seq") >= 0))
    run = running(submits, ["file"], ["pos"], {"_above": ("max", F.col("seq"), BEFORE)})
    stale = F.col("seq") <= F.coalesce(F.col("_above"), F.lit(0))
    return run.withColumn("damage", F.when(stale, "seq does not rise")).drop("_above")


def journal_judged(journal: DataFrame) -> DataFrame:
    """Journal records with ``damage``: NULL, or why no writer makes such a record."""
    seq_bad = F.col("seq") < 0  # above 2^63-1 reads as negative in a LONG
    rest = journal.where((F.col("type") != "P") | seq_bad).withColumn("damage", F.when(seq_bad, "seq too large"))
    return judged_submits(journal).unionByName(rest)


def journal_validate(journal: DataFrame) -> DataFrame:
    """The damaged records."""
    return journal_judged(journal).where("damage is not null").select("file", "pos", "type", "seq", "damage")
