"""What a failure leads to: dispositions, retry rules, re-drives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workfold import model as M
from workfold.functions.exprs import remaining
from workfold.operators.joins import rule_lookup


def with_policy(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Each row with its task's policy, else the policy for any task (task NULL)."""
    names = ["max_retries", "backoff_s", "on_failure"]
    own = policies.where("task is not null").select("task", F.struct(*names).alias("_own"))
    general = policies.where("task is null").agg(F.max(F.struct(*names)).alias("_any"))
    fallback = general.select("_any").scalar()  # one row at most
    return rows.join(own, "task", "left").withColumn("_p", F.coalesce("_own", fallback)).select(
        *rows.columns, *[F.col(f"_p.{n}").alias(n) for n in names])


def failure_disposition(failures: DataFrame, policies: DataFrame) -> DataFrame:
    """What each failed attempt leads to, with the next attempt and when it is due.

    ``failures`` holds handle, task, attempt, ts_ms and status.
    """
    rows = with_policy(failures, policies)
    ended = F.col("status") == "CANCELLED"
    retry = F.col("attempt") <= F.col("max_retries")
    step = (F.when(ended, "CANCELLED").when(retry, "RETRIED").when(F.col("on_failure") == "requeue", "REQUEUED")
            .when(F.col("on_failure") == "drop", "DROPPED").otherwise("DEAD_LETTERED"))
    backoff = F.col("backoff_s").cast("long") * 1000
    due = (F.when(step == "RETRIED", F.col("ts_ms") + backoff)
           .when(step == "REQUEUED", F.col("ts_ms") + F.greatest(backoff, F.lit(M.REQUEUE_FLOOR_MS))))
    following = F.when(step == "RETRIED", F.col("attempt") + 1).when(step == "REQUEUED", F.lit(1))
    return rows.select(*failures.columns, step.alias("step"), following.cast("int").alias("next_attempt"), due.alias("due_ms"))


def retry_decision(failures: DataFrame, policies: DataFrame, rules: DataFrame) -> DataFrame:
    """The same with exit-code rules on top.

    NEVER turns the attempt that would follow into a DENIED dead letter (its RETRIED, if it is a
    retry, still comes first and names that attempt); a wait is added after the backoff; 0 or no
    rule leaves the policy as it is. A rule never adds a retry.
    """
    judged = rule_lookup(failure_disposition(failures, policies), rules)
    goes_on = F.col("step").isin("RETRIED", "REQUEUED")
    never = goes_on & (F.col("wait_ms") == M.RETRY_NEVER)
    waits = goes_on & (F.col("wait_ms") > 0) & ~never
    return judged.withColumns({
        "denied": F.coalesce(never, F.lit(False)),
        "due_ms": F.when(waits, F.col("due_ms") + F.col("wait_ms")).otherwise(F.col("due_ms")),
        "final": (F.when(never, "DEAD_LETTERED").when(goes_on, F.lit(None)).otherwise(F.col("step"))),
        "final_status": F.when(never, "DENIED").when(goes_on, F.lit(None)).otherwise(F.col("status")),
    })


def redrive_plan(ledger_rows: DataFrame, dead_letters: DataFrame, bound: int, now_ms: int, drop_late: bool = False) -> DataFrame:
    """Dead letters to submit again, at most ``bound`` times per business id, with what is left of their due time.

    ``dead_letters`` is what ``sources.lifecycle.dead_letters(log, items)`` gives (or any rows with handle and
    due_ms); priority, timeout_ms and payload go along where they are there. A dead letter of a superseded
    handle matches no ledger row and is left alone.
    """
    if "due_ms" not in dead_letters.columns:  # what was left when the item died
        dead_letters = dead_letters.withColumn("due_ms", F.col("dead_ms") + F.col("due_in_ms"))
    rows = dead_letters.join(ledger_rows.select("business_id", "handle", "rounds"), "handle")
    options = [c for c in ("priority", "timeout_ms", "payload") if c in dead_letters.columns]
    left = remaining("due_ms", F.lit(now_ms))
    late = F.coalesce(F.col("due_ms") < now_ms, F.lit(False))
    plan = (F.when(F.col("rounds") >= bound, "declined").when(F.lit(drop_late) & late, "late").otherwise("resubmit"))
    return rows.select("business_id", "handle", "rounds", *options, F.when(plan == "resubmit", left).alias("due_in_ms"), plan.alias("plan"))
