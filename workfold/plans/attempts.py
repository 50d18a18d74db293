"""The attempt pivot: one row per (handle, attempt) with its stamps. Most operators start here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workfold.functions.exprs import terminal
from workfold.plans.pin import pin
from workfold.plans.running import BEFORE, UPTO, running

QUEUING = ["QUEUED", "RETRIED"]
ENDING = ["FINISHED", "FAILED"]
PIVOTED = ["task", "kind", "status", "attempt", "ts_ms", "arrival"]  # what the pivot reads besides its keys


def event_phase():
    """Order of events that share a stamp: queued or retried, started, ended, disposed of."""
    return (F.when(F.col("kind").isin(*QUEUING), 0).when(F.col("kind") == "STARTED", 1)
            .when(F.col("kind").isin(*ENDING), 2).otherwise(3))


def with_cycle(lifecycle: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Number the requeue cycles of a handle: a STARTED with attempt <= 1 opens the next one.

    Adds ``cycle`` (1 before the first start) and ``base_ms``, the latest QUEUED or RETRIED of the
    handle before an event: what the wait of a start is measured from that a requeue opened.
    """
    opens = opens_cycle().cast("long")
    queued = F.when(F.col("kind").isin(*QUEUING), F.col("ts_ms"))
    # A RETRIED belongs after the failure it answers, and the queued event before the first start.
    keyed = lifecycle.withColumn("_phase", event_phase())
    out = running(keyed, keys or ["handle"], ["ts_ms", "attempt", "_phase", "arrival"], {
        "cycle": ("sum", opens, UPTO),
        "base_ms": ("max", queued, BEFORE),
    })
    return out.withColumn("cycle", F.greatest(F.lit(1).cast("long"), "cycle")).drop("_phase")


def cycled(lifecycle: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The log with its cycles numbered; a log that brings ``cycle`` is left as it is.

    Only items that started anew are ordered. Who they are is counted and written first, so the plan
    knows how few they are; the other events are in cycle 1, as are all where there is none.
    """
    if "cycle" in lifecycle.columns:
        return lifecycle
    keys = keys or ["handle"]
    starts = lifecycle.where(opens_cycle())
    again = pin(starts.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys), "requeued")
    first = {"cycle": F.lit(1).cast("long"), "base_ms": F.lit(None).cast("long")}
    if again.isEmpty():
        return lifecycle.withColumns(first)
    numbered = with_cycle(lifecycle.join(again, keys, "left_semi"), keys)
    return numbered.unionByName(lifecycle.join(again, keys, "left_anti").withColumns(first))


def opens_cycle():
    return (F.col("kind") == "STARTED") & (F.col("attempt") <= 1)


def unless_requeued(totals: DataFrame, otherwise) -> DataFrame:
    """Totals that count requeued items as ``_again``, computed once; ``otherwise()`` where there are any.

    The few rows are written, so where nothing was requeued, as in most logs, one pass over the log is all.
    """
    done = pin(totals, "totals")
    return otherwise() if done.where("_again > 0").limit(1).count() else done.drop("_again")


def attempt_pivot(lifecycle: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per attempt and cycle: queued_ms, base_ms, started_ms, ended_ms, closed_ms, finished, cancelled.

    ``keys`` names the identity of an item besides its task and cycle, by default its handle; add
    'shard' for a union of logs. ``base_ms`` is the handle's latest queuing before a start that a
    requeue opened. Conditional minima only, so a hot handle is reduced before the shuffle.
    """
    keys = [k for k in keys or ["handle"] if k != "cycle"]
    if "cycle" in lifecycle.columns:
        return _pivot(lifecycle, keys).drop("opened")
    # The log is folded as if nothing was requeued; only items that started anew are ordered and folded again.
    log = lifecycle.select(*dict.fromkeys([*keys, *PIVOTED]))
    once = pin(pivot_once(log, keys), "pivot")
    again = pin(once.groupBy(*keys).agg(F.sum("opened").alias("n")).where("n > 1").select(*keys), "requeued")
    if again.isEmpty():
        return once.drop("opened")
    numbered = _pivot(with_cycle(log.join(again, keys, "left_semi"), keys), keys)
    return once.join(again, keys, "left_anti").unionByName(numbered).drop("opened")


def _pivot(lifecycle: DataFrame, keys: list[str]) -> DataFrame:
    kind = F.col("kind")
    base = F.when((F.col("attempt") <= 1) & (F.col("cycle") > 1), F.col("base_ms")) if "base_ms" in lifecycle.columns else F.lit(None).cast("long")
    return lifecycle.groupBy(*keys, "cycle", "task", F.greatest("attempt", F.lit(1)).alias("attempt")).agg(
        F.min(F.when(kind == "STARTED", base)).alias("base_ms"),
        F.min(F.when(kind.isin(*QUEUING), F.col("ts_ms"))).alias("queued_ms"),
        F.min(F.when(kind == "STARTED", F.col("ts_ms"))).alias("started_ms"),
        F.min(F.when(kind.isin(*ENDING), F.col("ts_ms"))).alias("ended_ms"),
        F.min(F.when(terminal(), F.col("ts_ms"))).alias("closed_ms"),
        F.max(kind == "FINISHED").alias("finished"),
        F.max((kind == "FAILED") & (F.col("status") == "CANCELLED")).alias("cancelled"),
        F.count_if(opens_cycle()).alias("opened"),
    )


def pivot_once(lifecycle: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The pivot of a log taken as free of requeues; an attempt ``opened`` more than once says that it is not."""
    first = {"cycle": F.lit(1).cast("long"), "base_ms": F.lit(None).cast("long")}
    return _pivot(lifecycle.withColumns(first), [k for k in keys or ["handle"] if k != "cycle"])


def wait_ms(since=None):
    """Wait of a pivot row: an inverted pair of stamps counts as 0. A requeue has no queuing event of its
    own, so with ``since`` (see ``queuing``) its wait runs from the latest one before."""
    since = F.col("queued_ms") if since is None else since
    return F.when(F.col("started_ms").isNotNull() & since.isNotNull(),
                  F.greatest(F.lit(0).cast("long"), F.col("started_ms") - since))


def queuing():
    return F.coalesce("queued_ms", "base_ms")


def run_ms():
    """Run time of a pivot row: an inverted pair of stamps gives none."""
    return F.when(F.col("ended_ms") >= F.col("started_ms"), F.col("ended_ms") - F.col("started_ms"))


def reached(lifecycle: DataFrame):
    """How far an event takes its item, as one number: cycle, attempt, then queued, started or ended."""
    cycle = F.col("cycle") if "cycle" in lifecycle.columns else F.lit(1).cast("long")
    phase = F.when(F.col("kind").isin(*QUEUING), 0).when(F.col("kind") == "STARTED", 1).otherwise(2)
    at = cycle * F.lit(1 << 34) + F.greatest("attempt", F.lit(1)).cast("long") * 4 + phase
    return F.when(F.col("kind") != "SAMPLE", at)


def state_of_handle(lifecycle: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Where each item stands at the end of the log: pending, in_flight, limbo or over.

    The furthest (cycle, attempt, phase) reached decides, so arrival order does not matter and
    a late RETRIED moves nothing.
    """
    keys = keys or ["handle"]
    return state_once(cycled(lifecycle, keys), keys).drop("opened")


def state_once(lifecycle: DataFrame, keys: list[str]) -> DataFrame:
    """The same of a log with its cycles, or of one taken as free of requeues; ``opened`` counts the first starts."""
    per = lifecycle.where(F.col("kind") != "SAMPLE").groupBy(*keys, "task").agg(
        F.max(reached(lifecycle)).alias("reached"), F.max(terminal()).alias("over"), F.count_if(opens_cycle()).alias("opened"),
    )
    at = F.col("reached") % 4
    state = (F.when(F.col("over"), "over").when(at == 1, "in_flight").when(at == 0, "pending").otherwise("limbo"))
    return per.select(*keys, "task", state.alias("state"), "opened")
