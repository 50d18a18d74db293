"""A journal of records and markers folded into current state, and back into a shorter journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workfold import model as M
from workfold.functions.exprs import has_flag, point, remaining
from workfold.operators.validation import journal_judged, judged_submits
from workfold.plans.running import UPTO, running

KEY = ["file", "seq"]
OPTS = ["priority", "timeout_ms", "due_ms", "flags"]


def _with_opts(journal: DataFrame) -> DataFrame:
    for name, kind in (("payload", "binary"), ("opts", M.OPTIONS)):
        if name not in journal.columns:
            journal = journal.withColumn(name, F.lit(None).cast(kind))
    return journal


def journal_replay(journal: DataFrame) -> DataFrame:
    """State of every record: done, quarantined, inflight, crashes and last options.

    Each fact is the last marker of its kind after the record itself, so one hash aggregation
    over the markers does it; a record with most of the markers is folded before the shuffle.
    """
    journal = _with_opts(journal)
    # Only submissions are ordered; a marker is valid by itself.
    records = judged_submits(journal).where("damage is null").select("file", "seq", "pos", "name", "payload")
    kind, pos = F.col("type"), F.col("pos")

    def last(types, value):
        hit = kind.isin(*types)
        return F.max_by(value, F.when(hit, pos)), F.max(F.when(hit, pos))

    moves, moved = last(["S", "F"], (kind == "S").cast("int"))
    counts, counted = last(["K", "F"], F.when(kind == "K", F.col("k")).otherwise(F.lit(0)))
    marks = journal.where((kind != "P") & (F.col("seq") >= 0)).groupBy(*KEY).agg(
        F.max(F.when(kind == "D", pos)).alias("_d"), F.max(F.when(kind == "Q", pos)).alias("_q"),
        moves.alias("_move"), moved.alias("_moved"), counts.alias("_count"), counted.alias("_counted"),
        F.max(F.when(kind == "O", pos)).alias("_o"),
        *[F.max_by(F.col(f"opts.{o}"), F.when(kind == "O", pos)).alias(f"_{o}") for o in OPTS])

    def after(mark):
        return F.coalesce(F.col(mark) > F.col("pos"), F.lit(False))

    opts = F.when(after("_o"), F.struct(*[F.col(f"_{o}").alias(o) for o in OPTS]))
    return records.join(marks, KEY, "left").select(
        "file", "seq", "name", "payload",
        after("_d").alias("done"), after("_q").alias("quarantined"),
        F.coalesce(F.when(after("_moved"), F.col("_move") == 1), F.lit(False)).alias("inflight"),
        F.coalesce(F.when(after("_counted"), F.col("_count")), F.lit(0)).cast("long").alias("crashes"),
        opts.alias("opts"))


def journal_next_seq(journal: DataFrame) -> DataFrame:
    """The seq each file's next record gets."""
    return journal_judged(journal).where("damage is null").groupBy("file").agg((F.max("seq") + 1).alias("next_seq"))


def journal_crash_loop(state: DataFrame) -> DataFrame:
    """What becomes of each record when the journal is opened after the process died.

    ``state`` is one of done, quarantined, crash-quarantined, suspect or pending.
    """
    over = F.col("done") | F.col("quarantined")
    crashes = F.col("crashes") + F.when(~over & F.col("inflight"), 1).otherwise(0)
    opened = state.withColumns({"crashes": crashes, "inflight": F.col("inflight") & over})
    at = F.col("crashes")
    verdict = (F.when(F.col("done"), "done").when(F.col("quarantined"), "quarantined")
               .when(at >= M.QUARANTINE_AT, "crash-quarantined").when(at >= M.SUSPECT_AT, "suspect").otherwise("pending"))
    judged = opened.withColumn("state", verdict)
    return judged.withColumn("quarantined", F.col("quarantined") | (F.col("state") == "crash-quarantined"))


def journal_recover(opened: DataFrame, now_ms: int) -> DataFrame:
    """Records to run again. Suspects take turns one at a time (``turn`` 1, 2, ..); the others are 0."""
    back = opened.where(F.col("state").isin("pending", "suspect"))
    suspect = F.col("state") == "suspect"
    numbered = running(back, ["file"], ["seq"], {"_nth": ("sum", suspect.cast("long"), UPTO)})
    return numbered.select(
        "file", "seq", "name", "payload", F.when(suspect, F.col("_nth")).otherwise(F.lit(0)).alias("turn"),
        F.col("opts.priority").alias("priority"), F.col("opts.timeout_ms").alias("timeout_ms"),
        remaining("opts.due_ms", F.lit(now_ms)).alias("due_in_ms"))


def journal_pending(journal: DataFrame) -> DataFrame:
    """Submitted, except closed, except quarantined."""
    return journal_replay(journal).where("not done and not quarantined").select("file", "seq", "name")


def journal_compact(state: DataFrame) -> DataFrame:
    """The shortest journal that replays to ``state``: done records dropped, the rest as P, O, K, S, Q."""
    def rec(place, kind, k=None, opts=None):
        return F.struct(
            (F.col("seq") * 8 + place).alias("pos"), F.lit(kind).alias("type"),
            (F.lit(None) if k is None else k).cast("long").alias("k"),
            (F.lit(None).cast(M.OPTIONS) if opts is None else opts.cast(M.OPTIONS)).alias("opts"))

    records = F.array_compact(F.array(
        rec(0, "P"),
        F.when(F.coalesce(F.col("opts.flags"), F.lit(0)) != 0, rec(1, "O", None, F.col("opts"))),
        F.when(F.col("crashes") > 0, rec(2, "K", F.col("crashes"))),
        F.when(F.col("inflight"), rec(3, "S")),
        F.when(F.col("quarantined"), rec(4, "Q")),
    ))
    live = state.where(~F.col("done")).select("file", "seq", "name", "payload", F.inline(records))
    first = F.col("type") == "P"
    return live.select("file", "pos", "type", "seq", F.when(first, F.col("name")).alias("name"),
                       F.when(first, F.col("payload")).alias("payload"), "k", "opts")


def journal_apply_events(records: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """The markers a life-cycle log adds for open records (file, seq, handle).

    Each ends with its first verdict. What a shutdown imposed, and a cancel from outside, is no
    verdict: the record stays pending.
    """
    kind, status = F.col("kind"), F.col("status")
    failed = kind == "FAILED"
    closes = (F.when(kind == "FINISHED", "D")
              .when(failed & (status == "CANCELLED") & has_flag(M.FLAG_SELF_CANCELLED), "D")
              .when((kind == "DROPPED") & ~has_flag(M.FLAG_SHUTDOWN), "D")
              .when((kind == "DEAD_LETTERED") & ~has_flag(M.FLAG_SHUTDOWN), "Q"))
    log = lifecycle.where(kind.isin("STARTED", "FAILED", "FINISHED", "DROPPED", "DEAD_LETTERED")).withColumn("closes", closes)
    verdicts = log.groupBy("handle").agg(F.min(F.when(F.col("closes").isNotNull(), point())).alias("_until"))
    per_attempt = log.groupBy("handle", "attempt").agg(
        F.max(kind == "STARTED").alias("ran"),
        *[F.min(F.when(when, point())).alias(name) for name, when in (
            ("s", kind == "STARTED"), ("f", failed), ("d", F.col("closes") == "D"), ("q", F.col("closes") == "Q"))],
        *[F.min(F.when(when, F.col("ts_ms"))).alias(f"{name}_ms") for name, when in (
            ("s", kind == "STARTED"), ("f", failed), ("d", F.col("closes") == "D"), ("q", F.col("closes") == "Q"))])
    marks = per_attempt.select("handle", F.inline(F.array(
        F.struct(F.lit("S").alias("type"), F.col("s").alias("at"), F.col("s_ms").alias("ts_ms")),
        F.struct(F.lit("F").alias("type"), F.when(F.col("ran"), F.col("f")).alias("at"), F.col("f_ms").alias("ts_ms")),
        F.struct(F.lit("D").alias("type"), F.col("d").alias("at"), F.col("d_ms").alias("ts_ms")),
        F.struct(F.lit("Q").alias("type"), F.col("q").alias("at"), F.col("q_ms").alias("ts_ms")),
    ))).where("at is not null")
    open_marks = marks.join(verdicts, "handle").where(
        F.col("_until").isNull() | (F.col("at") <= F.col("_until")))
    return records.select("file", "seq", "handle").join(open_marks, "handle").select("file", "seq", "handle", "type", "ts_ms")


def journal_retract(markers: DataFrame, retractions: DataFrame) -> DataFrame:
    """Retracted records close as done whatever verdict comes later."""
    gone = retractions.select(*KEY).distinct()
    kept = markers.select(*KEY, "type").where(F.col("type").isin("D", "Q")).join(gone, KEY, "left_anti")
    return kept.unionByName(gone.withColumn("type", F.lit("D")))


def quarantine_drain(opened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The quarantined records handed back, and the state with them done and the rest unchanged."""
    drained = opened.where(F.col("quarantined") & ~F.col("done"))
    return drained, opened.withColumn("done", F.col("done") | F.col("quarantined"))
