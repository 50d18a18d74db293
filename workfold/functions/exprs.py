"""Column expressions the operators are built from. All native, no Python in the hot path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from workfold import model as M

U64 = "decimal(38,0)"


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def saturate(c) -> Column:
    """An unsigned 64-bit value that stays at its largest instead of wrapping."""
    return F.least(col(c).cast(U64), F.lit(str(M.U64_MAX)).cast(U64))


def point(ts="ts_ms", arrival="arrival") -> Column:
    """Stamp and arrival as one number: orders events, and hash aggregation can hold it in place."""
    return (col(ts).cast("decimal(19,0)") * F.lit("10000000000000000000").cast("decimal(20,0)") + col(arrival)).cast(U64)


def code_of(name, names: list[str]) -> Column:
    """Position of a name in a fixed list (0: not in it), for aggregates that cannot hold text in place."""
    return F.array_position(F.array(*[F.lit(n) for n in names]), col(name))


def name_of(code, names: list[str]) -> Column:
    return F.when(col(code) > 0, F.element_at(F.array(*[F.lit(n) for n in names]), col(code).cast("int")))


def terminal(kind="kind", status="status") -> Column:
    """The event ends the item: a plain FAILED only ends one attempt."""
    kind, status = col(kind), col(status)
    return kind.isin("FINISHED", "DROPPED", "DEAD_LETTERED") | ((kind == "FAILED") & (status == "CANCELLED"))


def event_class(kind="kind") -> Column:
    kind = col(kind)
    return (
        F.when(kind.isin(*M.PROBLEM_KINDS), F.lit("problem"))
        .when(kind.isin(*M.ACTIVITY_KINDS), F.lit("activity"))
    )


def status_text(status="status") -> Column:
    pairs = [F.lit(x) for item in M.STATUS_TEXT.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(status)), F.lit(M.UNKNOWN_STATUS_TEXT))


def has_flag(bit: int, flags="flags") -> Column:
    return F.coalesce(col(flags), F.lit(0)).bitwiseAND(F.lit(bit)) != 0


def measure(name: str, measures="measures") -> Column:
    """Value of a named measurement on an event; NULL when absent, 0 is a real value."""
    return F.get(F.filter(col(measures), lambda m: m["name"] == name), F.lit(0))["value"]


def measure_method(name: str, measures="measures") -> Column:
    return F.get(F.filter(col(measures), lambda m: m["name"] == name), F.lit(0))["method"]


def last_line(tail, keep: int | None = None) -> Column:
    """Last non-blank line of an error tail (of its last ``keep`` characters); '' when there is none."""
    seen = F.coalesce(col(tail), F.lit(""))
    seen = seen if keep is None else F.right(seen, F.lit(keep))
    return F.substring_index(F.regexp_replace(seen, r"[ \r\n]+$", ""), "\n", -1)


def why(start_error, exit_code, exit_signal, status, tail, keep: int | None = None) -> Column:
    """Why an attempt failed, in one line."""
    head = F.coalesce(
        F.concat(F.lit("not started (error "), col(start_error).cast("string"), F.lit(")")),
        F.concat(F.lit("exit "), col(exit_code).cast("string")),
        F.concat(F.lit("signal "), col(exit_signal).cast("string")),
        status_text(status),
    )
    line = last_line(tail, keep)
    return F.when(line == "", head).otherwise(F.concat(head, F.lit(" · "), line))


def log2_bucket(ms) -> Column:
    """0 for 0, b for [2^(b-1), 2^b), 31 for everything above."""
    ms = col(ms)
    return F.when(ms <= 0, F.lit(0)).otherwise(F.least(F.lit(M.HIST_BUCKETS - 1), F.length(F.bin(ms)))).cast("int")


def bucket_upper(bucket) -> Column:
    """Exclusive upper bound of a bucket; NULL for the open one."""
    bucket = col(bucket)
    return (
        F.when(bucket == 0, F.lit(0))
        .when(bucket < M.HIST_BUCKETS - 1, F.call_function("shiftleft", F.lit(1).cast("long"), bucket))
        .cast("long")
    )


def plus_pct(x, pct) -> Column:
    """x grown by pct percent, rounded down, saturating."""
    grown = col(x).cast("decimal(20,0)") * (col(pct) if isinstance(pct, (str, Column)) else F.lit(100 + pct)).cast("decimal(10,0)")
    return saturate(F.floor(grown / F.lit(100).cast("decimal(3,0)")))


def round_mib(x) -> Column:
    """Up to whole MiB, saturating."""
    x = col(x).cast("decimal(30,0)")
    return saturate(F.ceil(x / F.lit(M.MIB).cast("decimal(7,0)")).cast("decimal(30,0)") * F.lit(M.MIB).cast("decimal(7,0)"))


def due(enqueue_ms, deadline_in_ms) -> Column:
    """When an item is due; NULL without a deadline, and a stamp of 0 is stored as 1."""
    total = col(enqueue_ms).cast(U64) + col(deadline_in_ms).cast(U64)
    at = F.greatest(F.lit(1).cast("long"), F.least(total, F.lit(2**63 - 1).cast(U64)).cast("long"))
    return F.when(col(deadline_in_ms).isNotNull(), at)


def remaining(due_ms, now_ms) -> Column:
    """What is left until due, never below 0; NULL without a due time."""
    return F.when(col(due_ms).isNotNull(), F.greatest(F.lit(0).cast("long"), col(due_ms) - col(now_ms)))


def shard_of(key, shards: int) -> Column:
    """Keyed routing of an unsigned key held in a LONG: keys from 2^63 read as negative."""
    key = col(key)
    unsigned = F.when(key < 0, key.cast(U64) + F.lit(str(2**64)).cast(U64)).otherwise(key.cast(U64))
    return (unsigned % F.lit(shards).cast(U64)).cast("int")


def pack_id(shard, handle) -> Column:
    return F.call_function("shiftleft", col(shard).cast("long"), F.lit(48)).bitwiseOR(col(handle))


def unpack_shard(packed) -> Column:
    return F.call_function("shiftrightunsigned", col(packed), F.lit(48)).cast("int")


def unpack_handle(packed) -> Column:
    return col(packed).bitwiseAND(F.lit((1 << 48) - 1).cast("long"))


def combine_verdicts(verdicts: list[Column], delays: list[Column]) -> tuple[Column, Column]:
    """Several rules' verdicts on one row: any DENY wins, else the longest DEFER, else ADMIT."""
    denied = reduce(lambda a, b: a | b, [v == "DENY" for v in verdicts])
    deferred = reduce(lambda a, b: a | b, [v == "DEFER" for v in verdicts])
    waits = [F.when(v == "DEFER", F.coalesce(d, F.lit(0)).cast("long")).otherwise(F.lit(0).cast("long"))
             for v, d in zip(verdicts, delays)]
    longest = F.greatest(F.lit(1).cast("long"), *waits)
    verdict = F.when(denied, F.lit("DENY")).when(deferred, F.lit("DEFER")).otherwise(F.lit("ADMIT"))
    return verdict, F.when(~denied & deferred, longest).otherwise(F.lit(0).cast("long"))
