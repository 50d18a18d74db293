"""Schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# The life-cycle event kinds, in the order a work item meets them.
KINDS = ["QUEUED", "STARTED", "FINISHED", "FAILED", "RETRIED", "DEAD_LETTERED", "DROPPED", "SAMPLE"]
PROBLEM_KINDS = ["FAILED", "RETRIED", "DEAD_LETTERED", "DROPPED"]
ACTIVITY_KINDS = ["QUEUED", "STARTED", "FINISHED"]

# Status names and the text reports show for them.
STATUS_TEXT = {
    "OK": "ok",
    "NOMEM": "out of memory",
    "INVAL": "invalid argument",
    "NOTFOUND": "task not found",
    "DUP": "task already registered",
    "BUDGET": "declared cost cannot fit the budget",
    "FULL": "queue full",
    "TIMEOUT": "task timed out",
    "CANCELLED": "task cancelled",
    "ABI": "add-on ABI mismatch",
    "CONFIG": "config error",
    "IO": "I/O error",
    "TASK": "task error",
    "SHUTDOWN": "engine shutting down",
    "DENIED": "admission denied by a constraint",
    "BUSY": "busy: refused rather than wait (work is outstanding, or the wait would need the calling thread)",
}
UNKNOWN_STATUS_TEXT = "unknown error"

# Event flags, limits and sizes.
FLAG_SHUTDOWN = 1
FLAG_SELF_CANCELLED = 2
U64_MAX = 18446744073709551615
MIB = 1048576
NAME_MAX = 64
MEASURE_ROWS = 32
METHOD_KEEP = 47
TASK_ROWS = 64
WHY_SCAN = 512
DUE_MAX = 1 << 62
AGING_MAX = 1 << 61
FAIR_SCALE = 1 << 20
DEAD_CAP = 1024
REQUEUE_FLOOR_MS = 100
RETRY_NEVER = 4294967295
SUSPECT_AT = 2
QUARANTINE_AT = 3
HIST_BUCKETS = 32
VALUE_MAX = 256

TOTAL = "(total)"
OTHER = "(other)"

MEASURE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.DecimalType(20, 0)),
    T.StructField("unit", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("method", T.StringType()),
])

LIFECYCLE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("handle", T.LongType()),
    T.StructField("task", T.StringType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("mem_bytes", T.LongType()),
    T.StructField("flags", T.IntegerType()),
    T.StructField("measures", T.ArrayType(MEASURE)),
    T.StructField("stderr_tail", T.StringType()),
    T.StructField("result", T.BinaryType()),
    T.StructField("arrival", T.LongType()),
    T.StructField("shard", T.StringType()),
])

OPTIONS = T.StructType([
    T.StructField("priority", T.IntegerType()),
    T.StructField("timeout_ms", T.LongType()),
    T.StructField("due_ms", T.LongType()),
    T.StructField("flags", T.IntegerType()),
])

JOURNAL = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("k", T.LongType()),
    T.StructField("opts", OPTIONS),
])
JOURNAL_TYPES = ["P", "D", "Q", "S", "F", "K", "O"]

CONFIG_KV = T.StructType([
    T.StructField("entity", T.LongType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("line", T.LongType()),
])
