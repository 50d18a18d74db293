"""Reading event logs and journals, and writing snapshots and dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workfold import model as M


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``: missing ones NULL, others dropped."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def zero_as_unset(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULL instead of 0 where 0 means "not set" or "no limit" (which differs by key)."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns})


def known_events(df: DataFrame) -> DataFrame:
    """Events of the known kinds in the canonical columns; kinds a later writer added are ignored."""
    return conform(df.where(F.col("kind").isin(*M.KINDS)), M.LIFECYCLE)


def read_lifecycle(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A log in one folder or file. The schema is given, so files without trailing fields read as NULL."""
    return known_events(spark.read.schema(M.LIFECYCLE).format(fmt).load(path))


def stream_lifecycle(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """The same log as a stream of files."""
    reader = spark.readStream.schema(M.LIFECYCLE).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return known_events(reader.load(path))


def read_journal(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Journal records of any number of files; types a later writer added are skipped."""
    df = spark.read.schema(M.JOURNAL).format(fmt).load(path)
    return df.where(F.col("type").isin(*M.JOURNAL_TYPES))


def read_config(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Settings as (entity, key, value, kind, line) rows."""
    return spark.read.schema(M.CONFIG_KV).format(fmt).load(path)


def write_snapshot(totals: DataFrame, measures: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Counters per task and in total, and measurement rows, as two tables."""
    totals.write.mode(mode).parquet(f"{path}/counters")
    measures.write.mode(mode).parquet(f"{path}/measures")


def dead_letters(lifecycle: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Each dead letter with the error tail and measurements of the failure it answers.

    That is the newest failure of its handle and attempt up to its own stamp, so a handle that died
    twice gives two rows. ``items`` (handle, and any of priority, timeout_ms, due_ms, payload) adds what
    a re-drive submits again, with ``due_in_ms``: what was left until due, never below 0.
    """
    dead = lifecycle.where(F.col("kind") == "DEAD_LETTERED").select(
        "handle", "task", F.col("ts_ms").alias("dead_ms"), "status", F.col("attempt").alias("attempts"), "mem_bytes", "arrival")
    failed = lifecycle.where(F.col("kind") == "FAILED").select(
        "handle", F.col("attempt").alias("attempts"), F.col("ts_ms").alias("_ts"), F.col("arrival").alias("_at"), "stderr_tail", "measures")
    answered = dead.select("handle", "attempts", "dead_ms", "arrival").join(failed, ["handle", "attempts"]).where("_ts <= dead_ms")
    newest = answered.groupBy("handle", "dead_ms", "arrival").agg(
        F.max_by(F.struct("stderr_tail", "measures"), F.struct("_ts", "_at")).alias("_f"))
    letters = dead.join(newest, ["handle", "dead_ms", "arrival"], "left").select(
        "handle", "task", "dead_ms", "status", "attempts", "mem_bytes", "_f.stderr_tail", "_f.measures")
    if items is None:
        return letters
    options = [c for c in ("priority", "timeout_ms", "due_ms", "payload") if c in items.columns]
    out = letters.join(items.select("handle", *options), "handle", "left")
    if "due_ms" in options:
        left = F.greatest(F.lit(0).cast("long"), F.col("due_ms") - F.col("dead_ms"))
        out = out.withColumn("due_in_ms", F.when(F.col("due_ms").isNotNull(), left)).drop("due_ms")
    return out


def write_dead_letters(letters: DataFrame, path: str, mode: str = "append") -> None:
    """Retained dead letters, one folder per task."""
    letters.write.mode(mode).partitionBy("task").parquet(path)
