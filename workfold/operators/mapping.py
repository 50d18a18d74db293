"""Running a user function over payloads so that a bad row never fails the job."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workfold.plans.pin import pin

# Executors need not have this package: its functions travel with the plan.
register_pickle_by_value(sys.modules[__name__])


def map_dead_letter(items: DataFrame, key: str, payload: str, fn: Callable, max_retries: int = 0, timeout_s: float | None = None,
                    partitions: int | None = None, settings: list[str] | None = None, error_chars: int | None = None) -> DataFrame:
    """Apply ``fn(payload, attempt) -> str`` to every row, with up to ``max_retries`` more attempts.

    One table comes back, to be split by ``kind``: 'result', 'attempt' (the log, one row per
    attempt) and 'dead_letter' (payload, attempts and the error, of which ``error_chars`` are kept at
    most). Key and payload keep their types. With ``settings`` (names of columns) the function gets
    a third argument, a dict of their values. Exceptions, and a body that exits, are contained row by
    row; a call that took longer than ``timeout_s`` counts as failed once it returns (a running call
    cannot be stopped). Nothing is shuffled unless asked for. Reading the table runs the function:
    ``map_dead_letter_tables`` does so once for all three kinds.
    """
    named = settings or []

    def attempts(value, more):
        for n in range(1, max_retries + 2):
            began = time.monotonic()
            try:
                out = fn(value, n, *more)
                if timeout_s is not None and time.monotonic() - began > timeout_s:
                    yield n, "TIMEOUT", None, f"took longer than {timeout_s} s"
                    continue
                yield n, "OK", None if out is None else str(out), None
                return
            except MemoryError as e:
                yield n, "NOMEM", None, str(e)
            except (Exception, SystemExit) as e:  # contained: this row's outcome, not the job's
                yield n, "TASK", None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            keys, values, extra = batch["k"].to_pylist(), batch["v"].to_pylist(), [batch[f"s{i}"].to_pylist() for i in range(len(named))]
            for i, (k, value) in enumerate(zip(keys, values)):
                more = [dict(zip(named, (c[i] for c in extra)))] if named else []
                for n, status, out, error in attempts(value, more):
                    tail = error[-error_chars:] if error and error_chars else error
                    rows.append(("attempt", k, n, status, None, tail, None))
                if status == "OK":
                    rows.append(("result", k, n, status, out, None, None))
                else:
                    rows.append(("dead_letter", k, n, status, None, tail, value))
            types = [pa.string(), batch["k"].type, pa.int32(), pa.string(), pa.string(), pa.string(), batch["v"].type]
            names = ["kind", "key", "attempt", "status", "result", "error", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    source = items.select(F.col(key).alias("k"), F.col(payload).alias("v"), *[F.col(c).alias(f"s{i}") for i, c in enumerate(named)])
    if partitions:
        source = source.repartition(partitions)
    text = T.StringType()
    schema = T.StructType([T.StructField("kind", text), T.StructField("key", source.schema["k"].dataType), T.StructField("attempt", T.IntegerType()),
                           T.StructField("status", text), T.StructField("result", text), T.StructField("error", text),
                           T.StructField("payload", source.schema["v"].dataType)])
    return source.mapInArrow(run, schema)


def map_dead_letter_tables(items: DataFrame, key: str, payload: str, fn: Callable, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(results, attempts, dead letters) of ``map_dead_letter``, written once, so the function runs once per attempt."""
    done = pin(map_dead_letter(items, key, payload, fn, **options), "mapped")
    return (done.where("kind = 'result'").select("key", "attempt", "result"),
            done.where("kind = 'attempt'").select("key", "attempt", "status", "error"),
            done.where("kind = 'dead_letter'").select("key", "attempt", "status", "error", "payload"))


def item_costs(items: DataFrame, payload: str, cost: Callable, mem: str = "mem_bytes") -> DataFrame:
    """The items with what each costs: ``mem`` from ``cost(payload)`` and ``cost_status``, for ``screen_submissions``.

    The function returns the memory of one item, None to leave the item's own (the task's default), or a pair
    (memory, status). Whatever it raises, or an answer that is no whole number from 0, marks its row, which keeps
    its own memory; it never fails the job. Runs over Arrow batches; all columns stay.
    """
    def judged(value) -> tuple[int | None, str]:
        try:
            got = cost(value)
            amount, status = got if isinstance(got, tuple) else (got, "OK")
            if amount is not None and (isinstance(amount, bool) or not isinstance(amount, int) or not 0 <= amount < 1 << 63):
                return None, "INVAL" if status == "OK" else str(status)
            return amount, str(status)
        except MemoryError:
            return None, "NOMEM"
        except (Exception, SystemExit):  # contained: this row's status
            return None, "TASK"

    @F.pandas_udf("mem long, status string")
    def ask(values: pd.Series) -> pd.DataFrame:
        got = [judged(v) for v in values]
        return pd.DataFrame({"mem": pd.array([g[0] for g in got], "Int64"), "status": [g[1] for g in got]})

    asked = items.withColumn("_cost", ask(F.col(payload)))
    own = F.col(mem) if mem in items.columns else F.lit(None).cast("long")
    return asked.withColumns({mem: F.when(F.col("_cost.status") == "OK", F.coalesce("_cost.mem", own)).otherwise(own), "cost_status": F.col("_cost.status")}).drop("_cost")


def sharded_map(items: DataFrame, key: str, shards: int, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``fn`` over Arrow batches with all rows of one key in one of ``shards`` partitions.

    That is the feature: a key with most of the rows makes a long partition, but it is streamed
    batch by batch and never held whole.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return items.repartition(shards, key).mapInPandas(run, schema)
