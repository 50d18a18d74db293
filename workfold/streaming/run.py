"""Running a stream over what is there and reading back its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workfold.session import ROCKSDB, fresh_path

STORE_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "spark.sql.streaming.stateStore.rocksdb."
BOUNDED = {ROCKS + "boundedMemoryUsage": "true", ROCKS + "maxMemoryUsageMB": "300"}


def drain(stream: DataFrame, label: str, mode: str = "update", table: str | None = None,
          each: Callable[[DataFrame], DataFrame] | None = None, machine: bool = False) -> DataFrame:
    """Run ``stream`` over all available input into a parquet table and return the table.

    ``each`` is applied to every micro-batch before it is written, to fold its rows. Each micro-batch overwrites its own folder, so a batch that is run again after a failure
    leaves its rows once. Checkpoint and table live in the shared folder. A state ``machine`` (``transformWithState``)
    needs a store for several kinds of state, and a state that keeps all handles for good one that is not the executor's
    heap, which Spark's own choice is not: with ``machine`` the stream runs on RocksDB, whose memory in an executor is bounded
    for all its partitions together, unless the session names another such store.
    """
    spark: SparkSession = stream.sparkSession
    table = table or fresh_path(spark, label)
    schema = (each(spark.createDataFrame([], stream.schema)) if each else stream).schema

    def write(batch: DataFrame, batch_id: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    named = spark.conf.get(STORE_CONF, None)
    own = machine and (named is None or named.endswith(".HDFSBackedStateStoreProvider"))
    settings = {STORE_CONF: ROCKSDB, **{k: v for k, v in BOUNDED.items() if spark.conf.get(k, None) is None}} if own else {}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:  # a query keeps the settings it starts with
        query = (stream.writeStream.outputMode(mode).foreachBatch(write)
                 .option("checkpointLocation", f"{table}-progress").trigger(availableNow=True).start())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(schema.add("batch", "long")).parquet(table)


def newest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The latest version of each key of a table written in update mode."""
    last = table.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return table.join(last, [*keys, "batch"], "left_semi").drop("batch")
