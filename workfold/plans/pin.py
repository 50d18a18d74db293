"""Computing an intermediate table once, where a plan reads it several times."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from workfold.session import fresh_path

SWEEP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a plan run inside go when it ends, not when the driver collects its garbage; the session's value returns."""
    before = spark.conf.get(SWEEP_CONF, None)
    spark.conf.set(SWEEP_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SWEEP_CONF)
        else:
            spark.conf.set(SWEEP_CONF, before)


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later readers prune its columns and get its row count from the file footers, nothing
    upstream runs twice, and a lost executor costs no recomputation. What the write shuffled
    is removed with its end, so the disk holds the shuffles of one step at a time.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with swept(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
