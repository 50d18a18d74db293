"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHECKPOINT_CONF = "spark.checkpoint.dir"
OWN_DIR_CONF = "workfold.sharedDir"
ROWS_PER_CELL_CONF = "workfold.rowsPerCell"
DEFAULT_ROWS_PER_CELL = 500_000
BROADCAST_ROWS_CONF = "workfold.broadcastRows"
DEFAULT_BROADCAST_ROWS = 200_000


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings every plan here assumes; the cluster's own settings win elsewhere."""
    builder = (
        SparkSession.builder.appName("workfold")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one only where nothing is named (tests)."""
    set_by_call = spark.sparkContext._jsc.sc().getCheckpointDir()  # SparkContext.setCheckpointDir
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.conf.get(OWN_DIR_CONF, None) or (set_by_call.get() if set_by_call.isDefined() else None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    named = tempfile.mkdtemp(prefix="workfold-")
    spark.conf.set(OWN_DIR_CONF, named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; an enclosing ``scratch`` owns it."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex[:12]}")
    if owners := _OWNED.get():
        owners[-1].append(path)
    return path


_OWNED: ContextVar[tuple[list[str], ...]] = ContextVar("owned", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Own what is written to the shared folder inside: intermediates go at the end, also after a failure.

    Results have to be written elsewhere, or read, before the block ends; blocks may be nested.
    """
    own: list[str] = []
    token = _OWNED.set((*_OWNED.get(), own))
    try:
        yield
    finally:
        _OWNED.reset(token)
        for path in own:
            for written in (path, f"{path}-progress"):
                place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written)
                place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def rows_per_cell(spark: SparkSession) -> int:
    """How many rows one window task should sort at most (see ``plans.running``)."""
    return int(spark.conf.get(ROWS_PER_CELL_CONF, str(DEFAULT_ROWS_PER_CELL)))


def broadcast_rows(spark: SparkSession) -> int:
    """How many rows of a few numbers a plan may ask Spark to broadcast; longer sides join by shuffle."""
    return int(spark.conf.get(BROADCAST_ROWS_CONF, str(DEFAULT_BROADCAST_ROWS)))
