"""Joining with rule tables, whose sizes Spark does not know."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workfold.session import broadcast_rows


def rule_table(table: DataFrame) -> DataFrame:
    """``table`` with the hint that its counted rows allow: broadcast while they are few, else a join by shuffle.

    Without it Spark may broadcast the other side: it takes a table of local rows as endless, and rows that a
    generator makes as no wider than the scan below them.
    """
    most = broadcast_rows(table.sparkSession)
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table.hint("merge")
