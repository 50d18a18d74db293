"""Running sums, maxima and ordinals that no single task has to sort alone.

A plain window puts a whole group into one task. Here the rows are range-partitioned by group and order
and written once, which fixes the layout; a partition is a cell. The cells are summed, the sums of the
groups that go on over a border are carried forward (at most two groups a cell), and the window runs
inside each cell. The plan has no greatest number of cells; what the cells carry forward is broadcast while
it is short (``broadcast_rows``) and joined by cell and group beyond, where no key holds more than a cell. Where a cell
of the session's shuffle partitions turns out too large, the written rows are laid out once more in as
many cells as it takes. The cuts come from Spark's range sampling and only steer the layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workfold.plans.pin import pin
from workfold.session import broadcast_rows, rows_per_cell

CELL = "_cell"
EVERY = "_every"  # the one group of rows that have none, kept in the written rows

UPTO = "upto"      # the row itself included
BEFORE = "before"  # rows strictly before
ALL = "all"        # the whole group


def running(df: DataFrame, group: list[str], order: list[str], aggs: dict[str, tuple], rows: int | None = None) -> DataFrame:
    """Add running columns: ``{out: (op, column, frame)}``, op 'sum', 'max' or 'min'.

    ``order`` holds ascending columns without NULLs that leave no ties inside a group
    (negate a number for descending). ``sum`` over nothing is 0, ``max``/``min`` NULL.
    ``rows`` saves a second layout where the caller knows how many there are. The input is
    written when the plan is built.
    """
    keys = group or [EVERY]
    layout, cells = _layout(df, group, order, rows)
    inner = _local(layout, [F.col(CELL), *[F.col(k) for k in keys]], order, aggs)
    offsets = _offsets(layout, cells, keys, aggs)
    joined = inner.join(_hinted(offsets, cells), _same(keys), "left")
    return joined.select(
        *[F.col(c) for c in df.columns if c not in aggs],
        *[_merge(op, frame, F.col(out), F.col(f"_o_{out}"), F.col("_g_cell").isNotNull()).alias(out) for out, (op, _, frame) in aggs.items()],
    )


def _same(keys: list[str]) -> Column:
    """A row's cell and group are those of the other side."""
    same = F.col(CELL) == F.col("_g_cell")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_g_{k}"))
    return same


def _hinted(side: DataFrame, cells: int) -> DataFrame:
    """A side with a row for each cell a crossing group is in, so at most two a cell: broadcast if those are few."""
    return F.broadcast(side) if 2 * cells <= broadcast_rows(side.sparkSession) else side


def _offsets(layout: DataFrame, cells: int, keys: list[str], aggs: dict[str, tuple]) -> DataFrame:
    """What the other cells add, for the groups that cross a border: those in more than one cell."""
    groups = [f"_g_{k}" for k in keys]
    spread = layout.groupBy(*keys).agg(F.min(CELL).alias("_from"), F.max(CELL).alias("_to")).where("_from < _to")
    # A group's rows are in cells next to one another, so it is in all between its first and its last.
    border = spread.select(*[F.col(k).alias(g) for k, g in zip(keys, groups)], F.explode(F.sequence("_from", "_to")).alias("_g_cell"))
    crossing = layout.join(_hinted(border, cells), _same(keys))
    partial = crossing.groupBy(*groups, "_g_cell").agg(
        *[_agg(op)(value).alias(f"_c_{out}") for out, (op, value, _) in aggs.items()])
    by_group = Window.partitionBy(*groups)
    carried = by_group.orderBy("_g_cell").rowsBetween(Window.unboundedPreceding, -1)
    return partial.select(
        *groups, "_g_cell",
        *[_agg(op)(f"_c_{out}").over(by_group if frame == ALL else carried).alias(f"_o_{out}")
          for out, (op, _, frame) in aggs.items()])


def ordinal(df: DataFrame, group: list[str], order: list[str], out: str, total: str | None = None,
            rows: int | None = None) -> DataFrame:
    """1, 2, 3 .. within each group, and optionally the group's size."""
    one = F.lit(1).cast("long")
    aggs = {out: ("sum", one, UPTO)}
    if total:
        aggs[total] = ("sum", one, ALL)
    return running(df, group, order, aggs, rows)


def _agg(op: str):
    return {"sum": F.sum, "max": F.max, "min": F.min}[op]


def _zero(op: str, c: Column) -> Column:
    return F.coalesce(c, F.lit(0)) if op == "sum" else c


def _merge(op: str, frame: str, here: Column, offset: Column, crossing: Column) -> Column:
    """The value inside the cell and what other cells add; a group that crosses no border has no offset."""
    if frame == ALL:
        return _zero(op, F.when(crossing, offset).otherwise(here))
    if op == "sum":
        return here + F.coalesce(offset, F.lit(0))
    return (F.greatest if op == "max" else F.least)(here, offset)


def _local(df: DataFrame, keys: list[Column], order: list[str], aggs: dict[str, tuple]) -> DataFrame:
    inside = Window.partitionBy(*keys)
    ordered = inside.orderBy(*order)
    frames = {
        UPTO: ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        BEFORE: ordered.rowsBetween(Window.unboundedPreceding, -1),
        ALL: inside,
    }
    return df.select(
        *[c for c in df.columns if c not in aggs],
        *[_zero(op, _agg(op)(value).over(frames[frame])).alias(out) for out, (op, value, frame) in aggs.items()],
    )


def _layout(df: DataFrame, group: list[str], order: list[str], rows: int | None = None) -> tuple[DataFrame, int]:
    """The rows written in cells, ranges of group and order numbered in that order, and a bound of how many cells."""
    per_cell = rows_per_cell(df.sparkSession)
    keyed = df if group else df.withColumn(EVERY, F.lit(0))
    keys = [*(group or [EVERY]), *order]

    def cut(source: DataFrame, *count: int) -> DataFrame:
        return pin(source.repartitionByRange(*count, *keys).withColumn(CELL, F.spark_partition_id()), "cells")

    if rows is not None and rows > per_cell:
        wanted = -(-rows // per_cell)
        return cut(keyed, wanted), wanted
    layout = cut(keyed)
    size = layout.groupBy(CELL).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("rows"), F.count("*").alias("cells")).first()
    if (size.most or 0) <= 2 * per_cell:
        return layout, size.cells
    wanted = -(-size.rows // per_cell)
    return cut(layout.drop(CELL), wanted), wanted
