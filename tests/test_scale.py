"""Skewed inputs and the shape of the plans."""

import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from workfold.operators import aggregates as A
from workfold.operators import measures as P
from workfold.operators import ordering as O
from workfold.operators import series as S
from workfold.plans.attempts import attempt_pivot, with_cycle
from workfold.sources.lifecycle import known_events


def skewed(spark, n=3000):
    """One requeued handle with a third of all events, one task with nine tenths, many events at one stamp."""
    i = F.col("id")
    hot = spark.range(n // 3).select(
        F.when(i % 2 == 0, "STARTED").otherwise("FAILED").alias("kind"), F.lit(1).cast("long").alias("handle"), F.lit("big").alias("task"),
        (i * 10).alias("ts_ms"), F.when(i % 2 == 0, "OK").otherwise("TASK").alias("status"), F.lit(1).alias("attempt"))
    rest = spark.range(n // 3).select((i + 10).alias("handle"), F.when(i % 5 == 0, "small").otherwise("big").alias("task"), (i % 3 * 1000).alias("at"))
    rest = rest.select("handle", "task", F.inline(F.array(
        F.struct(F.lit("QUEUED").alias("kind"), F.col("at").alias("ts_ms"), F.lit("OK").alias("status"), F.lit(0).alias("attempt")),
        F.struct(F.lit("FINISHED").alias("kind"), (F.col("at") + 7).alias("ts_ms"), F.lit("OK").alias("status"), F.lit(1).alias("attempt")))))
    log = hot.unionByName(rest).withColumns({"mem_bytes": F.lit(1).cast("long"), "arrival": F.col("handle") * 10000 + F.col("ts_ms")})
    return known_events(log.withColumn("measures", F.lit(None)).withColumn("stderr_tail", F.lit(None)))


def test_skewed_handle_task_and_stamp(spark, small_cells):
    log = skewed(spark).cache()
    cycled = with_cycle(log)
    top = cycled.where("handle = 1").agg(F.max("cycle").alias("c"), F.count("*").alias("n")).first()
    assert (top.c, top.n) == (500, 1000)
    waits = A.cycle_waits(cycled)
    assert waits.where("handle = 1").count() == 500
    peak = {r.task: r.peak for r in S.inflight_peak(log).collect()}
    assert peak["(total)"] == peak["big"] == 1
    series = S.inflight_series(log).where("task = '(total)'").orderBy(F.desc("ts_ms")).first()
    assert series.pending == 0
    pct = {(r.task, r.pct): r.finish_ms for r in A.exact_percentile(log).collect()}
    assert pct[("big", 99)] == 7
    spark.catalog.clearCache()


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filters_and_columns_reach_the_scan(spark):
    path = f"{SF}/lineitem.parquet"
    plan = plan_of(spark.read.parquet(path).where("l_quantity > 5").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan
    from workfold.catalog.inputs import Inputs

    fx = Inputs(spark, SF)
    schema = re.findall(r"ReadSchema: (\S+)", plan_of(fx.attempts.groupBy("task").count()))
    assert not any("l_extendedprice" in s and "l_tax" in s for s in schema)
    items = re.findall(r"ReadSchema: (\S+)", plan_of(A.shard_load(fx.items.select("mem_bytes", "tenant", "seq"), "mem_bytes", 3)))
    assert all("o_orderpriority" not in s for s in items)


@pytest.mark.parametrize("op", [A.counters, A.wait_totals, lambda log: A.gauge_totals(log, ["handle"]), A.latency_histogram, lambda log: P.measure_fold(P.measure_rows(log)),
                                lambda log: P.suggest_memory(log), lambda log: A.run_report(log)])
def test_event_rows_are_hash_aggregated_before_the_shuffle(spark, tmp_path, op):
    from workfold.catalog.inputs import Inputs

    Inputs(spark, SF).lifecycle.limit(50).write.parquet(str(tmp_path / "log"))
    log = known_events(spark.read.parquet(str(tmp_path / "log")))
    plan = plan_of(op(log))
    tree = plan.split("\n\n")[0]
    lowest = [line for line in tree.splitlines() if "Aggregate" in line][-1]
    assert "HashAggregate" in lowest, tree
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_topk_is_limited_before_the_shuffle(spark):
    from workfold.catalog.inputs import Inputs

    plan = plan_of(O.topk_per_task(Inputs(spark, SF).items, O.edf_keys(), 5))
    assert plan.count("WindowGroupLimit") >= 2


def test_waits_and_pivots_carry_no_payload_through_their_cells(spark, monkeypatch):
    from pyspark.sql import functions as F

    from workfold.operators import aggregates as A
    from workfold.plans import attempts, running

    written = []
    real = running.pin
    monkeypatch.setattr(running, "pin", lambda df, label: written.append((df.columns, df.count())) or real(df, label))
    events = [("QUEUED", 0, 0), ("STARTED", 1, 10), ("FAILED", 1, 20), ("STARTED", 1, 30), ("FINISHED", 1, 40), ("SAMPLE", 1, 41)]
    rows = [(k, h, "t", a, ts, "TASK" if k == "FAILED" else "OK", i) for h in (7, None) for i, (k, a, ts) in enumerate(events)] + [("STARTED", 8, "t", 1, 9, "OK", 50)]
    log = spark.createDataFrame(rows, "kind string, handle long, task string, attempt int, ts_ms long, status string, arrival long")
    log = log.withColumn("measures", F.array(F.lit("x"))).withColumn("stderr_tail", F.lit("y"))
    waits = {(r.handle, r.cycle): r.wait_ms for r in A.attempt_waits(log).collect()}
    assert waits == {(7, 1): 10, (7, 2): 30, (None, 1): 10, (None, 2): 30, (8, 1): 0}
    assert [n for _, n in written] == [7]  # starts and what queues them
    pivot = {(r.handle, r.cycle): (r.queued_ms, r.base_ms, r.started_ms, r.ended_ms) for r in attempts.attempt_pivot(log).collect()}
    assert pivot == {(7, 1): (0, None, 10, 20), (7, 2): (None, 0, 30, 40), (None, 1): (0, None, 10, 20), (8, 1): (None, None, 9, None)}
    assert [n for _, n in written][1:] == [6]  # only the item that started anew
    assert all("measures" not in columns and "stderr_tail" not in columns for columns, _ in written)


@pytest.mark.parametrize("table", ["attempts", "journal"])
def test_derived_rows_come_in_tasks_of_bounded_rows(spark, table):
    from workfold.catalog.inputs import Inputs

    def tasks():
        rows = getattr(Inputs(spark, SF), table).withColumn("task_id", F.spark_partition_id())
        return [r["count"] for r in rows.groupBy("task_id").count().collect()]

    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    before = spark.conf.get("workfold.rowsPerCell")
    try:
        spark.conf.set("workfold.rowsPerCell", str(lines))
        whole = sum(tasks())
        spark.conf.set("workfold.rowsPerCell", str(lines // 30))
        dealt = tasks()
    finally:
        spark.conf.set("workfold.rowsPerCell", before)
    assert sum(dealt) == whole and len(dealt) >= 25 and max(dealt) <= 4 * lines // 30


def test_pinned_rows_leave_no_shuffle_behind(spark):
    from workfold.plans.pin import SWEEP_CONF, pin

    def shuffles():
        return str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(",")).count("shuffle_")

    spark.sparkContext._jvm.System.gc()
    before, conf = shuffles(), spark.conf.get(SWEEP_CONF, None)
    rows = spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n"))
    assert pin(rows, "swept").agg(F.sum("n")).first()[0] == 5000
    assert pin(rows.repartitionByRange(3, "k"), "swept").count() == 700
    assert shuffles() <= before + 2 * 4 and spark.conf.get(SWEEP_CONF, None) == conf  # those of the sums over the pinned rows only


def test_log_is_folded_by_handle_without_another_shuffle(spark):
    from workfold.catalog.inputs import Inputs
    from workfold.plans.attempts import PIVOTED, pivot_once

    before = spark.conf.get("workfold.rowsPerCell")
    spark.conf.set("workfold.rowsPerCell", "500")
    try:
        tree = plan_of(pivot_once(Inputs(spark, SF).lifecycle.select("handle", *PIVOTED))).split("\n\n")[0]
    finally:
        spark.conf.set("workfold.rowsPerCell", before)
    assert "Exchange" in tree and "Exchange" not in tree[:tree.index("Union")], tree
