"""Reading, writing and mapping."""

import pytest
from pyspark.sql import functions as F

from tests.logs import by, event, lifecycle, measure
from workfold import model as M
from workfold.operators import aggregates as A
from workfold.operators import mapping as P
from workfold.operators import measures as X
from workfold.session import build_session, shared_dir
from workfold.sources import lifecycle as L


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_old_files_and_new_kinds(spark, tmp_path, fmt):
    path = str(tmp_path / fmt)
    old = spark.createDataFrame([("QUEUED", 1, "t", 5)], "kind string, handle long, task string, ts_ms long")
    new = spark.createDataFrame([("PAUSED", 1, "t", 6, "x"), ("STARTED", 1, "t", 7, "x")], "kind string, handle long, task string, ts_ms long, later string")
    old.write.format(fmt).mode("append").save(path)
    new.write.format(fmt).mode("append").save(path)
    read = L.read_lifecycle(spark, path, fmt)
    assert read.schema.names == M.LIFECYCLE.names
    assert sorted((r.kind, r.measures, r.shard) for r in read.collect()) == [("QUEUED", None, None), ("STARTED", None, None)]


def test_journal_and_config_sources(spark, tmp_path):
    rows = [("f", 0, "P", 1, "n", b"x", None, None), ("f", 1, "Z", 1, None, None, None, None)]
    spark.createDataFrame(rows, M.JOURNAL).write.parquet(str(tmp_path / "j"))
    assert [r.type for r in L.read_journal(spark, str(tmp_path / "j")).collect()] == ["P"]
    spark.createDataFrame([(1, "k", "v")], "entity long, key string, value string").write.parquet(str(tmp_path / "c"))
    assert L.read_config(spark, str(tmp_path / "c")).first().line is None


def test_snapshot_and_dead_letter_sinks(spark, tmp_path):
    log = lifecycle(spark, [
        event("FAILED", 1, 5, 1, status="TASK", measures=[measure("mem.peak", 9)], tail="first"),
        event("FAILED", 1, 9, 2, status="TASK", measures=[measure("mem.peak", 4)], tail="second"),
        event("DEAD_LETTERED", 1, 9, 2, status="TASK")])
    L.write_snapshot(A.counters(log), X.measure_fold(X.measure_rows(log)), str(tmp_path / "s"))
    assert by(spark.read.parquet(str(tmp_path / "s/counters")), "task")["t"]["dead_lettered"] == 1
    assert spark.read.parquet(str(tmp_path / "s/measures")).count() == 2
    L.write_dead_letters(L.dead_letters(log), str(tmp_path / "d"))
    row = spark.read.parquet(str(tmp_path / "d")).first()
    assert (row.attempts, row.stderr_tail, row.task, row.measures[0].value) == (2, "second", "t", 4)


def test_map_dead_letter_contains_failures(spark):
    def body(payload, attempt):
        if payload == "never":
            raise ValueError("x" * 2000)
        if payload == "twice" and attempt < 3:
            raise KeyError("later")
        if payload == "slow":
            import time
            time.sleep(0.2)
        return None if payload is None else payload.upper()

    items = spark.createDataFrame([(1, "fine"), (2, "never"), (3, "twice"), (4, None), (5, "slow")], "id long, body string")
    out = P.map_dead_letter(items, "id", "body", body, max_retries=2, timeout_s=0.1, error_chars=512).cache()
    results = {r.key: (r.attempt, r.result) for r in out.where("kind = 'result'").collect()}
    assert results == {1: (1, "FINE"), 3: (3, "TWICE"), 4: (1, None)}
    dead = by(out.where("kind = 'dead_letter'"), "key")
    assert sorted(dead) == [2, 5] and dead[2]["payload"] == "never" and len(dead[2]["error"]) == 512
    assert dead[5]["status"] == "TIMEOUT"
    tries = {r.key: r["count"] for r in out.where("kind = 'attempt'").groupBy("key").count().collect()}
    assert tries == {1: 1, 2: 3, 3: 3, 4: 1, 5: 3}


def test_sharded_map_keeps_a_key_together(spark):
    items = spark.range(1000).select((F.col("id") % 13).alias("k"))
    out = P.sharded_map(items, "k", 4, lambda b: b, "k long").withColumn("p", F.spark_partition_id())
    assert out.groupBy("k").agg(F.count_distinct("p").alias("n")).where("n <> 1").count() == 0


def test_zero_means_unset_where_named(spark):
    df = spark.createDataFrame([(0, 0), (5, 6)], "timeout_s int, retries int")
    assert [tuple(r) for r in L.zero_as_unset(df, ["timeout_s"]).collect()] == [(None, 0), (5, 6)]


def test_session_and_shared_dir(spark):
    assert build_session().conf.get("spark.sql.session.timeZone") == "UTC"
    assert shared_dir(spark) == shared_dir(spark)


def test_a_handle_that_died_twice_gives_two_letters(spark):
    events = [("FAILED", 1, 10, "first"), ("DEAD_LETTERED", 1, 11, None), ("FAILED", 1, 30, "again"), ("FAILED", 1, 31, "second"), ("DEAD_LETTERED", 1, 32, None)]
    log = L.known_events(spark.createDataFrame([(k, 5, "t", a, ts, "TASK", tail, i) for i, (k, a, ts, tail) in enumerate(events)],
                                               "kind string, handle long, task string, attempt int, ts_ms long, status string, stderr_tail string, arrival long"))
    items = spark.createDataFrame([(5, 3, 40, "body")], "handle long, priority int, due_ms long, payload string")
    got = L.dead_letters(log, items).orderBy("dead_ms").collect()
    assert [(r.dead_ms, r.stderr_tail, r.priority, r.due_in_ms, r.payload) for r in got] == [(11, "first", 3, 29, "body"), (32, "second", 3, 8, "body")]


def test_map_dead_letter_contains_an_exit_and_keeps_types(spark, tmp_path):
    def body(value, attempt, settings):
        with open(tmp_path / "calls", "a") as f:
            f.write("x")
        if value == b"exit":
            raise SystemExit(3)
        return f"{len(value)}/{settings['limit']}"

    items = spark.createDataFrame([("a", bytearray(b"exit"), 1), ("b", bytearray(b"abc"), 2)], "id string, body binary, limit int")
    results, attempts, letters = P.map_dead_letter_tables(items, "id", "body", body, max_retries=1, settings=["limit"])
    assert [(r.key, r.result) for r in results.collect()] == [("b", "3/2")]
    assert sorted((r.key, r.attempt, r.status) for r in attempts.collect()) == [("a", 1, "TASK"), ("a", 2, "TASK"), ("b", 1, "OK")]
    assert [(r.key, bytes(r.payload), r.error) for r in letters.collect()] == [("a", b"exit", "SystemExit: 3")]
    assert (tmp_path / "calls").stat().st_size == 3


def test_scratch_removes_what_was_written_inside(spark, tmp_path):
    import os

    from workfold.plans.pin import pin
    from workfold.session import scratch
    from workfold.streaming import aggregates as G
    from workfold.streaming.run import drain

    log = lifecycle(spark, [event("QUEUED", 1, 0), event("STARTED", 1, 5, 1)])
    kept = pin(log, "kept")
    before = set(os.listdir(shared_dir(spark)))
    with scratch(spark):
        outer = pin(log, "outer")
        with scratch(spark):
            assert A.gauges(log).count() == 2
        assert outer.count() == 2
        path = str(tmp_path / "log")
        log.write.parquet(path)
        drain(G.stream_counters(L.stream_lifecycle(spark, path)), "drained")
        assert len(set(os.listdir(shared_dir(spark))) - before) == 3
    assert set(os.listdir(shared_dir(spark))) <= before
    with pytest.raises(RuntimeError):
        with scratch(spark):
            pin(log, "failed")
            raise RuntimeError
    assert set(os.listdir(shared_dir(spark))) <= before and kept.count() == 2
