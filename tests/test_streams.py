"""Streams against their batch twins, in every legal arrival order."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from tests.logs import by, event, lifecycle
from workfold.operators import aggregates as A
from workfold.operators import joins as J
from workfold.plans.attempts import run_ms, wait_ms, attempt_pivot
from workfold.sources.lifecycle import stream_lifecycle
from workfold.streaming import aggregates as G
from workfold.streaming import state as S
from workfold.streaming.run import drain, newest

TASK = "TASK"

# label -> event and the labels that must arrive before it
RETRY_THEN_CANCEL = {
    "queued": (("QUEUED", 0, 0, "OK"), []),
    "start": (("STARTED", 10, 1, "OK"), []),
    "fail": (("FAILED", 30, 1, TASK), ["start"]),
    "retried": (("RETRIED", 30, 2, TASK), ["fail"]),
    "cancel": (("FAILED", 35, 2, "CANCELLED"), ["fail"]),
}
TWO_RETRIES = {
    "queued": (("QUEUED", 0, 0, "OK"), []),
    "s1": (("STARTED", 10, 1, "OK"), []), "f1": (("FAILED", 20, 1, TASK), ["s1"]), "r2": (("RETRIED", 20, 2, TASK), ["f1"]),
    "s2": (("STARTED", 25, 2, "OK"), ["f1"]), "f2": (("FAILED", 40, 2, TASK), ["s2"]), "r3": (("RETRIED", 40, 3, TASK), ["r2", "f2"]),
    "s3": (("STARTED", 50, 3, "OK"), ["f2"]), "done": (("FINISHED", 60, 3, "OK"), ["s3"]),
}


def extensions(scenario):
    """Every order of a scenario's events that respects its partial order."""
    def extend(order):
        if len(order) == len(scenario):
            yield list(order)
        for label, (_, after) in scenario.items():
            if label not in order and all(a in order for a in after):
                yield from extend([*order, label])

    return list(extend([]))


def feed(spark, path, steps):
    """One file, and so one micro-batch, per step; a step holds events of many handles."""
    os.makedirs(path, exist_ok=True)
    for i, events in enumerate(steps):
        part = f"{path}/../part{i}"
        lifecycle(spark, events).coalesce(1).write.parquet(part)
        (name,) = [n for n in os.listdir(part) if n.endswith(".parquet")]
        os.link(f"{part}/{name}", f"{path}/{i:03d}.parquet")
        os.utime(f"{path}/{i:03d}.parquet", (1_000_000 + 10 * i,) * 2)
    return stream_lifecycle(spark, path, files_per_batch=1)


@pytest.mark.parametrize("scenario,waits,runs", [(RETRY_THEN_CANCEL, 1, 1), (TWO_RETRIES, 3, 3)])
def test_every_arrival_order_gives_the_same(spark, tmp_path, scenario, waits, runs):
    orders = extensions(scenario)
    random.Random(3).shuffle(orders)
    orders = orders[:150]
    steps = []
    for place in range(len(scenario)):
        steps.append([event(k, h, ts, n, status=s) for h, order in enumerate(orders, 1) for (k, ts, n, s) in [scenario[order[place]][0]]])
    changes = drain(S.stream_lifecycle_state(feed(spark, str(tmp_path / "in"), steps)), "perm").cache()
    seen = {}
    for r in changes.orderBy("batch").collect():
        row = seen.setdefault(r.handle, [0, 0, 0, 0])
        row[0] += r.d_pending
        row[1] += r.d_in_flight
        row[2:] = [r.wait_samples, r.run_samples]
        assert 0 <= row[0] and 0 <= row[1] and row[0] + row[1] <= 1, orders[r.handle - 1]
    assert len(seen) == len(orders)
    wrong = {h: (row, orders[h - 1]) for h, row in seen.items() if row != [0, 0, waits, runs]}
    assert not wrong
    total = by(S.fold_changes(changes), "task")["(total)"]
    batch = lifecycle(spark, [e for step in steps for e in step])
    pivot = attempt_pivot(batch).agg(F.sum(wait_ms()).alias("w"), F.sum(run_ms()).alias("r")).first()
    assert (total["wait_ms_sum"], total["run_ms_sum"]) == (pivot.w, pivot.r)


# An item that is retried once and then starts over twice: two requeues, three waits, in flight at the end.
SEVEN = [("QUEUED", 0, 0, "OK"), ("STARTED", 10, 1, "OK"), ("FAILED", 30, 1, TASK), ("STARTED", 45, 1, "OK"), ("FAILED", 50, 1, TASK),
         ("RETRIED", 52, 2, TASK), ("STARTED", 60, 2, "OK")]


@pytest.mark.parametrize("cuts", [[1, 2, 3, 4, 5, 6], [3], [2, 5], []])
def test_requeue_cycles_in_every_arrival_order_and_batch_split(spark, tmp_path, cuts):
    orders = list(itertools.permutations(range(7)))
    random.Random(len(cuts)).shuffle(orders)
    orders = orders[:240]
    steps, bounds = [], [0, *cuts, 7]
    for low, high in zip(bounds, bounds[1:]):
        steps.append([event(SEVEN[i][0], h, SEVEN[i][1], SEVEN[i][2], status=SEVEN[i][3], arrival=i) for h, order in enumerate(orders, 1) for i in order[low:high]])
    stream = feed(spark, str(tmp_path / "in"), steps)
    batch = lifecycle(spark, [event(k, 1, ts, n, status=s) for k, ts, n, s in SEVEN])
    want = by(A.gauges(batch).join(A.wait_latency(batch), "task").join(A.run_latency(batch), "task"), "task")["t"]
    assert (want["in_flight"], want["pending"], want["wait_samples"], want["wait_ms_sum"], want["run_samples"]) == (1, 0, 3, 10 + 45 + 8, 2)
    changes = drain(S.stream_lifecycle_state(stream), "seven")
    per_handle = S.fold_changes(changes.withColumn("task", F.col("handle").cast("string"))).where("task <> '(total)'").drop("task", "expired")
    assert [r.asDict() for r in per_handle.distinct().collect()] == [{k: v for k, v in want.items() if k != "task"}]
    assert per_handle.count() == len(orders)
    events = newest(drain(G.stream_attempts(stream), "seven-events"), ["handle", "task"])
    per_handle = G.lifecycle_now(events.withColumn("task", F.col("handle").cast("string"))).where("task <> '(total)'").drop("task")
    assert [r.asDict() for r in per_handle.distinct().collect()] == [{k: v for k, v in want.items() if k != "task"}]


def test_events_delivered_again_count_once(spark, tmp_path):
    log = [event(k, 1, ts, n, status=s, arrival=i) for i, (k, ts, n, s) in enumerate(SEVEN)]
    total = by(S.fold_changes(drain(S.stream_lifecycle_state(feed(spark, str(tmp_path / "in"), [log[:4], log[2:], log])), "again")), "task")["t"]
    assert (total["in_flight"], total["wait_samples"], total["run_samples"]) == (1, 3, 2)


def random_log(seed, handles=60):
    """Items that retry, are cancelled, dropped or left open, as legal logs."""
    rnd, log = random.Random(seed), []
    for h in range(1, handles + 1):
        task, ts = f"t{h % 3}", rnd.randrange(1000)
        log.append(event("QUEUED", h, ts, task=task))
        for n in range(1, 5):
            ts += rnd.randrange(20)
            if rnd.random() < 0.1:
                if rnd.random() < 0.5:
                    log.append(event("FAILED", h, ts, n, task, "CANCELLED"))
                break
            log.append(event("STARTED", h, ts, n, task))
            ts += rnd.randrange(30)
            if rnd.random() < 0.1:
                break
            if rnd.random() < 0.4:
                log.append(event("FINISHED", h, ts, n, task))
                break
            log.append(event("FAILED", h, ts, n, task, TASK))
            if h % 5 == 0 and n == 2:  # starts over
                ts += rnd.randrange(1, 20)
                log += [event("STARTED", h, ts, 1, task), event("FAILED", h, ts + 3, 1, task, TASK)]
                break
            if n == 4:
                log.append(event(rnd.choice(["DEAD_LETTERED", "DROPPED"]), h, ts, n, task, TASK))
            else:
                log.append(event("RETRIED", h, ts, n + 1, task, TASK))
    return [(*e[:11], i, e[12]) for i, e in enumerate(log)]


@pytest.mark.parametrize("seed", [1, 2])
def test_streams_equal_batch_in_random_order(spark, tmp_path, seed):
    log = random_log(seed)
    shuffled = random.Random(seed).sample(log, len(log))
    size = -(-len(log) // 5)
    stream = feed(spark, str(tmp_path / "in"), [shuffled[i:i + size] for i in range(0, len(log), size)])
    batch = lifecycle(spark, log)
    got = by(S.fold_changes(drain(S.stream_lifecycle_state(stream), "life")).drop("expired"), "task")
    want = by(A.gauges(batch).join(A.wait_latency(batch), "task").join(A.run_latency(batch), "task"), "task")
    assert got == want
    kept = newest(drain(G.stream_attempts(stream), "attempts"), ["handle", "task"])
    assert by(G.lifecycle_now(kept), "task") == want
    counts = by(newest(drain(G.stream_counters(stream), "count"), ["task"]), "task")
    assert counts == by(A.counters(batch), "task")
    for span in (None, "40 milliseconds"):
        first = newest(drain(S.stream_first_terminal(stream, span, origin_ms=10**12), "first"), ["handle", "from_ms"])
        assert by(S.outcomes_now(first), "handle") == by(J.outcomes(batch), "handle")
    deps = spark.createDataFrame([(h % 7, h) for h in range(1, 61)], "gate long, dep long")
    gates = by(drain(S.stream_gates(stream, deps, origin_ms=10**12), "gates", "append").drop("batch"), "gate")
    opened = J.gate_release(deps.select("gate").distinct(), deps, batch).where("state = 'open'")
    assert {g: r["release_ms"] for g, r in gates.items()} == {r.gate: r.release_ms for r in opened.collect()}


def test_markers_expire_and_are_counted(spark, tmp_path):
    hour = 3600000
    steps = [[event("STARTED", 1, 0, 1), event("FINISHED", 1, 10, 1)],            # its QUEUED never comes
             [event("STARTED", 2, 2 * hour, 1)],                                   # live: never dropped
             [event("QUEUED", 3, 20 * hour), event("STARTED", 3, 20 * hour, 1)],
             [event("FINISHED", 3, 40 * hour, 1)]]
    stream = feed(spark, str(tmp_path / "in"), steps)
    total = by(S.fold_changes(drain(S.stream_lifecycle_state(stream, ttl_ms=hour, delay="1 second", origin_ms=10**12), "ttl")), "task")["t"]
    assert (total["expired"], total["in_flight"], total["pending"]) == (1, 1, 0)


def test_unseen_queued_events_expire_over_several_batches(spark, tmp_path):
    hour = 3600000
    steps = [[event("STARTED", 1, 0, 1), event("FINISHED", 1, 10, 1), event("FINISHED", 1, 20, 1)],    # its QUEUED never comes; told twice
             [event("QUEUED", 2, hour), event("FINISHED", 2, hour + 5, 1), event("FINISHED", 3, hour + 6, 1)],
             [event("QUEUED", 3, hour + 30 * 60000), event("FINISHED", 4, 30 * hour, 1)],              # 3's comes late, within the time to live
             [event("SAMPLE", 9, 60 * hour)]]
    stream = S.stream_expired_markers(feed(spark, str(tmp_path / "in"), steps), ttl="1 HOUR", lifetime="1 DAY", origin_ms=10**12)
    got = drain(stream, "ttl", "append")
    assert sorted((r.handle, r.ts_ms) for r in got.collect()) == [(1, 10), (4, 30 * hour)]
    assert len({r.batch for r in got.collect()}) == 2


def progress_of(query):
    """Rows in the state after the last micro-batch."""
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])


def run_out(stream, path, table, mode="append"):
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", table).option("checkpointLocation", path).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@pytest.mark.parametrize("batches", [1, 10])
def test_overrun_alerts_do_not_hang_on_batches(spark, tmp_path, batches):
    minute = 60000
    log = [event("STARTED", 1, 0, 1), event("STARTED", 2, 0, 1), event("STARTED", 3, 0, 1), event("FINISHED", 2, 5 * minute, 1),    # 2 is in time
           event("FINISHED", 3, 30 * minute, 1), event("STARTED", 4, 90 * minute, 1), event("FAILED", 1, 95 * minute, 1),              # 3 and 1 end late
           event("STARTED", 1, 96 * minute, 1), event("FINISHED", 1, 99 * minute, 1), event("FAILED", 4, 100 * minute, 1),             # 1 starts over, in time
           event("STARTED", 5, 200 * minute, 1),                                                                                       # never ends
           event("STARTED", 0, 900 * minute, 1), event("FINISHED", 0, 900 * minute, 1)]
    size = -(-len(log) // batches)
    limits = spark.createDataFrame([("t", 10 * minute)], "task string, limit_ms long")
    stream = feed(spark, str(tmp_path / "in"), [log[i:i + size] for i in range(0, len(log), size)])
    got = S.alerts_now(drain(S.stream_overrun_alert(stream, limits, horizon="2 HOURS", origin_ms=10**12), "alerts", "append"))
    assert sorted((r.handle, r.attempt, r.deadline_ms, r.what, r.over_ms) for r in got.where("handle > 0").collect()) == [
        (1, 1, 10 * minute, "ended", 85 * minute), (1, 1, 10 * minute, "open", None), (3, 1, 10 * minute, "ended", 20 * minute),
        (3, 1, 10 * minute, "open", None), (5, 1, 210 * minute, "open", None)]


COLS_S, COLS_F = "business_id string, round int, handle long, ts_ms long", (
    "business_id string, round int, handle long, ts_ms long, arrival long, status string, attempt int, ok boolean")


def rows_as_files(spark, rows, schema, path):
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.option("maxFilesPerTrigger", 1).schema(schema).parquet(path)


def test_ledger_stream_in_any_order(spark, tmp_path):
    subs = [("a", 0, 1, 0), ("a", 1, 2, 100), ("b", 0, 3, 0), ("c", 0, 4, 0)]
    facts = [("a", 0, 1, 50, 1, TASK, 1, False), ("a", 0, 1, 60, 2, TASK, 1, False), ("a", 0, 1, 500, 3, TASK, 1, False),
             ("a", 1, 2, 150, 4, "OK", 2, True), ("b", 0, 3, 70, 5, TASK, 3, False)]
    end = 10**9
    want = by(J.ledger(spark.createDataFrame(subs, COLS_S), spark.createDataFrame(facts, COLS_F).drop("business_id", "round")), "business_id")
    assert want["a"]["confirmations"] == 1 and want["a"]["state"] == "recovered" and want["c"]["state"] == "open"
    for turn, order in enumerate(itertools.islice(itertools.permutations(facts), 0, 120, 40)):
        base = str(tmp_path / f"o{turn}")
        read_s = rows_as_files(spark, [[x] for x in subs[::-1]] + [[("", 0, 0, end)]], COLS_S, f"{base}/subs")
        read_f = rows_as_files(spark, [[x] for x in order] + [[("", 0, 0, end, 0, "OK", 1, True)]], COLS_F, f"{base}/facts")
        out = drain(S.stream_ledger(read_s, read_f, origin_ms=10**12), "ledger", "append", each=S.folded_facts)
        assert by(S.ledger_now(out).where("business_id <> ''"), "business_id") == want


def test_ledger_state_stays_flat_under_confirmations(spark, tmp_path):
    many = [("a", 0, 1, 1000 + i, i, TASK, 1, False) for i in range(10_000)]
    sizes = []
    for turn, facts in enumerate(([many[0]], many)):
        base = str(tmp_path / f"s{turn}")
        read_s = rows_as_files(spark, [[("a", 0, 1, 0)], [("", 0, 0, 10**9)]], COLS_S, f"{base}/subs")
        read_f = rows_as_files(spark, [facts, [("", 0, 0, 10**9, 0, "OK", 1, True)]], COLS_F, f"{base}/facts")
        query = run_out(S.stream_ledger(read_s, read_f, origin_ms=10**12), f"{base}/progress", f"{base}/out")
        sizes.append(progress_of(query))
        assert spark.read.parquet(f"{base}/out").where("business_id = 'a' AND ts_ms IS NOT NULL").count() == len(facts)
    assert sizes[0] == sizes[1] <= 3


def test_gate_state_is_gone_when_all_are_open(spark, tmp_path):
    steps = [[event("FINISHED", h, 10 + h, 1) for h in range(i, 60, 3)] for i in range(3)] + [[event("FINISHED", 1, 50, 1)], [event("FINISHED", 999, 10**9, 1)]]
    deps = spark.createDataFrame([(h % 7, h) for h in range(60)], "gate long, dep long")
    query = run_out(S.stream_gates(feed(spark, str(tmp_path / "in"), steps), deps, origin_ms=10**12), str(tmp_path / "progress"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    assert [op["numRowsTotal"] for op in query.lastProgress["stateOperators"] if op["operatorName"].startswith("transformWithState")] == [0]
    assert progress_of(query) <= 1  # the heartbeat itself


def test_rates_are_counted_per_step_first(spark, tmp_path):
    log = [event("FINISHED", h, h * 700, 1) for h in range(200)] + [event("SAMPLE", 0, 10**8)]
    stream = feed(spark, str(tmp_path / "in"), [log[:90], log[90:200], log[200:]])
    got = drain(G.stream_done_rate(stream, "32 seconds", "1 second", origin_ms=10**12), "rate", "append")
    want = {}
    for h in range(200):
        for k in range(32):
            end = (h * 700 // 1000 + k + 1) * 1000
            want[end] = want.get(end, 0) + 1
    assert {r.sample_ms: r.done for r in got.collect()} == want and got.count() == len(want)


def test_old_windows_leave_the_state(spark, tmp_path):
    steps = [[event("FINISHED", h, 10 + h, 1) for h in range(500)], [event("FINISHED", 7, 3600000 * 50, 1)], [event("FINISHED", 8, 3600000 * 99, 1)]]
    query = run_out(S.stream_first_terminal(feed(spark, str(tmp_path / "in"), steps), "1 hour", origin_ms=36 * 10**11), str(tmp_path / "p"), str(tmp_path / "o"), "append")
    assert progress_of(query) <= 1


def test_batch_written_again_counts_once(spark, tmp_path):
    stream = feed(spark, str(tmp_path / "in"), [[event("QUEUED", 1, 0)], [event("QUEUED", 2, 1)]])
    table = str(tmp_path / "table")
    drain(G.stream_counters(stream), "c", table=table)
    again = drain(G.stream_counters(stream), "c", table=table)     # restarts from the checkpoint: nothing new
    assert by(newest(again, ["task"]), "task")["t"]["queued"] == 2


@pytest.mark.parametrize("named", [None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"])
def test_state_machines_run_where_the_session_names_no_store_for_them(spark, tmp_path, named):
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.unset(conf) if named is None else spark.conf.set(conf, named)
    try:
        log = [event("QUEUED", 1, 0), event("STARTED", 1, 10, 1), event("FINISHED", 1, 30, 1), event("QUEUED", 2, 5)]
        changes = drain(S.stream_lifecycle_state(feed(spark, str(tmp_path / "a" / "in"), [log])), "changes", machine=True)
        got = by(S.fold_changes(changes), "task")["t"]
        assert (got["pending"], got["wait_ms_sum"], got["run_ms_sum"]) == (1, 10, 20)
        deps = spark.createDataFrame([(7, 1)], "gate long, dep long")
        gates = drain(S.stream_gates(feed(spark, str(tmp_path / "b" / "in"), [log]), deps, origin_ms=10**12), "gates", "append", machine=True)
        assert [(r.gate, r.deps, r.release_ms) for r in gates.collect()] == [(7, 1, 30)]
        assert spark.conf.get(conf, None) == named
    finally:
        spark.conf.set(conf, before)


@pytest.mark.parametrize("rows", [0, 1, 7, 4000])
def test_slices_are_written_by_several_tasks_and_taken_whole(spark, rows):
    from workfold.catalog import streams as C

    odd = F.when(F.col("id") % 10 < 7, 5).otherwise(F.col("id"))  # most of the rows share a stamp, so some slices are empty
    log = spark.range(0, rows, 1, 6).select(F.lit("FINISHED").alias("kind"), F.col("id").alias("handle"), odd.cast("long").alias("ts_ms"))
    path, files = C.written_in_order(log, "slices", rows_per_file=200)
    assert files == (4 if rows == 4000 else 1)
    names = spark.read.parquet(path).inputFiles()
    assert len(names) == 5 * files
    names.sort(key=lambda n: os.stat(n.removeprefix("file:")).st_mtime_ns)
    spans = [spark.read.schema(log.schema).parquet(*names[i:i + files]).agg(F.min("ts_ms"), F.max("ts_ms"), F.count("*")).first() for i in range(0, 5 * files, files)]
    held = [s for s in spans if s[2]]
    assert all(a[1] < b[0] for a, b in zip(held, held[1:])) and sum(s[2] for s in spans) == rows


def test_batches_of_a_stream_do_not_grow_with_its_files(spark):
    from types import SimpleNamespace

    from workfold.catalog import streams as C

    log = lifecycle(spark, [event("FINISHED", h, 10 + h, 1) for h in range(80)]).repartition(40)
    stream = C.streamed(SimpleNamespace(spark=spark, lifecycle=log))
    out = drain(stream.groupBy("task").agg(F.count("*").alias("n")), "n")
    assert out.select("batch").distinct().count() <= 5 and out.agg(F.max("n")).first()[0] == 80


def test_cycles_that_are_kept_make_no_python_call_per_key(spark, tmp_path):
    log = [event(k, 1, ts, n, status=s, arrival=i) for i, (k, ts, n, s) in enumerate(SEVEN)]
    stream = feed(spark, str(tmp_path / "in"), [log[4:], log[:4], log])
    assert "TransformWithState" not in S.stream_lifecycle_state(stream)._jdf.queryExecution().logical().toString()
    assert "TransformWithState" in S.stream_lifecycle_state(stream, ttl_ms=1000, origin_ms=10**12)._jdf.queryExecution().logical().toString()
    told = drain(S.stream_lifecycle_state(stream), "told").orderBy("batch").collect()
    assert [(r.batch, r.d_pending, r.d_in_flight, r.wait_samples) for r in told] == [(0, 0, 1, 1), (1, 0, 0, 3)]  # delivered again: no row


def test_attempts_keep_their_state_out_of_the_heap(spark, tmp_path, monkeypatch):
    from workfold.catalog import streams as C
    from workfold.catalog.registry import QUERIES
    from workfold.streaming import run as R

    given = {}
    monkeypatch.setattr(C, "drain", lambda stream, label, **how: given.update(how) or drain(stream, label, **how))
    assert QUERIES["stream_attempts"](spark, "/root/testdata/sf0.001").count() == 6 and given == {"machine": True}
    used, names = [], [R.STORE_CONF, *R.BOUNDED]
    before = spark.conf.get(R.STORE_CONF)
    spark.conf.unset(R.STORE_CONF)
    try:
        stream = feed(spark, str(tmp_path / "in"), [[event("QUEUED", 1, 0)]])
        drain(G.stream_attempts(stream), "kept", machine=True, each=lambda b: used.append([b.sparkSession.conf.get(n, None) for n in names]) or b)
        assert used[-1] == [R.ROCKSDB, *R.BOUNDED.values()] and all(spark.conf.get(n, None) is None for n in R.BOUNDED)
    finally:
        spark.conf.set(R.STORE_CONF, before)


def test_a_long_log_is_streamed_in_more_slices():
    from workfold.catalog import streams as C

    assert [C.slices_of(n) for n in (0, 11_000_000, 114_000_000)] == [5, 5, 46] and C.slices_of(70, rows_per_slice=10) == 7
