"""Small logs with known answers."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.logs import by, event, lifecycle, measure
from workfold import model as M
from workfold.functions import exprs as E
from workfold.operators import aggregates as A
from workfold.operators import joins as J
from workfold.operators import journal as Q
from workfold.operators import measures as P
from workfold.operators import ordering as O
from workfold.operators import policy as Y
from workfold.operators import series as S
from workfold.operators import validation as V
from workfold.plans.attempts import attempt_pivot, with_cycle
from workfold.sources.lifecycle import dead_letters, known_events

TASK = "TASK"


def finished(handle, task="ok", at=0):
    return [event("QUEUED", handle, at, task=task), event("STARTED", handle, at + 1, 1, task), event("FINISHED", handle, at + 5, 1, task)]


@pytest.fixture(scope="module")
def g1(spark):
    log = [e for h in (1, 2, 3) for e in finished(h, at=10 * h)]
    log += [event("QUEUED", 4, 50, task="flaky"), event("STARTED", 4, 51, 1, "flaky"), event("FAILED", 4, 52, 1, "flaky", TASK),
            event("RETRIED", 4, 52, 2, "flaky", TASK), event("STARTED", 4, 55, 2, "flaky"), event("FINISHED", 4, 59, 2, "flaky")]
    log += [event("QUEUED", 5, 60, task="dead"), event("STARTED", 5, 61, 1, "dead"), event("FAILED", 5, 62, 1, "dead", TASK),
            event("DEAD_LETTERED", 5, 62, 1, "dead", TASK)]
    return lifecycle(spark, log)


def test_g1_counters(g1):
    rows = by(A.counters(g1), "task")
    total = rows.pop("(total)")
    assert (total["queued"], total["started"], total["finished"], total["failed"]) == (5, 6, 4, 2)
    assert (total["retried"], total["dead_lettered"], total["terminal"], total["cancelled"]) == (1, 1, 5, 0)
    flaky = rows["flaky"]
    assert [flaky[c] for c in ("queued", "started", "finished", "failed", "retried")] == [1, 2, 1, 1, 1]
    assert len(rows) == 3
    gauges = by(A.gauges(g1), "task")["(total)"]
    assert (gauges["pending"], gauges["in_flight"]) == (0, 0)
    assert by(A.run_latency(g1), "task")["(total)"]["run_samples"] == 6
    assert by(A.wait_latency(g1), "task")["(total)"]["wait_samples"] == 6
    assert V.audit_lifecycle(g1).count() == 0
    everything = by(A.statistics(g1), "task")["(total)"]
    assert everything == {**by(A.counters(g1), "task")["(total)"], **gauges, **by(A.run_latency(g1), "task")["(total)"],
                          **by(A.wait_latency(g1), "task")["(total)"]}


def test_g2_gauges(spark):
    log = [event("QUEUED", h, h) for h in range(1, 6)] + [event("STARTED", 1, 10, 1)]
    row = by(A.gauges(lifecycle(spark, log)), "task")["t"]
    assert (row["in_flight"], row["pending"]) == (1, 4)
    log += [event("FAILED", 5, 11, 0, status="CANCELLED"), event("FINISHED", 1, 12, 1)]
    for h in (2, 3, 4):
        log += [event("STARTED", h, 13, 1), event("FINISHED", h, 14, 1)]
    done = lifecycle(spark, log)
    row, counts = by(A.gauges(done), "task")["t"], by(A.counters(done), "task")["t"]
    assert (row["in_flight"], row["pending"]) == (0, 0)
    assert (counts["cancelled"], counts["terminal"], counts["started"]) == (1, 5, 4)


def g3(spark):
    return lifecycle(spark, [
        event("QUEUED", 7, 1000), event("STARTED", 7, 1010, 1), event("FAILED", 7, 1030, 1, status=TASK),
        event("FAILED", 7, 1035, 2, status="CANCELLED"), event("RETRIED", 7, 1030, 2, status=TASK)])


def test_g3_late_retried_moves_nothing(spark):
    log = g3(spark)
    counts = by(A.counters(log), "task")["t"]
    assert [counts[c] for c in ("queued", "started", "failed", "retried", "cancelled", "terminal")] == [1, 1, 2, 1, 1, 1]
    gauges = by(A.gauges(log), "task")["t"]
    assert (gauges["pending"], gauges["in_flight"]) == (0, 0)
    assert by(A.run_latency(log), "task")["t"]["run_samples"] == 1
    assert by(A.wait_latency(log), "task")["t"]["wait_samples"] == 1


def test_series_ends_at_the_gauges_and_ends_free_before_starts(spark):
    log = lifecycle(spark, finished(1, "t", 0) + [event("QUEUED", 2, 2), event("STARTED", 2, 5, 1), event("QUEUED", 3, 4)])
    last = S.inflight_series(log).where("task = 't'").orderBy(F.desc("ts_ms")).first()
    gauges = by(A.gauges(log), "task")["t"]
    assert (last.pending, last.in_flight) == (gauges["pending"], gauges["in_flight"]) == (1, 1)
    assert by(S.inflight_peak(log), "task")["t"]["peak"] == 1


def test_inverted_stamps(spark):
    log = lifecycle(spark, [event("QUEUED", 1, 100), event("STARTED", 1, 90, 1), event("FAILED", 1, 80, 1, status=TASK)])
    wait, run = by(A.wait_latency(log), "task")["t"], by(A.run_latency(log), "task")["t"]
    assert (wait["wait_samples"], wait["wait_ms_sum"]) == (1, 0)
    assert run["run_samples"] == 0


def test_service_started_without_queued_is_in_flight(spark):
    assert by(A.gauges(lifecycle(spark, [event("STARTED", 9, 5, 1)])), "task")["t"]["in_flight"] == 1


def test_g4_retry_rules(spark):
    policies = spark.createDataFrame([("own", 3, 1, "dead_letter"), (None, 1, 0, "requeue")],
                                     "task string, max_retries int, backoff_s int, on_failure string")
    rules = spark.createDataFrame([(None, False, 1, 0), (None, False, 2, M.RETRY_NEVER), (None, False, 3, 500), ("own", False, 2, 40),
                                   (None, True, 0, M.RETRY_NEVER)], "task string, is_start boolean, code long, wait_ms long")
    failures = spark.createDataFrame([
        (1, "other", 1, 1000, TASK, 2, None), (2, "own", 1, 1000, TASK, 3, None), (3, "own", 1, 1000, TASK, 2, None),
        (4, "own", 1, 1000, TASK, 9, None), (5, "own", 4, 1000, TASK, 3, None), (6, "own", 1, 1000, "CANCELLED", None, None),
        (7, "own", 1, 1000, TASK, None, 13), (8, "other", 2, 1000, TASK, 1, None), (9, "other", 2, 1000, TASK, 2, None)],
        "handle long, task string, attempt int, ts_ms long, status string, exit_code int, start_error int")
    got = by(Y.retry_decision(failures, policies, rules), "handle")

    def short(h):
        r = got[h]
        return r["step"], r["next_attempt"], r["due_ms"], r["final"], r["final_status"]

    assert short(1) == ("RETRIED", 2, 1000, "DEAD_LETTERED", "DENIED")
    assert short(2) == ("RETRIED", 2, 2500, None, None)
    assert short(3) == ("RETRIED", 2, 2040, None, None)       # its own rule over the one for any task
    assert short(4) == ("RETRIED", 2, 2000, None, None)       # no rule: as the policy says
    assert short(5) == ("DEAD_LETTERED", None, None, "DEAD_LETTERED", TASK)   # a rule adds no retry
    assert short(6) == ("CANCELLED", None, None, "CANCELLED", "CANCELLED")
    assert short(7) == ("RETRIED", 2, 2000, "DEAD_LETTERED", "DENIED")        # start error
    assert short(8) == ("REQUEUED", 1, 1100, None, None)      # at least 100 ms
    assert short(9) == ("REQUEUED", 1, 1100, "DEAD_LETTERED", "DENIED")


BACKLOG = "handle string, tenant long, priority int, due_ms long, enqueue_ms long, seq long"


def order(df):
    return "".join(r.handle for r in df.orderBy("pos").collect())


def test_g5_orders(spark):
    edf = spark.createDataFrame([("x", 0, 5, None, 0, 1), ("c", 0, 0, 30000, 0, 2), ("a", 0, 0, 1000, 0, 3), ("y", 0, 9, None, 0, 4),
                                 ("b", 0, 0, 5000, 0, 5)], BACKLOG)
    assert order(O.ordered(edf, O.edf_keys())) == "abcyx"
    assert order(O.ordered(edf, O.router_keys())) == "abcyx"
    assert order(O.ordered(edf, O.priority_keys())) == "yxcab"
    aging = spark.createDataFrame([("L", 0, 0, None, 0, 1), ("H", 0, 1, None, 40, 2)], BACKLOG)
    assert order(O.ordered(aging, O.aging_keys(10))) == "LH"
    assert order(O.ordered(aging, O.aging_keys(100))) == "HL"
    huge = spark.createDataFrame([("a", 0, 2**31 - 1, None, 0, 1), ("b", 0, -(2**31), None, 0, 2)], BACKLOG)
    assert order(O.ordered(huge, O.aging_keys(2**32 - 1))) == "ab"
    fair = spark.createDataFrame([("a", 1, 0, None, 0, 1), ("a", 1, 0, None, 0, 2), ("a", 1, 0, None, 0, 3), ("a", 1, 0, None, 0, 4),
                                  ("b", 2, 0, None, 0, 5), ("b", 2, 0, None, 0, 6)], BACKLOG)
    assert order(O.order_fair_share(fair, F.lit(1))) == "ababaa"
    assert order(O.order_fair_share(fair, F.when(F.col("tenant") == 1, 2).otherwise(1))) == "abaaba"
    over = O.fair_overflow(fair, max_tenants=1).first()
    assert (over["items"], over.tenants) == (2, 1)


def test_g5_shed_late(spark):
    items = spark.createDataFrame([(1, 100), (2, 900), (3, None), (4, 0)], "handle long, due_ms long")
    got = by(V.shed_late(items, now_ms=1000, grace_ms=500), "handle")
    assert [got[h]["verdict"] for h in (1, 2, 3, 4)] == ["DENIED", "OK", "OK", "OK"]


def attempt(handle, task, peak=None, method="m1", mem=8 * M.MIB, hit=None, status="OK", cpu=True):
    ms = []
    if peak is not None:
        ms.append(measure("mem.peak", peak, method=method))
    if cpu:
        ms.append(measure("cpu.user_ms", 3, "MS", "TOTAL", "c"))
    if hit is not None:
        ms.append(measure("mem.cap_hit", hit, "FLAG", "FLAG", "cgroup.job"))
    return event("FINISHED" if status == "OK" else "FAILED", handle, handle, 1, task, status, mem, measures=ms or None)


def test_g6_memory_suggestion(spark):
    peak = 40 * M.MIB + 5
    log = [attempt(1, "two", peak), attempt(2, "two", peak)]
    log += [attempt(h, "three", peak) for h in (3, 4, 5)]
    log += [attempt(6, "oom", status="NOMEM")]
    log += [attempt(h, "inproc", cpu=False) for h in (7, 8, 9)]
    log += [attempt(10, "mixed", peak), attempt(11, "mixed", peak * 9, "m2"), attempt(12, "mixed", peak * 9, "m2", hit=1)]
    log += [attempt(13, "cut", peak, status="TIMEOUT"), attempt(14, "cut", peak, status="CANCELLED")]
    rows = by(P.suggest_memory(lifecycle(spark, log), min_samples=3), "task")
    assert rows["two"]["samples"] == 2 and rows["two"]["suggested"] == 0
    grown = int(rows["three"]["suggested"])
    assert peak + peak // 4 <= grown < peak + peak // 4 + M.MIB and grown % M.MIB == 0
    assert rows["oom"]["cap_hits"] == 1 and rows["oom"]["suggested"] == 12 * M.MIB
    assert "inproc" not in rows and "cut" not in rows
    assert rows["mixed"]["method"] == "m1" and rows["mixed"]["other_method"] == 2 and rows["mixed"]["peak"] == peak
    assert rows["mixed"]["samples"] == 2


def test_measures_saturate_and_refuse(spark):
    big = M.U64_MAX - 1
    log = lifecycle(spark, [
        event("FINISHED", 1, 5, 1, measures=[measure("n", big, "COUNT", "TOTAL", "x")]),
        event("FINISHED", 2, 5, 1, measures=[measure("n", 7, "COUNT", "TOTAL", "x")]),
        event("FINISHED", 3, 4, 1, measures=[measure("n", 3, "BYTES", "TOTAL", "x"), measure("y" * 64, 1)])])
    rows = P.measure_rows(log)
    row = by(P.measure_fold(rows, name_bytes=M.NAME_MAX), "task")["t"]
    assert row["sum"] == M.U64_MAX and row["count"] == 2 and row["last"] == 7 and row["min"] == 7
    drops = by(P.measure_drops(rows, name_bytes=M.NAME_MAX), "task")
    assert drops["t"]["dropped_unit"] == 1 and drops["t"]["dropped_name"] == 1 and drops["(total)"]["dropped_unit"] == 1


def test_measure_rows_cap(spark):
    log = lifecycle(spark, [event("FINISHED", i, i, 1, task=f"t{i % 2}", measures=[measure(f"m{i:02d}", i)]) for i in range(40)])
    rows = P.measure_rows(log)
    drops = by(P.measure_drops(rows, max_rows=M.MEASURE_ROWS), "task")
    assert drops["(total)"]["dropped_full"] == 8 and drops["t0"]["dropped_full"] == 0
    assert P.measure_fold(rows).where("task = '(total)'").count() == 40


JCOLS = "file string, pos long, type string, seq long, name string, payload binary, k long, opts struct<priority:int,timeout_ms:long,due_ms:long,flags:int>"


def journal(spark, recs):
    rows = []
    for pos, rec in enumerate(recs):
        kind, seq, k, opts = (*rec, None, None)[:4]
        rows.append(("j", pos, kind, seq, "job" if kind == "P" else None, b"x" if kind == "P" else None, k, opts))
    return spark.createDataFrame(rows, JCOLS)


G7 = [
    ("P", 1), ("S", 1), ("D", 1),                                  # completed
    ("P", 2), ("S", 2),                                            # died once
    ("P", 3), ("K", 3, 1), ("S", 3),                               # died twice: suspect
    ("P", 4), ("K", 4, 2), ("S", 4),                               # three times: quarantined
    ("P", 5), ("K", 5, 2), ("S", 5), ("F", 5),                     # a finished attempt resets
    ("P", 6), ("Q", 6),
    ("P", 4), ("D", 99), ("P", -5), ("Z", 2),                      # stale, unknown, too large, a later type
    ("S", 7), ("P", 7), ("O", 7, None, (3, 50, 900, 1)),           # a marker before its record
]


def test_g7_journal(spark):
    j = journal(spark, G7)
    state = by(Q.journal_replay(j), "seq")
    assert state[1]["done"] and not state[7]["inflight"] and state[5]["crashes"] == 0 and state[3]["inflight"]
    assert state[7]["opts"].due_ms == 900 and state[2]["opts"] is None
    damage = by(V.journal_validate(j), "pos")
    assert {p: r["seq"] for p, r in damage.items()} == {17: 4, 19: -5}
    opened = Q.journal_crash_loop(Q.journal_replay(j))
    assert {s: r["state"] for s, r in by(opened, "seq").items()} == {
        1: "done", 2: "pending", 3: "suspect", 4: "crash-quarantined", 5: "pending", 6: "quarantined", 7: "pending"}
    back = by(Q.journal_recover(opened, now_ms=600), "seq")
    assert sorted(back) == [2, 3, 5, 7] and back[3]["turn"] == 1 and back[2]["turn"] == 0
    assert back[7]["due_in_ms"] == 300 and back[2]["due_in_ms"] is None and back[7]["priority"] == 3
    assert Q.journal_next_seq(j).first().next_seq == 100


def test_g7_compaction_replays_to_the_same_state(spark):
    opened = Q.journal_crash_loop(Q.journal_replay(journal(spark, G7)))
    again = by(Q.journal_replay(Q.journal_compact(opened)), "seq")
    for seq, was in by(opened.where("not done"), "seq").items():
        for c in ("quarantined", "inflight", "crashes", "opts", "payload", "name"):
            assert again[seq][c] == was[c], (seq, c)
    assert 1 not in again
    drained, rest = Q.quarantine_drain(opened)
    assert sorted(r.seq for r in drained.collect()) == [4, 6]
    assert sorted(by(Q.journal_replay(Q.journal_compact(rest)), "seq")) == [2, 3, 5, 7]


def test_journal_apply_events(spark):
    log = lifecycle(spark, [
        event("STARTED", 1, 10, 1), event("FAILED", 1, 20, 1, status=TASK), event("RETRIED", 1, 20, 2), event("STARTED", 1, 30, 2),
        event("FINISHED", 1, 40, 2), event("STARTED", 1, 50, 3),                                   # after its verdict
        event("STARTED", 2, 10, 1), event("DEAD_LETTERED", 2, 20, 1, status="SHUTDOWN", flags=1),  # teardown's, no verdict
        event("FAILED", 3, 10, 1, status="CANCELLED"),                                             # cancelled while it waited
        event("STARTED", 4, 10, 1), event("FAILED", 4, 20, 1, status="CANCELLED", flags=2),        # its own body cancelled it
        event("STARTED", 5, 10, 1), event("FAILED", 5, 20, 1, status=TASK), event("DEAD_LETTERED", 5, 20, 1, status=TASK)])
    records = spark.createDataFrame([("j", h, h) for h in range(1, 6)], "file string, seq long, handle long")
    marks = {}
    for r in Q.journal_apply_events(records, log).orderBy("ts_ms", F.col("type").desc()).collect():
        marks.setdefault(r.seq, []).append(r.type)
    assert {s: sorted(m) for s, m in marks.items()} == {1: ["D", "F", "S", "S"], 2: ["S"], 4: ["D", "F", "S"], 5: ["F", "Q", "S"]}
    gone = spark.createDataFrame([("j", 5), ("j", 2)], "file string, seq long")
    closed = {r.seq: r.type for r in Q.journal_retract(Q.journal_apply_events(records, log), gone).collect()}
    assert closed == {1: "D", 2: "D", 4: "D", 5: "D"}


def test_g8_gates(spark):
    log = lifecycle(spark, finished(1, at=0) + [
        event("QUEUED", 2, 0), event("STARTED", 2, 1, 1), event("FAILED", 2, 9, 1, status=TASK), event("RETRIED", 2, 9, 2),
        event("QUEUED", 3, 0), event("STARTED", 3, 1, 1), event("FAILED", 3, 8, 1, status=TASK), event("DEAD_LETTERED", 3, 30, 1, status=TASK),
        event("DROPPED", 3, 77, 1)])
    gates = spark.createDataFrame([(g, "t") for g in (1, 2, 3, 4, 5, 6)], "gate long, task string")
    deps = spark.createDataFrame([(1, 1), (1, 3), (1, 3), (2, 1), (2, 2), (3, 0), (3, 1), (4, 99), (6, 1)], "gate long, dep long")
    got = by(J.gate_release(gates, deps, log, now_ms=500), "gate")
    assert {g: (r["state"], r["release_ms"]) for g, r in got.items()} == {
        1: ("open", 30), 2: ("pending", None), 3: ("invalid", None), 4: ("pending", None), 5: ("open", 500), 6: ("open", 5)}
    strict = by(J.gate_release_success(gates, deps, log), "gate")
    assert {g: r["state"] for g, r in strict.items()} == {1: "dead", 2: "pending", 3: "pending", 4: "pending", 5: "open", 6: "open"}


def test_gate_outcome(spark):
    released = spark.createDataFrame([(g, "open", 1) for g in range(1, 6)] + [(9, "pending", None)], "gate long, state string, release_ms long")
    screened = spark.createDataFrame([(1, "OK", 1), (2, "NOTFOUND", 3), (3, "FULL", 16), (4, "BUDGET", 1), (5, "NOMEM", 15), (9, "OK", 1)],
                                     "gate long, verdict string, tries int")
    got = by(J.gate_outcome(released, screened, max_tries=16), "gate")
    assert {g: r["result"] for g, r in got.items()} == {1: "submitted", 2: "retry", 3: "stalled", 4: "stalled", 5: "retry"}
    assert by(J.gate_outcome(released, screened), "gate")[3]["result"] == "retry"


def test_g9_ledger(spark):
    ids = ["id-1", "id-2", "id-3", "id-4", "id-5", "bad-1"]
    subs = [(b, 0, i + 1, 0) for i, b in enumerate(ids)] + [(b, 1, i + 11, 100) for i, b in enumerate(ids)]
    facts = [(i + 1, 50, i, TASK, 1, False) for i in range(6)]
    facts += [(i + 11, 150, 20 + i, "OK", 1, True) for i in range(5)]
    facts += [(16, 150, 30, TASK, 1, False), (16, 200, 31, TASK, 1, False)]   # its event, then the drain that declines it
    facts += [(3, 300, 40, TASK, 1, False)]                                  # late, for a handle that is superseded
    got = by(J.ledger(
        spark.createDataFrame(subs, "business_id string, round int, handle long, ts_ms long"),
        spark.createDataFrame(facts, "handle long, ts_ms long, arrival long, status string, attempt int, ok boolean")), "business_id")
    assert [got[b]["state"] for b in ids] == ["recovered"] * 5 + ["dead"]
    assert all(r["closes"] == 1 and r["rounds"] == 1 for r in got.values())
    assert (got["bad-1"]["confirmations"], got["bad-1"]["status"]) == (1, TASK)
    assert (got["id-3"]["confirmations"], got["id-3"]["handle"]) == (0, 13)


JOBS = {"detect_cam0": (300, 2), "detect_cam1": (300, 2), "segment_yard": (360, 2), "llm_summary": (460, 3),
        "classify_plates": (120, 1), "classify_ppe": (120, 1), "reid_flaky": (160, 1), "track_runaway": (100, 1)}
RUN = [("STARTED", "detect_cam0", 0, 1), ("STARTED", "detect_cam1", 0, 1), ("FINISHED", "detect_cam0", 2010, 1), ("STARTED", "segment_yard", 2010, 1),
       ("FINISHED", "detect_cam1", 2011, 1), ("STARTED", "classify_plates", 2011, 1), ("STARTED", "classify_ppe", 2011, 1),
       ("FINISHED", "classify_plates", 3216, 1), ("STARTED", "reid_flaky", 3216, 1), ("FINISHED", "classify_ppe", 3218, 1),
       ("STARTED", "track_runaway", 3218, 1), ("FAILED", "reid_flaky", 3218, 1), ("STARTED", "reid_flaky", 3218, 2),
       ("FAILED", "track_runaway", 3784, 1), ("STARTED", "track_runaway", 3784, 2), ("FINISHED", "reid_flaky", 4225, 2),
       ("FAILED", "track_runaway", 4351, 2), ("DEAD_LETTERED", "track_runaway", 4351, 2), ("FINISHED", "segment_yard", 4523, 1),
       ("STARTED", "llm_summary", 4523, 1), ("FINISHED", "llm_summary", 7538, 1)]


def test_g10_run_report(spark):
    names = list(JOBS)
    log = lifecycle(spark, [event(k, names.index(j), ts, n, j, TASK if k in ("FAILED", "DEAD_LETTERED") else "OK", JOBS[j][0]) for k, j, ts, n in RUN])
    costs = spark.createDataFrame([(j, "gpu", g) for j, (_, g) in JOBS.items()], "task string, name string, cost long")
    budgets = spark.createDataFrame([("memory", 768), ("gpu", 4)], "name string, budget long")
    peaks = by(S.occupancy_peak(S.occupancy_series(log, costs, budgets)), "resource")
    assert (peaks["memory"]["peak"], peaks["gpu"]["peak"]) == (660, 4)
    assert peaks["memory"]["stamps_over"] == peaks["gpu"]["stamps_over"] == 0
    refused = spark.createDataFrame([("too_big", "BUDGET")], "task string, status string")
    got = by(A.run_report(log, by="task", refused=refused), "task")
    assert got["reid_flaky"]["result"] == "finished after a retry" and got["reid_flaky"]["tries"] == 2
    assert got["track_runaway"]["result"] == "dead letter: TASK" and got["track_runaway"]["end_ms"] == 4351
    assert got["too_big"]["result"] == "refused: BUDGET"
    assert sum(r["result"].startswith("finished") for r in got.values()) == 7
    assert sum(m for m, _ in JOBS.values()) == 1920


def test_g11_success_gate(spark):
    gates = spark.createDataFrame([(1, "dependent")], "gate long, task string")
    deps = spark.createDataFrame([(1, 2)], "gate long, dep long")
    for last, state in (("FINISHED", "open"), ("DEAD_LETTERED", "dead")):
        log = lifecycle(spark, [event("QUEUED", 2, 0), event("STARTED", 2, 1, 1), event("FAILED", 2, 2, 1, status=TASK),
                                event("RETRIED", 2, 2, 2), event("STARTED", 2, 3, 2), event(last, 2, 4, 2)])
        assert J.gate_release_success(gates, deps, log).first().state == state


def test_requeue_cycles(spark):
    log = lifecycle(spark, [
        event("QUEUED", 1, 0), event("STARTED", 1, 10, 1), event("FAILED", 1, 20, 1, status=TASK), event("RETRIED", 1, 20, 2),
        event("STARTED", 1, 25, 2), event("FAILED", 1, 30, 2, status=TASK), event("STARTED", 1, 200, 1), event("FINISHED", 1, 210, 1)])
    cycled = with_cycle(log)
    waits = {(r.cycle, r.attempt): r.wait_ms for r in A.cycle_waits(cycled).collect()}
    assert waits == {(1, 1): 10, (1, 2): 5, (2, 1): 180}
    assert {(r.cycle, r.attempt): r.wait_ms for r in A.cycle_waits(cycled, carry=False).collect()}[(2, 1)] is None
    assert attempt_pivot(cycled, ["handle", "cycle"]).count() == 3
    open_again = with_cycle(log.where("ts_ms < 210"))
    assert by(A.gauges(open_again), "task")["t"]["in_flight"] == 1


def test_service_report_retires(spark):
    log = lifecycle(spark, [
        event("STARTED", 1, 0, 1), event("FAILED", 1, 10, 1, status=TASK), event("STARTED", 1, 20, 1), event("FINISHED", 1, 25, 1),
        event("STARTED", 1, 40, 1)])
    row = A.service_report(log).first()
    assert (row.runs, row.clean_exits, row.crashes, row.restarts, row.up_ms) == (3, 1, 1, 2, 15)
    row = A.service_report(log, retire_on_ok=True).first()
    assert (row.runs, row.up_ms, row.stopped_ms) == (2, 15, 25)


def test_dead_letter_cap_zero_and_ties(spark):
    log = lifecycle(spark, [event("DEAD_LETTERED", h, 5, 1, f"t{h % 2}") for h in range(6)])
    assert [r.retained for r in A.dead_letter_counts(log, cap=0).orderBy("task").collect()] == [0, 0]
    kept = by(A.dead_letter_counts(log, cap=3), "task")
    assert (kept["t1"]["retained"], kept["t0"]["retained"]) == (2, 1)   # the later arrivals stay


def test_approx_percentile_matches_exact(spark):
    log = lifecycle(spark, [e for h in range(200) for e in (event("QUEUED", h, 0), event("FINISHED", h, h * 3, 1))])
    exact = {r.pct: r.finish_ms for r in A.exact_percentile(log).collect()}
    approx = {r.pct: r.finish_ms for r in A.approx_percentile(log).collect()}
    assert exact == approx == {50: 297, 95: 567, 99: 591}


def test_histogram_open_bucket(spark):
    log = lifecycle(spark, [event("QUEUED", 1, 0), event("FINISHED", 1, 2**40, 1), event("QUEUED", 2, 0, task="z"), event("FINISHED", 2, 0, 1, "z")])
    got = {(r.task, r.pct): (r.bucket, r.below_ms) for r in A.histogram_percentile(log).collect()}
    assert got[("t", 50)] == (31, None) and got[("z", 99)] == (0, 0)


def test_peak_memory_restarts_with_the_method(spark):
    log = lifecycle(spark, [event("FINISHED", h, h, 1, measures=[measure("mem.peak", v, method=m)])
                            for h, (v, m) in enumerate([(9, "a"), (50, "b"), (7, "a"), (8, "a")])])
    row = P.peak_memory(log).first()
    assert (row.method, row.mem_peak, row.samples) == ("a", 8, 2)


def test_validate_settings_texts(spark):
    schema = spark.createDataFrame([
        ("i", "INT", True, -5.0, 5.0, ""), ("u", "UINT", False, 0.0, 0.0, ""), ("d", "DOUBLE", True, 0.0, 1.0, ""), ("b", "BOOL", False, 0.0, 0.0, ""),
        ("e", "ENUM", False, 0.0, 0.0, "a|b"), ("s", "STRING", False, 0.0, 0.0, "")],
        "key string, type string, has_range boolean, min double, max double, choices string")
    want = [("i", "+5", None), ("i", "6", "out of range"), ("i", " 1", "not a number"), ("i", "0x1", "not a number"),
            ("i", "99999999999999999999999999999999999999999999", "beyond its type"), ("u", "18446744073709551615", None),
            ("u", "18446744073709551616", "beyond its type"), ("u", "-1", "negative"), ("d", ".5", None), ("d", "5.e-1", None), ("d", "inf", "not a number"),
            ("d", "1e999", "beyond its type"), ("d", "1.5", "out of range"), ("b", "True", "not true or false"), ("b", "true", None),
            ("e", "b", None), ("e", "c", "not a choice"), ("s", "x" * 255, None), ("s", "x" * 256, "too long")]
    values = spark.createDataFrame([(n, k, v) for n, (k, v, _) in enumerate(want)], "entity long, key string, value string")
    got = by(V.validate_settings(values, schema), "entity")
    assert [got[n]["problem"] for n in range(len(want))] == [w[2] for w in want]


def test_suggestions_match_brute_force(spark):
    import random

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            diag, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
        return row[-1]

    rnd = random.Random(5)
    known = sorted({"".join(rnd.choice("ab.c") for _ in range(rnd.randrange(1, 26))) for _ in range(60)})
    wanted = sorted({"".join(rnd.choice("ab.c") for _ in range(rnd.randrange(1, 26))) for _ in range(80)})
    got = by(J.suggest_keys(spark.createDataFrame([(k,) for k in wanted], "key string"),
                            spark.createDataFrame([(k, n) for n, k in enumerate(known)], "key string, nth int")), "key")
    want = {}
    for key in wanted:
        best = min((edits(key, k), n, k) for n, k in enumerate(known))
        if best[0] <= max(2, len(key) // 4):
            want[key] = (best[2], best[0])
    assert {k: (r["suggestion"], r["distance"]) for k, r in got.items()} == want


def test_recent_log_tie_puts_the_problem_later(spark):
    log = lifecycle(spark, [event("STARTED", 1, 5, 1), event("FAILED", 1, 5, 1, status=TASK), event("QUEUED", 2, 4)])
    rows = S.recent_log(log, 5, 1, since_ms=0).collect()
    assert [r.kind for r in sorted(rows, key=lambda r: r.pos) if r.pos > 0] == ["FAILED", "STARTED"]
    assert {r["class"]: r.n for r in rows if r.pos == 0} == {"problem": 0, "activity": 1}


def test_deadline_ranks_ties(spark):
    log = lifecycle(spark, [e for h, ms in ((1, 50), (2, 90), (3, 90)) for e in (event("STARTED", h, 0, 1), event("FINISHED", h, ms, 1))])
    policies = spark.createDataFrame([("t", 0)], "task string, timeout_s int")
    items = spark.createDataFrame([(1, None, 10), (2, 80, 40), (3, None, None)], "handle long, due_ms long, timeout_ms long")
    got = {(r.why, r.handle): (r.over_ms, r.rank) for r in S.deadline_overrun(log, policies, items).collect()}
    assert got == {("timeout", 1): (40, 2), ("timeout", 2): (50, 1), ("late", 2): (10, 1)}


def test_u64_helpers(spark):
    from workfold.functions import exprs as E

    df = spark.createDataFrame([(Decimal(M.U64_MAX), -1)], "x decimal(20,0), k long")
    row = df.select(E.plus_pct("x", 25).alias("a"), E.round_mib("x").alias("b"), E.shard_of("k", 10).alias("s"),
                    E.due(F.lit(0), F.lit(0)).alias("d"), E.due(F.lit(2**63 - 1), F.lit(5)).alias("e")).first()
    assert (row.a, row.b, row.s, row.d, row.e) == (M.U64_MAX, M.U64_MAX, M.U64_MAX % 10, 1, 2**63 - 1)


def requeued_log(spark):
    events = [("QUEUED", 0, 0, "OK"), ("STARTED", 1, 10, "OK"), ("FAILED", 1, 20, "TASK"), ("RETRIED", 2, 25, "OK"), ("STARTED", 2, 30, "OK"),
              ("FAILED", 2, 40, "TASK"), ("STARTED", 1, 55, "OK")]
    rows = [(k, 7, "t", a, ts, s, i) for i, (k, a, ts, s) in enumerate(events)] + [("QUEUED", 8, "t", 0, 5, "OK", 50), ("STARTED", 8, "t", 1, 9, "OK", 51), ("FINISHED", 8, "t", 1, 12, "OK", 52)]
    return known_events(spark.createDataFrame(rows, "kind string, handle long, task string, attempt int, ts_ms long, status string, arrival long"))


def test_requeues_count_without_being_asked_for(spark):
    log = requeued_log(spark)
    assert by(A.gauges(log), "task")["t"]["in_flight"] == 1
    waits = by(A.wait_latency(log), "task")["t"]
    assert (waits["wait_samples"], waits["wait_ms_sum"]) == (4, 10 + 5 + 30 + 4)
    runs = by(A.run_latency(log), "task")["t"]
    assert (runs["run_samples"], runs["run_ms_sum"]) == (3, 10 + 10 + 3)
    stats = by(A.statistics(log), "task")["t"]
    assert (stats["in_flight"], stats["wait_samples"], stats["run_samples"], stats["started"]) == (1, 4, 3, 4)
    last = S.inflight_series(log).where("task = 't'").orderBy(F.desc("ts_ms")).first()
    assert (last.pending, last.in_flight) == (0, 1)


def test_nothing_is_cut_unless_asked_for(spark):
    names = [("t", f"m{i:02d}", "x" * 48 + str(i % 2), "COUNT", "TOTAL", 1, i, i, 0) for i in range(33)]
    rows = spark.createDataFrame(names, "task string, name string, method string, unit string, kind string, value int, ts_ms long, arrival long, nth int")
    rows = rows.withColumn("value", F.col("value").cast("decimal(20,0)"))
    assert P.measure_fold(rows).where("task = 't'").count() == 33
    assert P.measure_fold(rows, max_rows=32).where("task = 't'").count() == 32
    assert P.measure_fold(rows.withColumn("name", F.repeat(F.col("name"), F.lit(30)))).where("task = 't'").count() == 33
    long_line = "y" * 600
    got = spark.createDataFrame([(long_line + "\n",)], "tail string").select(E.last_line("tail").alias("all"), E.last_line("tail", 512).alias("cut")).first()
    assert (got["all"], len(got["cut"])) == (long_line, 511)
    key = "k" * 300
    near = J.suggest_keys(spark.createDataFrame([(key + "x" * 70,)], "key string"), spark.createDataFrame([(key, 0)], "key string, nth int")).first()
    assert (near.suggestion, near.distance) == (key, 70)


def test_merged_last_is_the_newest_one(spark):
    schema = "task string, name string, method string, unit string, kind string, count long, sum decimal(20,0), min decimal(20,0), max decimal(20,0), last decimal(20,0), last_ms long, shard int"
    big = 18446744073709551615
    rows = [("t", "n", "m", "u", "k", 1, big, big, big, big, 100, 0), ("t", "n", "m", "u", "k", 1, 7, 7, 7, 7, 101, 1), ("t", "n", "m", "u", "k", 1, 5, 5, 5, 5, 101, 2)]
    from decimal import Decimal
    df = spark.createDataFrame([tuple(Decimal(v) if i in (6, 7, 8, 9) else v for i, v in enumerate(r)) for r in rows], schema)
    assert int(P.merge_measures(df.where("shard < 2")).first()["last"]) == 7
    assert int(P.merge_measures(df, order="shard").first()["last"]) == 5


def test_never_fits_by_memory(spark):
    items = spark.createDataFrame([(1, "a", 10), (2, "a", 99), (3, "b", 1), (4, "c", None)], "handle long, task string, mem_bytes long")
    costs = spark.createDataFrame([("b", "gpu", 5)], "task string, name string, cost long")
    budget = spark.createDataFrame([("gpu", 4)], "name string, budget long")
    assert sorted(r.handle for r in V.never_fits(items, costs, budget, 50).collect()) == [2, 3]


def test_longest_claimed_name_decides_about_a_key(spark):
    keys = ["tasks.my.task.mem", "tasks.a.bogus", "tasks.a.mem", "tasks.a.b.mem", "tasks.a.b.resources.gpu", "tasks.a.b.resources.disk", "tasks.a", "tasks.c.mem",
            "resources.gpu", "resources.d", "task_defaults.mem", "task_defaults.mum", "limits.x", "limits.y", "tasks..mem", "", None, "tasks.my.mem"]
    config = spark.createDataFrame([(1, k, "v") for k in keys], "entity long, key string, value string")
    got = J.unused_keys(config, spark.createDataFrame([("a",), ("my.task",), ("a.b",)], "task string"), spark.createDataFrame([("gpu", 1)], "name string, budget long"),
                        spark.createDataFrame([("limits.x",)], "key string"), ["mem"])
    assert {r.key: r.reason for r in got.collect()} == {
        "tasks.a.bogus": "no such key of a task", "tasks.a.b.resources.disk": "no such resource", "tasks.a": "no such task", "tasks.c.mem": "no such task",
        "resources.d": "no such resource", "task_defaults.mum": "no such key", "limits.y": "no such key", "tasks..mem": "no such task", "": "no such key", "tasks.my.mem": "no such task"}


def test_near_tables_are_within_two_edits_and_longer_than_three(spark):
    keys = spark.createDataFrame([(k,) for k in ("taks.a", "stat.x", "limit.y", "tak.x", "limits.z", "measures.q", "entirely.other", "taks")], "key string")
    tables = spark.createDataFrame([("limits", 0), ("measure", 1), ("stats", 2), ("tasks", 3)], "key string, nth int")
    assert {r.key: r.suggestion for r in J.suggest_tables(keys, tables).collect()} == {"taks": "tasks", "stat": "stats", "limit": "limits", "measures": "measure"}


def test_item_costs_contain_what_the_function_does(spark):
    from workfold.operators.mapping import item_costs

    def cost(payload):
        if payload is None:
            raise SystemExit(3)
        return {"a": 5, "b": None, "c": (7, "DENIED"), "d": -1, "e": "x", "f": 1 << 63, "g": (9, "OK"), "h": True}.get(payload) if payload != "m" else [][1]

    items = spark.createDataFrame([(p, 100, "t", "k") for p in [*"abcdefghm", None]], "payload string, mem_bytes long, task string, _cost string")
    got = {r.payload: (r.mem_bytes, r.cost_status) for r in item_costs(items.drop("_cost"), "payload", cost).collect()}
    assert got == {"a": (5, "OK"), "b": (100, "OK"), "c": (100, "DENIED"), "d": (100, "INVAL"), "e": (100, "INVAL"), "f": (100, "INVAL"), "g": (9, "OK"),
                   "h": (100, "INVAL"), "m": (100, "TASK"), None: (100, "TASK")}


def test_merged_sketches_keep_their_rank_error(spark):
    rows = spark.range(40_000).select((F.col("id") % 3).alias("task"), ((F.col("id") * 7919) % 40_009).alias("v"), (F.col("id") % 10).alias("batch"))
    parts = A.quantile_snapshot(rows, ["task", "batch"], "v")
    merged = A.merge_quantiles(parts, ["task"])
    for r in A.quantiles(merged, (1, 50, 99)).collect():
        rank = rows.where((F.col("task") == r.task) & (F.col("v") <= r.value)).count() / r.n
        assert abs(rank - r.pct / 100) <= 0.007 and r.n >= 13_333
    assert A.quantiles(A.merge_quantiles(parts.limit(0), ["task"])).count() == 0


def test_one_pass_and_ordered_paths_agree(spark):
    from tests.test_streams import random_log
    from workfold.plans.attempts import cycled

    for log in (random_log(5), [e for e in random_log(6) if e[1] % 5]):  # with items that start over, and without
        df = lifecycle(spark, log)
        numbered = cycled(df).cache()
        assert (numbered.agg(F.max("cycle")).first()[0] > 1) == any(e[1] % 5 == 0 for e in log)
        for operator in (A.gauges, A.wait_latency):
            assert by(operator(df), "task") == by(operator(numbered), "task")


def test_dead_letters_are_driven_again_with_what_they_carried(spark):
    log = lifecycle(spark, [event("DEAD_LETTERED", h, 100, 2, status="TASK") for h in (1, 2, 3, 4)])
    items = spark.createDataFrame([(1, 5, 900, b"a"), (2, 6, None, b"b"), (3, 7, 150, b"c"), (4, 8, 50, None)], "handle long, priority int, due_ms long, payload binary")
    rows = spark.createDataFrame([("x", 1, 0), ("y", 2, 2), ("z", 3, 1), ("w", 4, 0)], "business_id string, handle long, rounds int")
    got = by(Y.redrive_plan(rows, dead_letters(log, items), bound=2, now_ms=200, drop_late=True), "business_id")
    assert {k: (r["plan"], r["due_in_ms"], r["priority"], r["payload"]) for k, r in got.items()} == {
        "x": ("resubmit", 700, 5, bytearray(b"a")), "y": ("declined", None, 6, bytearray(b"b")), "z": ("late", None, 7, bytearray(b"c")), "w": ("late", None, 8, None)}
