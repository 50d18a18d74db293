"""Wall time of the headline queries, one JSON line.

The derived log and journal are written once and read back, as a user's would be, so the times
are those of the operators; ``prepare`` is the time of that. Each time is the better of two runs,
so that compiling the plan's code counts once at most. Env: BENCH_SF_DIR, BENCH_CPUS.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from workfold.catalog.inputs import Inputs
from workfold.operators import aggregates as A
from workfold.operators import joins as J
from workfold.operators import journal as Q
from workfold.operators import measures as P
from workfold.operators import ordering as O
from workfold.operators import series as S
from workfold.operators import validation as V
from workfold.session import build_session, fresh_path
from workfold.sources.lifecycle import known_events


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus), spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    fx = Inputs(spark, sf_dir)

    began = time.time()

    def kept(df, label):
        path = fresh_path(spark, f"bench-{label}")
        df.write.parquet(path)
        return spark.read.parquet(path)

    log = known_events(kept(fx.lifecycle, "log"))
    items, journal = kept(fx.items, "items"), kept(fx.journal, "journal")
    prepared = time.time() - began
    budgets = fx.resources.unionByName(fx.rows([("memory", 8000000000)], "name string, budget long"))

    queries = {
        "counters": lambda: A.counters(log),
        "statistics": lambda: A.statistics(log),
        "gauges": lambda: A.gauges(log),
        "wait_latency": lambda: A.wait_latency(log),
        "finish_latency": lambda: A.finish_latency(log),
        "histogram_percentile": lambda: A.histogram_percentile(log),
        "exact_percentile": lambda: A.exact_percentile(log),
        "measure_fold": lambda: P.measure_fold(P.measure_rows(log)),
        "suggest_memory": lambda: P.suggest_memory(log),
        "inflight_series": lambda: S.inflight_series(log),
        "occupancy_series": lambda: S.occupancy_series(log, fx.task_costs, budgets),
        "audit_lifecycle": lambda: V.audit_lifecycle(log),
        "first_terminal": lambda: J.first_terminal(items.select("handle", "task"), log),
        "gate_release": lambda: J.gate_release(fx.gates, items.select(F.col("tenant").alias("gate"), F.col("handle").alias("dep")), log, 1),
        "order_fair_share": lambda: O.order_fair_share(items, F.col("tenant") % 3 + 1),
        "journal_replay": lambda: Q.journal_replay(journal),
        "journal_compact": lambda: Q.journal_compact(Q.journal_crash_loop(Q.journal_replay(journal))),
    }
    def once(build) -> float:
        began = time.time()
        build().write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    def timed(build) -> float:
        return min(once(build), once(build))

    timed(queries["counters"])  # starts the executor threads
    times = {name: timed(build) for name, build in queries.items()}
    rows = log.count()

    # How time grows with the input: the same log twice over, the second time as other items at later stamps.
    span = log.agg(F.max("ts_ms") - F.min("ts_ms") + 1).first()[0]
    twice = kept(log.unionByName(log.withColumns({
        "handle": F.col("handle") + 10**12, "arrival": F.col("arrival") + 10**15, "ts_ms": F.col("ts_ms") + span})), "twice")
    growing = {"counters": A.counters, "wait_latency": A.wait_latency, "measure_fold": lambda x: P.measure_fold(P.measure_rows(x)),
               "occupancy_series": lambda x: S.occupancy_series(x, fx.task_costs, budgets)}
    growth = {}
    for name, op in growing.items():
        growth[name] = round(timed(lambda: op(known_events(twice))) / times[name], 2)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()) + prepared, 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "prepare": round(prepared, 3), "lifecycle_rows": rows,
        "time_ratio_doubled_input": growth,
        "rows_per_sec": {q: round(rows / times[q]) for q in ("counters", "wait_latency", "measure_fold", "occupancy_series")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
