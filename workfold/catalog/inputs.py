"""The derived input tables as Spark plans over the given parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from workfold import model as M
from workfold.plans.deal import dealt
from workfold.plans.running import ordinal

DAY_MS = 86400000
HOUR_MS = 3600000


def _days(c) -> F.Column:
    return F.datediff(F.to_date(c), F.lit("1995-01-01").cast("date")).cast("long")


def _arrival(kind) -> F.Column:
    return F.col("handle") * 1000 + F.col("attempt") * 10 + F.array_position(F.array(*[F.lit(k) for k in M.KINDS[:7]]), kind)


class Inputs:
    """Derived tables for one directory; each is a lazy plan, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, str(sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def rows(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    @cached_property
    def _lines(self) -> int:
        return self.table("lineitem").count()

    def by_handle(self, df: DataFrame) -> DataFrame:
        """Rows of handles, dealt into tasks that hold the lines of no more handles than fit."""
        return dealt(df, self._lines, "handle")

    @cached_property
    def attempts_raw(self) -> DataFrame:
        lines = self.table("lineitem").select(
            (F.col("l_orderkey") + 1).alias("handle"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey",
            "l_extendedprice", "l_returnflag", "l_linestatus", "l_quantity", "l_discount",
        )
        order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
        of_order = Window.partitionBy("handle")  # an order has a handful of lines
        numbered = self.by_handle(lines).withColumns({"attempt": F.row_number().over(of_order.orderBy(*order)), "n_attempts": F.count("*").over(of_order)})
        return numbered.withColumns({"attempt": F.col("attempt").cast("int"), "n_attempts": F.col("n_attempts").cast("int"), "day": _days("l_shipdate")})

    @cached_property
    def _orders(self) -> DataFrame:
        return self.table("orders").select(
            (F.col("o_orderkey") + 1).alias("handle"), F.col("o_orderkey").alias("seq"),
            F.col("o_orderpriority").alias("task"), F.col("o_custkey").alias("tenant"),
            (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
            (F.floor("o_totalprice").cast("long") * 1024).alias("mem_bytes"),
            _days("o_orderdate").alias("order_day"),
        )

    @cached_property
    def items(self) -> DataFrame:
        first = self.table("lineitem").groupBy((F.col("l_orderkey") + 1).alias("handle")).agg(
            _days(F.min("l_shipdate")).alias("day")
        )
        day = F.coalesce("day", "order_day") * DAY_MS
        return self._orders.join(first, "handle", "left").select(
            "handle", "task", "tenant", "priority",
            (day - ((F.col("seq") % 72) - 2) * HOUR_MS).alias("enqueue_ms"),
            F.when(F.col("seq") % 3 != 0, day + (F.col("seq") % 30) * DAY_MS).alias("due_ms"),
            "mem_bytes", "seq",
        )

    @cached_property
    def attempts(self) -> DataFrame:
        start = F.col("day") * DAY_MS + (F.col("attempt") - 1) * HOUR_MS
        return self.attempts_raw.join(self.by_handle(self._orders), "handle").select(
            "handle", "task", "tenant", "attempt", "n_attempts", "mem_bytes",
            start.alias("started_ms"),
            (start + F.col("l_quantity").cast("long") * 60000).alias("ended_ms"),
            F.when(F.col("attempt") < F.col("n_attempts"), "TASK").when(F.col("l_returnflag") == "A", "OK")
            .when(F.col("l_returnflag") == "R", "TASK").otherwise("CANCELLED").alias("status"),
            (F.floor("l_extendedprice").cast("long") * 1024).alias("mem_peak"),
            F.when(F.col("l_linestatus") == "O", "cgroup.job.resident")
            .otherwise("rusage.largest_process.resident").alias("method"),
            F.round(F.col("l_discount") * 100).cast("int").alias("exit_code"),
        )

    @cached_property
    def lifecycle(self) -> DataFrame:
        """All events of all items, in the canonical columns the operators read."""
        last = F.col("attempt") == F.col("n_attempts")
        kinds = F.array_compact(F.array(
            F.lit("STARTED"),
            F.when(F.col("status") == "OK", "FINISHED").otherwise("FAILED"),
            F.when(~last, "RETRIED"),
            F.when(last & (F.col("status") == "TASK"), F.when(F.col("handle") % 2 == 0, "DEAD_LETTERED").otherwise("DROPPED")),
        ))
        ran = self.attempts.withColumn("kind", F.explode(kinds))
        kind = F.col("kind")
        ran = ran.select(
            "kind", "handle", "task",
            F.when(kind == "STARTED", F.col("started_ms")).otherwise(F.col("ended_ms")).alias("ts_ms"),
            F.when(kind == "STARTED", "OK").otherwise(F.col("status")).alias("status"),
            F.when(kind == "RETRIED", F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"),
            "mem_bytes",
            F.when(kind.isin("FINISHED", "FAILED"), self._measure_array).alias("measures"),
            F.when((kind == "FAILED") & (F.col("status") == "TASK"),
                   F.concat(F.lit("loading step "), F.col("attempt").cast("string"), F.lit("\nunit "),
                            (F.col("exit_code") % 3).cast("string"), F.lit(" gave up \n\n"))).alias("stderr_tail"),
        )
        # Dealt as the attempts are, so a fold by handle needs no further shuffle.
        queued = self.by_handle(self.items).select(
            F.lit("QUEUED").alias("kind"), "handle", "task", F.col("enqueue_ms").alias("ts_ms"),
            F.lit("OK").alias("status"), F.lit(0).alias("attempt"), "mem_bytes",
            F.lit(None).cast(ran.schema["measures"].dataType).alias("measures"),
            F.lit(None).cast("string").alias("stderr_tail"),
        )
        # Some cancels come from the item's own body; some items are given up because of a shutdown.
        flags = (F.when((kind == "FAILED") & (F.col("status") == "CANCELLED") & (F.col("handle") % 4 == 1), M.FLAG_SELF_CANCELLED)
                 .when(kind.isin("DROPPED", "DEAD_LETTERED") & (F.col("handle") % 9 == 2), M.FLAG_SHUTDOWN).otherwise(0))
        return queued.unionByName(ran).withColumns({"arrival": _arrival(kind), "flags": flags})

    @cached_property
    def requeued(self) -> DataFrame:
        """The log where every sixth item starts over after each failure in place of being retried, and some end open."""
        again, log = F.col("handle") % 6 == 0, self.lifecycle
        return log.where(~(again & (F.col("kind") == "RETRIED"))).withColumn(
            "attempt", F.when(again, F.least("attempt", F.lit(1))).otherwise(F.col("attempt")))

    @property
    def _measure_array(self) -> F.Column:
        def one(name, value, unit, kind, method):
            return F.struct(F.lit(name).alias("name"), value.cast("decimal(20,0)").alias("value"),
                            F.lit(unit).alias("unit"), F.lit(kind).alias("kind"), method.alias("method"))

        return F.array_compact(F.array(
            one("mem.peak", F.col("mem_peak"), "BYTES", "PEAK", F.col("method")),
            one("cpu.user_ms", (F.col("ended_ms") - F.col("started_ms")) * (1 + F.col("handle") % 3), "MS", "TOTAL",
                F.lit("rusage.process")),
            F.when((F.col("status") == "TASK") & ~F.col("exit_code").isin(7, 9),
                   one("exit.code", F.col("exit_code"), "CODE", "CURRENT", F.lit("posix.wait"))),
            F.when(F.col("method") == "cgroup.job.resident",
                   one("mem.cap_hit", F.when(F.col("mem_peak") > F.col("mem_bytes"), 1).otherwise(0), "FLAG", "FLAG",
                       F.lit("cgroup.job"))),
            # A program ended by a signal, one that never started, and time held back by a cap.
            F.when((F.col("status") == "TASK") & (F.col("exit_code") == 9), one("exit.signal", F.col("exit_code"), "CODE", "CURRENT", F.lit("posix.wait"))),
            F.when((F.col("status") == "TASK") & (F.col("exit_code") == 7), one("start.error", F.lit(2), "CODE", "CURRENT", F.lit("posix.exec"))),
            F.when((F.col("method") == "cgroup.job.resident") & (F.col("handle") % 3 == 0),
                   one("cpu.throttled_ms", F.floor((F.col("ended_ms") - F.col("started_ms")) / 8) * (F.col("handle") % 4), "MS", "TOTAL", F.lit("cgroup.job"))),
        ))

    @cached_property
    def samples(self) -> DataFrame:
        return self.table("events").select(
            (F.col("user_id") + 1).alias("handle"), F.col("event_id").alias("arrival"),
            (_days("ts") * DAY_MS).alias("ts_ms"), F.lit("mem.current").alias("name"),
            F.floor(F.col("value") * 1024).cast("long").alias("value"),
            F.lit("procfs.process.resident").alias("method"),
        )

    @cached_property
    def journal(self) -> DataFrame:
        numbered = ordinal(self.items.select("handle", "task", (F.col("handle") % 4).alias("f")), ["f"], ["handle"], "seq", rows=self._orders.count())
        base = self.by_handle(numbered.select("handle", "task", "seq", F.concat(F.lit("j"), F.col("f").cast("string")).alias("file")))
        seq, handle = F.col("seq"), F.col("handle")

        def rec(pos, kind, s, name=None, k=None, payload=None, opts=None):
            return F.struct(pos.cast("long").alias("pos"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
                            s.cast("long").alias("seq"), (F.lit(None) if name is None else name).cast("string").alias("name"),
                            (F.lit(None) if payload is None else payload).cast("binary").alias("payload"),
                            (F.lit(None) if k is None else k).cast("long").alias("k"), (F.lit(None) if opts is None else opts).cast(M.OPTIONS).alias("opts"))

        def options(priority, due):
            return F.struct(priority.cast("int").alias("priority"), (handle * 10).alias("timeout_ms"), due.alias("due_ms"), (handle % 3).cast("int").alias("flags"))

        due = F.when(handle % 2 == 1, handle * 1000)

        heads = base.select("file", F.inline(F.array_compact(F.array(
            rec(seq * 100, "P", seq, F.col("task"), payload=F.concat("task", F.lit(":"), handle.cast("string"))),
            # Options; some are written again, some before the record they are not for.
            F.when(handle % 6 < 2, rec(seq * 100 + 40, "O", seq, opts=options(handle % 7, due))),
            F.when(handle % 12 == 1, rec(seq * 100 + 41, "O", seq, opts=options(handle % 7 + 100, due))),
            F.when(handle % 10 == 0, rec(seq * 100 - 2, "O", seq, opts=options(handle % 7 + 200, due))),
            F.when(handle % 5 == 0, rec(seq * 100 + 1, "K", seq, None, handle % 4)),
            F.when((handle % 50 == 0) & (seq > 1), rec(seq * 100 + 99, "P", seq - 1, F.lit("stale"))),
        ))))
        last = F.col("attempt") == F.col("n_attempts")
        answer = (F.when(~last | (F.col("status") == "CANCELLED"), "F").when(F.col("status") == "OK", "D")
                  .when(handle % 2 == 0, "Q").otherwise("D"))
        marks = base.select("file", "handle", "seq").join(
            self.attempts.select("handle", "attempt", "n_attempts", "status"), "handle"
        ).select("file", F.inline(F.array_compact(F.array(
            rec(seq * 100 + 2 * F.col("attempt"), "S", seq),
            F.when(~(last & (handle % 7 == 0)), rec(seq * 100 + 2 * F.col("attempt") + 1, answer, seq)),
        ))))
        return heads.unionByName(marks)

    @cached_property
    def config(self) -> DataFrame:
        """Entity, key, value rows as a person would have written them: some fine, some not."""
        entity, c, price, prio = F.col("entity"), F.col("c"), F.col("price"), F.col("prio")
        base = self.table("orders").select(
            F.col("o_orderkey").alias("entity"), F.col("o_custkey").alias("c"),
            F.floor("o_totalprice").cast("long").alias("price"), F.col("o_orderpriority").alias("prio"))

        def text(x):
            return x.cast("string")

        def pair(key, value):
            return F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.alias("value"))

        number = (F.when(c % 5 == 0, F.concat(F.lit(" "), text(c))).when(c % 5 == 1, "0x1f")
                  .when(c % 5 == 2, F.concat(F.lit("-"), text(c))).otherwise(text(c)))
        ratio = F.element_at(F.array(*[F.lit(v) for v in ("0.5", "1e-3", "nan", "1e999", "-0.25", "2")]), (c % 6 + 1).cast("int"))
        pairs = F.array(
            pair(F.concat(F.lit("tasks."), F.when(entity % 9 == 0, F.replace(prio, F.lit("E"), F.lit("3"))).otherwise(prio),
                          F.lit(".max_kb")), text(price)),
            pair("retry.mode", F.lower(F.substr(prio, F.lit(3)))),
            pair(F.when(c % 7 == 0, "dispatch.interva1").otherwise("dispatch.interval"), number),
            pair(F.when(c % 8 == 0, "trace.ration").otherwise("trace.ratio"), ratio),
            pair("audit.on", F.when(entity % 3 == 0, "true").when(entity % 3 == 1, "false").otherwise("yes")),
            pair("serial.first", F.when(entity % 4 == 0, "9223372036854775808").when(entity % 4 == 1, "-9223372036854775808")
                 .otherwise(text(price * entity))),
            pair("label", F.repeat(F.lit("x"), (250 + c % 12).cast("int"))),
            pair(F.concat(F.lit("resources."), F.when(c % 10 == 0, "disk").otherwise("gpu")), text(c)),
            pair(F.element_at(F.array(*[F.lit(k) for k in (
                "tasks.2-HIGH.batch.max_kb", "tasks.2-HIGH.bogus", "tasks.2-HIGH.batch.resources.disk", "tasks.3-MEDIUM.resources.gpu", "taks.1-URGENT.max_kb",
                "resource.gpu", "tasks.2-HIGH.batch.deep.max_kb", "tasks.2-HIGH", "trac.ratio", "tasks.2-HIGHH.max_kb")]), (entity % 10 + 1).cast("int")), text(c)),
        )
        return base.select("entity", F.inline(pairs))

    @cached_property
    def history(self) -> DataFrame:
        month = F.trunc("o_orderdate", "month")
        per = self.table("orders").groupBy(F.col("o_orderpriority").alias("task"), month.alias("m")).agg(
            F.floor(F.max("o_totalprice")).cast("long").alias("top"), F.count("*").alias("n"))
        return per.select("task", "m", F.inline(F.array(
            F.struct(F.lit("max_kb").alias("key"), F.col("top").cast("string").alias("value")),
            F.struct(F.lit("workers").alias("key"), F.col("n").cast("string").alias("value")),
        ))).where(~((F.col("key") == "workers") & (F.month("m") % 3 == 0))).select(
            "task", "key", (_days("m") * DAY_MS).alias("ts_ms"), "value")

    @cached_property
    def gates(self) -> DataFrame:
        names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "none"]
        return self.table("customer").select(
            F.col("c_custkey").alias("gate"),
            F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("c_custkey") % 6 + 1).cast("int")).alias("task"),
            ((F.col("c_custkey") % 600) * 1000000).alias("mem_bytes"))

    @property
    def gate_deps(self) -> DataFrame:
        return self._orders.select(F.col("tenant").alias("gate"), F.col("handle").alias("dep"))

    @cached_property
    def submissions(self) -> DataFrame:
        return self.items.select(
            F.concat(F.lit("b"), F.floor(F.col("seq") / 3).cast("string")).alias("business_id"),
            (F.col("seq") % 3).cast("int").alias("round"), "handle",
            (F.col("enqueue_ms") + (F.col("seq") % 3) * HOUR_MS).alias("ts_ms"))

    @cached_property
    def damaged(self) -> DataFrame:
        """The log with every kind of contract violation written into it."""
        kind, attempt, handle = F.col("kind"), F.col("attempt"), F.col("handle")
        log = self.lifecycle.where(
            ~((kind == "RETRIED") & (attempt == 3) & (handle % 101 == 0)) & ~((kind == "STARTED") & (attempt == 2) & (handle % 103 == 0)))
        twice = kind.isin("FINISHED", "FAILED") & (handle % 223 == 0)
        log = log.withColumns({
            "ts_ms": F.when((kind == "STARTED") & (attempt == 1) & (handle % 97 == 0), F.col("ts_ms") + DAY_MS).otherwise(F.col("ts_ms")),
            "flags": F.when((kind == "FAILED") & (handle % 211 == 0), 1).otherwise(0),
            "measures": F.when(twice, F.concat("measures", "measures")).otherwise(F.col("measures"))})
        again = self.lifecycle.where((kind == "FINISHED") & (handle % 37 == 0)).withColumns({
            "kind": F.lit("DROPPED"), "ts_ms": F.col("ts_ms") + 1, "arrival": F.col("arrival") + 5,
            "measures": F.lit(None).cast(self.lifecycle.schema["measures"].dataType)})
        return log.unionByName(again)

    @property
    def settings_schema(self) -> DataFrame:
        return self.rows([
            (1, "dispatch.interval", "UINT", True, 1.0, 1000.0, "", "50"), (2, "retry.mode", "ENUM", False, 0.0, 0.0, "urgent|high|medium|low", "low"),
            (3, "trace.ratio", "DOUBLE", True, 0.0, 1.0, "", "0.1"), (4, "audit.on", "BOOL", False, 0.0, 0.0, "", "false"),
            (5, "serial.first", "INT", False, 0.0, 0.0, "", "1"), (6, "label", "STRING", False, 0.0, 0.0, "", ""),
            (7, "trace.rate", "DOUBLE", False, 0.0, 0.0, "", "1"),
        ], "nth int, key string, type string, has_range boolean, min double, max double, choices string, dflt string")

    # Rule tables: fixed, a few rows each.
    @property
    def policies(self) -> DataFrame:
        return self.rows([
            ("1-URGENT", 0, 1, 0, "dead_letter", 400000000, False), ("2-HIGH", 1200, 2, 60, "requeue", 300000000, False),
            ("3-MEDIUM", 1800, 3, 0, "drop", 450000000, False), ("4-NOT SPECIFIED", 0, 8, 30, "requeue", 500000000, True),
            ("5-LOW", 2400, 4, 5, "dead_letter", 250000000, False),
        ], "task string, timeout_s int, max_retries int, backoff_s int, on_failure string, max_mem long, paused boolean")

    @property
    def resources(self) -> DataFrame:
        return self.rows([("gpu", 4), ("io", 10)], "name string, budget long")

    @property
    def task_costs(self) -> DataFrame:
        return self.rows([
            ("1-URGENT", "gpu", 2), ("1-URGENT", "io", 1), ("2-HIGH", "gpu", 1), ("3-MEDIUM", "io", 3),
            ("5-LOW", "gpu", 5), ("5-LOW", "io", 2),
        ], "task string, name string, cost long")

    @property
    def retry_rules(self) -> DataFrame:
        return self.rows([
            (None, False, 2, M.RETRY_NEVER), (None, False, 3, 3600000), ("1-URGENT", False, 2, 0),
            (None, True, 0, M.RETRY_NEVER),
        ], "task string, is_start boolean, code long, wait_ms long")
