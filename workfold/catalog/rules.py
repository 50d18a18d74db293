"""Queries: screening, rule tables, gates, ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from workfold.catalog.registry import query
from workfold.functions import exprs as E
from workfold.operators import joins as J
from workfold.operators import validation as V
from workfold.operators.mapping import item_costs
from workfold.plans.pin import pin
from workfold.session import fresh_path
from workfold.sources.lifecycle import read_config

OVER = "over_budget AS (SELECT DISTINCT task FROM task_costs c JOIN resources r ON r.name = c.name WHERE cost > budget)"
NOW = 126230400000


@query("screen_submissions", f"""
WITH {OVER} SELECT handle, CASE WHEN p.paused IS NULL OR p.paused THEN 'NOTFOUND' WHEN i.mem_bytes > p.max_mem THEN 'BUDGET' WHEN o.task IS NOT NULL THEN 'BUDGET' ELSE 'OK' END AS verdict
FROM fx_items i LEFT JOIN policies p ON p.task = i.task LEFT JOIN over_budget o ON o.task = i.task""", ["fx_items", "policies", "task_costs", "resources"])
def _(fx):
    return V.screen_submissions(fx.items, fx.policies, fx.task_costs, fx.resources).select("handle", "verdict")


def cost_by_name(payload):
    """The memory an item asks for, by what its payload says; some say nothing, some cannot be read."""
    task, _, number = payload.rpartition("#")
    n = int(number)
    if n % 11 == 0:
        raise ValueError(payload)
    if n % 13 == 0:
        return None, "DENIED"
    if n % 17 == 0:
        return -1
    return None if n % 5 == 0 else n * 4096 * len(task)


@query("item_costs", f"""
WITH {OVER}, c AS (SELECT handle, task, mem_bytes AS own, CASE WHEN handle % 11 = 0 THEN 'TASK' WHEN handle % 13 = 0 THEN 'DENIED' WHEN handle % 17 = 0 THEN 'INVAL' ELSE 'OK' END AS cost_status FROM fx_items),
m AS (SELECT *, CASE WHEN cost_status = 'OK' AND handle % 5 <> 0 THEN handle * 4096 * length(task) ELSE own END AS mem_bytes FROM c)
SELECT handle, mem_bytes, cost_status, CASE WHEN p.paused IS NULL OR p.paused THEN 'NOTFOUND' WHEN cost_status <> 'OK' THEN cost_status
  WHEN m.mem_bytes > p.max_mem THEN 'BUDGET' WHEN o.task IS NOT NULL THEN 'BUDGET' ELSE 'OK' END AS verdict
FROM m LEFT JOIN policies p ON p.task = m.task LEFT JOIN over_budget o ON o.task = m.task""", ["fx_items", "policies", "task_costs", "resources"])
def _(fx):
    items = fx.items.withColumn("payload", F.concat("task", F.lit("#"), F.col("handle").cast("string")))
    costed = item_costs(items, "payload", cost_by_name)
    return V.screen_submissions(costed, fx.policies, fx.task_costs, fx.resources).select("handle", "mem_bytes", "cost_status", "verdict")


MEMORY = 200_000_000


@query("never_fits", f"WITH {OVER} SELECT handle, task FROM fx_items WHERE mem_bytes > {MEMORY} OR task IN (SELECT task FROM over_budget)", ["fx_items", "task_costs", "resources"])
def _(fx):
    return V.never_fits(fx.items, fx.task_costs, fx.resources, MEMORY).select("handle", "task")


@query("shed_late", f"SELECT handle, due_ms, CASE WHEN {NOW} - due_ms > 86400000 THEN 'DENIED' ELSE 'OK' END AS verdict FROM fx_items", ["fx_items"])
def _(fx):
    return V.shed_late(fx.items, NOW, 86400000).select("handle", "due_ms", "verdict")


@query("validate_settings", "SELECT * FROM fx_checked", ["fx_checked"])
def _(fx):
    return V.validate_settings(fx.config, fx.settings_schema)


@query("src_config_kv", "SELECT entity, key, count(*) AS n FROM fx_config GROUP BY ALL", ["fx_config"])
def _(fx):
    path = fresh_path(fx.spark, "config")
    fx.config.write.parquet(path)
    return read_config(fx.spark, path).groupBy("entity", "key").agg(F.count("*").alias("n"))


@query("audit_lifecycle", """
WITH l AS (SELECT *, greatest(attempt, 1) AS a, (kind IN ('FINISHED','DROPPED','DEAD_LETTERED') OR (kind = 'FAILED' AND status = 'CANCELLED')) AS term FROM fx_damaged),
p AS (SELECT handle, a, min(ts_ms) FILTER (kind = 'STARTED') AS s, min(ts_ms) FILTER (kind IN ('FINISHED','FAILED')) AS e,
  bool_or(kind = 'FAILED' AND status = 'CANCELLED') AS c, bool_or(kind = 'FAILED' AND status <> 'CANCELLED') AS f, bool_or(kind IN ('DROPPED','DEAD_LETTERED')) AS d FROM l GROUP BY handle, a),
x AS (
 SELECT handle, 'many terminal events' AS violation, count(*) AS n FROM l WHERE term GROUP BY handle HAVING count(*) > 1
 UNION ALL SELECT handle, 'no terminal event', 1 FROM l GROUP BY handle HAVING NOT bool_or(term) AND bool_or(kind = 'QUEUED')
 UNION ALL SELECT handle, 'ended before started', count(*) FROM p WHERE e < s GROUP BY handle
 UNION ALL SELECT handle, 'ended without start', count(*) FROM p WHERE e IS NOT NULL AND s IS NULL AND NOT c GROUP BY handle
 UNION ALL SELECT handle, 'failure unanswered', count(*) FROM p WHERE f AND NOT d AND NOT EXISTS (SELECT 1 FROM l r WHERE r.handle = p.handle AND r.kind = 'RETRIED' AND r.attempt = p.a + 1) GROUP BY handle
 UNION ALL SELECT handle, 'attempt missing', max(a) - count(*) FROM p WHERE s IS NOT NULL GROUP BY handle HAVING max(a) <> count(*)
 UNION ALL SELECT handle, 'shutdown flag misplaced', count(*) FROM l WHERE flags = 1 AND kind NOT IN ('DROPPED','DEAD_LETTERED') GROUP BY handle
 UNION ALL SELECT handle, 'measure repeated', count(*) FROM l WHERE twice GROUP BY handle)
SELECT * FROM x""", ["fx_damaged"])
def _(fx):
    return V.audit_lifecycle(fx.damaged)


@query("first_terminal", """
SELECT i.handle, i.task, outcome, o.status, attempt, ended_ms, confirmations FROM fx_items i LEFT JOIN fx_outcomes o ON o.handle = i.handle""", ["fx_items", "fx_outcomes"])
def _(fx):
    return J.first_terminal(fx.items.select("handle", "task"), fx.lifecycle)


REASON = """CASE WHEN status <> 'TASK' THEN 'task cancelled' WHEN exit_code = 7 THEN 'not started (error 2)' WHEN exit_code = 9 THEN 'signal 9' ELSE 'exit ' || exit_code END
  || CASE status WHEN 'TASK' THEN ' · unit ' || (exit_code % 3) || ' gave up' ELSE '' END"""
FAILED = """f AS (SELECT handle, task, attempt, ended_ms AS ts_ms, status, CASE WHEN status = 'TASK' AND exit_code NOT IN (7, 9) THEN exit_code END AS exit_code,
  CASE WHEN status = 'TASK' AND exit_code = 7 THEN 2 END AS start_error FROM fx_attempts WHERE status <> 'OK')"""


def failures(fx):
    """Failed attempts with their exit code, the error of a program that never started, or neither where a signal ended it."""
    code, task = F.col("exit_code"), F.col("status") == "TASK"
    return fx.attempts.where("status <> 'OK'").select(
        "handle", "task", "attempt", F.col("ended_ms").alias("ts_ms"), "status",
        F.when(task & ~code.isin(7, 9), code).alias("exit_code"), F.when(task & (code == 7), F.lit(2)).alias("start_error"))


RULED = """, m AS (SELECT f.*, coalesce(o.wait_ms, g.wait_ms) AS wait_ms FROM f
  LEFT JOIN retry_rules o ON o.task = f.task AND o.is_start = (f.start_error IS NOT NULL) AND (o.is_start OR o.code = f.exit_code)
  LEFT JOIN retry_rules g ON g.task IS NULL AND g.is_start = (f.start_error IS NOT NULL) AND (g.is_start OR g.code = f.exit_code))"""


@query("rule_lookup", f"WITH {FAILED}{RULED} SELECT handle, task, attempt, exit_code, start_error, wait_ms FROM m", ["fx_attempts", "retry_rules"])
def _(fx):
    return J.rule_lookup(failures(fx).drop("ts_ms", "status"), fx.retry_rules)


@query("layer_config", """
WITH w AS (SELECT o_orderkey AS entity, o_orderstatus AS grp, key FROM orders, (VALUES ('dispatch.interval'), ('trace.ratio'), ('audit.on')) k(key)),
sh AS (SELECT * FROM (VALUES ('F', 'dispatch.interval', '77'), ('O', 'dispatch.interval', '5000'), ('F', 'trace.ratio', '0.25'), ('P', 'audit.on', 'true')) s(grp, key, value))
SELECT w.entity, w.key, coalesce(c.value, CASE WHEN sh.value = '5000' THEN NULL ELSE sh.value END, s.dflt) AS value,
 CASE WHEN c.value IS NOT NULL THEN 'own' WHEN sh.value IS NOT NULL AND sh.value <> '5000' THEN 'shared' ELSE 'default' END AS layer
FROM w LEFT JOIN fx_checked c ON c.entity = w.entity AND c.key = w.key AND c.problem IS NULL
LEFT JOIN sh ON sh.grp = w.grp AND sh.key = w.key JOIN settings_schema s ON s.key = w.key""", ["fx_checked"])
def _(fx):
    wanted = fx.table("orders").select(
        F.col("o_orderkey").alias("entity"), F.col("o_orderstatus").alias("grp"),
        F.explode(F.array(*[F.lit(k) for k in ("dispatch.interval", "trace.ratio", "audit.on")])).alias("key"))
    shared = fx.rows([("F", "dispatch.interval", "77"), ("O", "dispatch.interval", "5000"), ("F", "trace.ratio", "0.25"), ("P", "audit.on", "true")],
                     "grp string, key string, value string")
    return J.layer_config(wanted, fx.config, shared, fx.settings_schema)


@query("settings_asof", """
WITH i AS (SELECT handle, task, enqueue_ms, key FROM fx_items, (VALUES ('max_kb'), ('workers')) k(key))
SELECT i.handle, i.task, i.key, h.value FROM i ASOF LEFT JOIN fx_history h ON h.task = i.task AND h.key = i.key AND h.ts_ms <= i.enqueue_ms""", ["fx_items", "fx_history"])
def _(fx):
    return J.settings_asof(fx.items, fx.history, ["max_kb", "workers"])


@query("attach_samples", """
WITH s AS (SELECT handle, CAST(arrival % 5 + 1 AS INT) AS attempt, count(*) AS samples, arg_max(value, ts_ms * 100000 + arrival) AS current, max(ts_ms) AS sampled_ms FROM fx_samples GROUP BY ALL)
SELECT handle, attempt, task, samples, current, sampled_ms FROM fx_attempts JOIN s USING (handle, attempt)""".replace("ts_ms * 100000 + arrival", "CAST(ts_ms AS HUGEINT) * 1000000000 + arrival").replace(
    "GROUP BY ALL", "GROUP BY handle, CAST(arrival % 5 + 1 AS INT)"), ["fx_attempts", "fx_samples"])
def _(fx):
    samples = fx.samples.withColumn("attempt", (F.col("arrival") % 5 + 1).cast("int"))
    return J.attach_samples(fx.attempts.select("handle", "attempt", "task"), samples)


@query("gate_release", """
WITH d AS (SELECT gate, count(*) AS deps, count(ended_ms) AS over, max(ended_ms) AS last FROM fx_gate_deps LEFT JOIN fx_outcomes ON handle = dep GROUP BY gate)
SELECT g.gate, g.task, coalesce(deps, 0) AS deps, coalesce(over, 0) AS over, CASE WHEN coalesce(deps, 0) = coalesce(over, 0) THEN 'open' ELSE 'pending' END AS state,
 CASE WHEN coalesce(deps, 0) = coalesce(over, 0) THEN coalesce(last, 1) END AS release_ms FROM fx_gates g LEFT JOIN d ON d.gate = g.gate""", ["fx_gates", "fx_gate_deps", "fx_outcomes"])
def _(fx):
    return J.gate_release(fx.gates.select("gate", "task"), fx.gate_deps, fx.lifecycle, now_ms=1)


@query("gate_release_success", """
WITH d AS (SELECT gate, count(*) AS deps, count(*) FILTER (outcome = 'FINISHED') AS finished, count(*) FILTER (outcome <> 'FINISHED') AS bad, max(ended_ms) AS last
  FROM fx_gate_deps LEFT JOIN fx_outcomes ON handle = dep GROUP BY gate)
SELECT g.gate, coalesce(deps, 0) AS deps, coalesce(finished, 0) AS finished,
 CASE WHEN coalesce(bad, 0) > 0 THEN 'dead' WHEN coalesce(deps, 0) = coalesce(finished, 0) THEN 'open' ELSE 'pending' END AS state,
 CASE WHEN coalesce(bad, 0) = 0 AND coalesce(deps, 0) = coalesce(finished, 0) THEN coalesce(last, 1) END AS release_ms FROM fx_gates g LEFT JOIN d ON d.gate = g.gate""", ["fx_gates", "fx_gate_deps", "fx_outcomes"])
def _(fx):
    return J.gate_release_success(fx.gates.select("gate"), fx.gate_deps, fx.lifecycle, now_ms=1)


@query("gate_outcome", f"""
WITH {OVER}, d AS (SELECT gate, count(*) AS deps, count(ended_ms) AS over, max(ended_ms) AS last FROM fx_gate_deps LEFT JOIN fx_outcomes ON handle = dep GROUP BY gate),
v AS (SELECT g.gate, nullif(g.gate % 20, 0) AS tries, CASE WHEN p.paused IS NULL OR p.paused THEN 'NOTFOUND' WHEN g.mem_bytes > p.max_mem THEN 'BUDGET' WHEN o.task IS NOT NULL THEN 'BUDGET' ELSE 'OK' END AS verdict
  FROM fx_gates g LEFT JOIN policies p ON p.task = g.task LEFT JOIN over_budget o ON o.task = g.task)
SELECT v.gate, coalesce(last, 1) AS release_ms, verdict, CASE WHEN verdict = 'OK' THEN 'submitted' WHEN verdict = 'NOTFOUND' AND coalesce(tries, 1) < 16 THEN 'retry' ELSE 'stalled' END AS result
FROM v LEFT JOIN d ON d.gate = v.gate WHERE coalesce(deps, 0) = coalesce(over, 0)""", ["fx_gates", "fx_gate_deps", "fx_outcomes", "policies", "task_costs", "resources"])
def _(fx):
    released = J.gate_release(fx.gates.select("gate"), fx.gate_deps, fx.lifecycle, now_ms=1)
    screened = V.screen_submissions(fx.gates, fx.policies, fx.task_costs, fx.resources).select(
        "gate", "verdict", F.nullif(F.col("gate") % 20, F.lit(0)).alias("tries"))
    return J.gate_outcome(released, screened, max_tries=16)


TASK_KEYS = ["max_kb", "max_retries", "on_failure"]
UNUSED = """names AS (SELECT task AS name FROM policies UNION ALL SELECT '2-HIGH.batch'),
k AS (SELECT DISTINCT key FROM fx_config),
o AS (SELECT key, arg_max(substr(key, length(name) + 8), length(name)) AS rest FROM k JOIN names ON starts_with(key, 'tasks.' || name || '.') GROUP BY key),
j AS (SELECT k.key, rest, CASE WHEN key LIKE 'resources.%' THEN substr(key, 11) WHEN rest LIKE 'resources.%' THEN substr(rest, 11) END AS resource FROM k LEFT JOIN o USING (key)),
u AS (SELECT entity, key, value, CASE WHEN resource IS NOT NULL THEN 'no such resource' WHEN rest IS NOT NULL THEN 'no such key of a task'
  WHEN key LIKE 'tasks.%' THEN 'no such task' ELSE 'no such key' END AS reason FROM fx_config JOIN j USING (key)
  WHERE key NOT IN (SELECT key FROM settings_schema) AND coalesce(resource NOT IN (SELECT name FROM resources), TRUE) AND coalesce(rest NOT IN ('max_kb', 'max_retries', 'on_failure'), TRUE))"""


def unused(fx):
    tasks = fx.policies.select("task").union(fx.rows([("2-HIGH.batch",)], "task string"))
    return J.unused_keys(fx.config, tasks, fx.resources, fx.settings_schema, TASK_KEYS)


@query("unused_keys", f"WITH {UNUSED} SELECT * FROM u", ["fx_config", "settings_schema", "policies", "resources"])
def _(fx):
    return unused(fx)


@query("suggest_keys", f"""
WITH {UNUSED}, w AS (SELECT DISTINCT key, reason FROM u),
tables AS (SELECT name, row_number() OVER (ORDER BY name) AS nth FROM (SELECT DISTINCT split_part(key, '.', 1) AS name FROM settings_schema WHERE key LIKE '%.%' UNION SELECT 'tasks' UNION SELECT 'resources')),
p AS (SELECT 'key' AS what, w.key, s.key AS near, nth, levenshtein(w.key, s.key) AS d FROM w, settings_schema s WHERE levenshtein(w.key, s.key) <= greatest(2, length(w.key) // 4)
  UNION ALL SELECT 'task', n.key, name, 0, levenshtein(n.key, name) FROM (SELECT DISTINCT split_part(key, '.', 2) AS key FROM w WHERE reason = 'no such task') n, names WHERE levenshtein(n.key, name) <= 3
  UNION ALL SELECT 'table', f.key, name, nth, levenshtein(f.key, name) FROM (SELECT DISTINCT split_part(key, '.', 1) AS key FROM w WHERE key LIKE '%.%') f, tables
    WHERE length(f.key) > 3 AND f.key NOT IN (SELECT name FROM tables) AND levenshtein(f.key, name) <= 2)
SELECT what, key, near AS suggestion, CAST(d AS INT) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY what, key ORDER BY d, nth, near) = 1""",
       ["fx_config", "settings_schema", "policies", "resources"])
def _(fx):
    rows = pin(unused(fx).select("key", "reason").distinct(), "unused")
    names = rows.where("reason = 'no such task'").select(F.get(F.split("key", r"\."), F.lit(1)).alias("key")).distinct()
    known = fx.policies.select(F.col("task").alias("key")).union(fx.rows([("2-HIGH.batch",)], "key string")).withColumn("nth", F.lit(0))
    own = [r.key for r in fx.settings_schema.where("key LIKE '%.%'").select(F.substring_index("key", ".", 1).alias("key")).distinct().collect()]  # a rule table
    tables = fx.rows([(t, n) for n, t in enumerate(sorted({*own, "tasks", "resources"}))], "key string, nth int")
    found = {"key": J.suggest_keys(rows, fx.settings_schema), "task": J.suggest_names(names, known), "table": J.suggest_tables(rows, tables)}
    out = [df.withColumn("what", F.lit(what)) for what, df in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def terminal_facts(log):
    return log.where(E.terminal()).select("handle", "ts_ms", "arrival", "status", "attempt", (F.col("kind") == "FINISHED").alias("ok"))


LEDGER = """r AS (SELECT a.*, b.ts_ms AS until FROM fx_submissions a LEFT JOIN fx_submissions b ON b.business_id = a.business_id AND b.round = a.round + 1),
m AS (SELECT r.business_id, r.round, r.handle, count(f.handle) AS n, arg_min(f.status, k) AS status, arg_min(f.attempt, k) AS attempts, arg_min(f.kind = 'FINISHED', k) AS ok
  FROM r LEFT JOIN (SELECT *, CAST(ts_ms AS HUGEINT) * 1000000000000 + arrival AS k FROM fx_damaged WHERE kind IN ('FINISHED','DROPPED','DEAD_LETTERED')
    OR (kind = 'FAILED' AND status = 'CANCELLED')) f ON f.handle = r.handle AND (until IS NULL OR f.ts_ms < until) GROUP BY ALL),
g AS (SELECT business_id, arg_max(handle, round) AS handle, max(round) AS rounds, arg_max(n, round) AS n, sum(greatest(n - 1, 0)) AS confirmations FROM m GROUP BY business_id),
led AS (SELECT g.business_id, g.handle, g.rounds, CASE WHEN g.n = 0 THEN 'open' WHEN m.ok THEN 'recovered' ELSE 'dead' END AS state, m.status, m.attempts,
  CAST(g.n > 0 AS BIGINT) AS closes, CAST(g.confirmations AS BIGINT) AS confirmations FROM g JOIN m ON m.business_id = g.business_id AND m.round = g.rounds)"""
LEDGER = LEDGER.replace("GROUP BY ALL", "GROUP BY r.business_id, r.round, r.handle")


@query("ledger", f"WITH {LEDGER} SELECT * FROM led", ["fx_submissions", "fx_damaged"])
def _(fx):
    return J.ledger(fx.submissions, terminal_facts(fx.damaged))


# Column expressions that answer something by themselves.
@query("fn_due", f"""SELECT handle, CASE WHEN due_ms IS NOT NULL THEN greatest(1, due_ms) END AS due_ms, CASE WHEN due_ms IS NOT NULL THEN greatest(0, greatest(1, due_ms) - {NOW}) END AS left_ms FROM fx_items""", ["fx_items"])
def _(fx):
    due = E.due("enqueue_ms", F.col("due_ms") - F.col("enqueue_ms"))
    return fx.items.select("handle", due.alias("due_ms")).withColumn("left_ms", E.remaining("due_ms", F.lit(NOW)))


@query("fn_shard_key", """
SELECT k, CAST((CASE WHEN k < 0 THEN CAST(k AS HUGEINT) + 18446744073709551616 ELSE k END) % 7 AS INT) AS shard, handle + (handle % 4) * 281474976710656 AS id
FROM (SELECT handle, handle - 7500 AS k FROM fx_items)""", ["fx_items"])
def _(fx):
    return fx.items.select((F.col("handle") - 7500).alias("k"), E.pack_id(F.col("handle") % 4, "handle").alias("id")).withColumn("shard", E.shard_of("k", 7))


@query("fn_constraint_combine", """
WITH v AS (SELECT handle, CASE WHEN tenant % 10 = 0 THEN 'DENY' ELSE 'ADMIT' END AS a, CASE WHEN priority < 2 THEN 'DEFER' ELSE 'ADMIT' END AS b, 500 * (seq % 3) AS bd,
  CASE WHEN due_ms IS NULL THEN 'DEFER' ELSE 'ADMIT' END AS c, seq % 1000 AS cd FROM fx_items)
SELECT handle, CASE WHEN a = 'DENY' THEN 'DENY' WHEN b = 'DEFER' OR c = 'DEFER' THEN 'DEFER' ELSE 'ADMIT' END AS verdict,
 CASE WHEN a = 'DENY' OR (b <> 'DEFER' AND c <> 'DEFER') THEN 0 ELSE greatest(1, CASE WHEN b = 'DEFER' THEN bd ELSE 0 END, CASE WHEN c = 'DEFER' THEN cd ELSE 0 END) END AS delay_ms FROM v""", ["fx_items"])
def _(fx):
    verdict, delay = E.combine_verdicts(
        [F.when(F.col("tenant") % 10 == 0, "DENY").otherwise("ADMIT"), F.when(F.col("priority") < 2, "DEFER").otherwise("ADMIT"),
         F.when(F.col("due_ms").isNull(), "DEFER").otherwise("ADMIT")],
        [F.lit(None), 500 * (F.col("seq") % 3), F.col("seq") % 1000])
    return fx.items.select("handle", verdict.alias("verdict"), delay.alias("delay_ms"))


MARKS = """SELECT kind, status, (kind IN ('FINISHED','DROPPED','DEAD_LETTERED') OR (kind = 'FAILED' AND status = 'CANCELLED')) AS terminal,
 CASE WHEN kind IN ('QUEUED','STARTED','FINISHED') THEN 'activity' ELSE 'problem' END AS class,
 CASE status WHEN 'OK' THEN 'ok' WHEN 'TASK' THEN 'task error' ELSE 'task cancelled' END AS text, flags = 1 AS shutdown, count(*) AS n FROM fx_damaged GROUP BY ALL"""


def _marks(fx):
    return fx.damaged.groupBy("kind", "status", E.terminal().alias("terminal"), E.event_class().alias("class"),
                              E.status_text().alias("text"), E.has_flag(1).alias("shutdown")).agg(F.count("*").alias("n"))


for _name, _columns in {"fn_terminal": "kind, status, terminal", "fn_class": "kind, class", "fn_status_text": "status, text", "fn_flags": "kind, shutdown"}.items():
    def _run(fx, columns=_columns):
        return _marks(fx).groupBy(*columns.split(", ")).agg(F.sum("n").alias("n"))

    query(_name, f"SELECT {_columns}, CAST(sum(n) AS BIGINT) AS n FROM ({MARKS}) GROUP BY ALL", ["fx_damaged"])(_run)


@query("fn_measure", """
SELECT handle, attempt, max(value) FILTER (name = 'mem.peak') AS peak, max(value) FILTER (name = 'exit.code') AS exit_code,
 max(value) FILTER (name = 'exit.signal') AS exit_signal, max(value) FILTER (name = 'start.error') AS start_error, max(value) FILTER (name = 'cpu.throttled_ms') AS throttled_ms
FROM fx_measures GROUP BY handle, attempt HAVING count(*) FILTER (name = 'mem.peak') > 0""", ["fx_measures"])
def _(fx):
    ended = fx.lifecycle.where(F.col("kind").isin("FINISHED", "FAILED"))
    names = {"peak": "mem.peak", "exit_code": "exit.code", "exit_signal": "exit.signal", "start_error": "start.error", "throttled_ms": "cpu.throttled_ms"}
    return ended.select("handle", "attempt", *[E.measure(m).cast("long").alias(n) for n, m in names.items()])


@query("fn_why", f"""
SELECT handle, attempt, {REASON} AS why FROM fx_attempts WHERE status <> 'OK'""", ["fx_attempts"])
def _(fx):
    reason = E.why(E.measure("start.error"), E.measure("exit.code"), E.measure("exit.signal"), "status", "stderr_tail")
    return fx.lifecycle.where(F.col("kind") == "FAILED").select("handle", "attempt", reason.alias("why"))


@query("fn_plus_pct", """
SELECT handle, mem_bytes, mem_bytes // 100 * 125 + (mem_bytes % 100) * 125 // 100 AS grown, CAST(ceil(mem_bytes / 1048576) AS BIGINT) * 1048576 AS mib FROM fx_items""", ["fx_items"])
def _(fx):
    return fx.items.select("handle", "mem_bytes", E.plus_pct("mem_bytes", 25).cast("long").alias("grown"), E.round_mib("mem_bytes").cast("long").alias("mib"))
