"""The derived input views as DuckDB SQL, one CTE each, for the side-by-side check."""

from __future__ import annotations


def _days(x: str) -> str:
    return f"date_diff('day', DATE '1995-01-01', CAST({x} AS DATE))"


# name -> (views it reads, SQL). Order matters: a view only reads earlier ones.
VIEWS: dict[str, tuple[list[str], str]] = {
    "fx_attempts_raw": ([], f"""
SELECT l_orderkey + 1 AS handle, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount,
       CAST({_days('l_shipdate')} AS BIGINT) AS day,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS attempt,
       CAST(count(*) OVER (PARTITION BY l_orderkey) AS INT) AS n_attempts
FROM lineitem"""),
    "fx_items": (["fx_attempts_raw"], f"""
SELECT o.o_orderkey + 1 AS handle, o.o_orderpriority AS task, o.o_custkey AS tenant,
       5 - CAST(substr(o.o_orderpriority, 1, 1) AS INT) AS priority,
       coalesce(f.day, CAST({_days('o.o_orderdate')} AS BIGINT)) * 86400000
         - ((o.o_orderkey % 72) - 2) * 3600000 AS enqueue_ms,
       CASE WHEN o.o_orderkey % 3 = 0 THEN NULL
            ELSE coalesce(f.day, CAST({_days('o.o_orderdate')} AS BIGINT)) * 86400000 + (o.o_orderkey % 30) * 86400000 END AS due_ms,
       CAST(floor(o.o_totalprice) AS BIGINT) * 1024 AS mem_bytes,
       o.o_orderkey AS seq
FROM orders o LEFT JOIN (SELECT handle, min(day) AS day FROM fx_attempts_raw GROUP BY handle) f
  ON f.handle = o.o_orderkey + 1"""),
    "fx_attempts": (["fx_attempts_raw", "fx_items"], """
SELECT a.handle, i.task, i.tenant, a.attempt, a.n_attempts, i.mem_bytes,
       a.day * 86400000 + (a.attempt - 1) * 3600000 AS started_ms,
       a.day * 86400000 + (a.attempt - 1) * 3600000 + CAST(a.l_quantity AS BIGINT) * 60000 AS ended_ms,
       CASE WHEN a.attempt < a.n_attempts THEN 'TASK' WHEN a.l_returnflag = 'A' THEN 'OK'
            WHEN a.l_returnflag = 'R' THEN 'TASK' ELSE 'CANCELLED' END AS status,
       CAST(floor(a.l_extendedprice) AS BIGINT) * 1024 AS mem_peak,
       CASE a.l_linestatus WHEN 'O' THEN 'cgroup.job.resident' ELSE 'rusage.largest_process.resident' END AS method,
       CAST(round(a.l_discount * 100) AS INT) AS exit_code
FROM fx_attempts_raw a JOIN fx_items i ON i.handle = a.handle"""),
    "fx_lifecycle": (["fx_items", "fx_attempts"], """
SELECT *, handle * 1000 + attempt * 10 + list_position(['QUEUED','STARTED','FINISHED','FAILED','RETRIED','DEAD_LETTERED','DROPPED'], kind) AS arrival FROM (
SELECT 'QUEUED' AS kind, handle, task, enqueue_ms AS ts_ms, 'OK' AS status, 0 AS attempt, mem_bytes FROM fx_items
UNION ALL SELECT 'STARTED', handle, task, started_ms, 'OK', attempt, mem_bytes FROM fx_attempts
UNION ALL SELECT CASE WHEN status = 'OK' THEN 'FINISHED' ELSE 'FAILED' END, handle, task, ended_ms, status, attempt, mem_bytes FROM fx_attempts
UNION ALL SELECT 'RETRIED', handle, task, ended_ms, status, attempt + 1, mem_bytes FROM fx_attempts WHERE attempt < n_attempts
UNION ALL SELECT CASE WHEN handle % 2 = 0 THEN 'DEAD_LETTERED' ELSE 'DROPPED' END, handle, task, ended_ms, status, attempt, mem_bytes
FROM fx_attempts WHERE attempt = n_attempts AND status = 'TASK')"""),
    "fx_pivot": (["fx_lifecycle"], """
SELECT handle, task, greatest(attempt, 1) AS attempt,
       min(ts_ms) FILTER (kind IN ('QUEUED','RETRIED')) AS queued_ms,
       min(ts_ms) FILTER (kind = 'STARTED') AS started_ms,
       min(ts_ms) FILTER (kind IN ('FINISHED','FAILED')) AS ended_ms,
       min(ts_ms) FILTER (kind IN ('FINISHED','DROPPED','DEAD_LETTERED') OR (kind = 'FAILED' AND status = 'CANCELLED')) AS closed_ms
FROM fx_lifecycle GROUP BY ALL"""),
    # Every sixth item starts over after each failure in place of being retried: a start with attempt 1 is a new cycle.
    "fx_requeued": (["fx_lifecycle"], """
SELECT * REPLACE (CASE WHEN handle % 6 = 0 THEN CAST(least(attempt, 1) AS INT) ELSE attempt END AS attempt),
 CASE WHEN handle % 6 = 0 THEN greatest(attempt, 1) ELSE 1 END AS turn FROM fx_lifecycle WHERE NOT (handle % 6 = 0 AND kind = 'RETRIED')"""),
    "fx_requeued_events": (["fx_requeued"], """
SELECT *, greatest(1, sum(CASE WHEN kind = 'STARTED' AND attempt <= 1 THEN 1 ELSE 0 END) OVER w) AS cycle,
 max(CASE WHEN kind IN ('QUEUED','RETRIED') THEN ts_ms END) OVER (PARTITION BY handle ORDER BY ts_ms, attempt, phase, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS queued_before
FROM (SELECT *, CASE WHEN kind IN ('QUEUED','RETRIED') THEN 0 WHEN kind = 'STARTED' THEN 1 WHEN kind IN ('FINISHED','FAILED') THEN 2 ELSE 3 END AS phase FROM fx_requeued)
WINDOW w AS (PARTITION BY handle ORDER BY ts_ms, attempt, phase, arrival ROWS UNBOUNDED PRECEDING)"""),
    "fx_requeued_pivot": (["fx_requeued_events"], """
SELECT handle, task, cycle, greatest(attempt, 1) AS attempt,
       min(ts_ms) FILTER (kind IN ('QUEUED','RETRIED')) AS queued_ms,
       min(queued_before) FILTER (kind = 'STARTED' AND attempt <= 1 AND cycle > 1) AS base_ms,
       min(ts_ms) FILTER (kind = 'STARTED') AS started_ms,
       min(ts_ms) FILTER (kind IN ('FINISHED','FAILED')) AS ended_ms,
       min(ts_ms) FILTER (kind IN ('FINISHED','DROPPED','DEAD_LETTERED') OR (kind = 'FAILED' AND status = 'CANCELLED')) AS closed_ms
FROM fx_requeued_events GROUP BY ALL"""),
    "fx_requeued_state": (["fx_requeued_events"], """
SELECT handle, task, CASE WHEN is_over THEN 'over' WHEN reached % 4 = 1 THEN 'in_flight' WHEN reached % 4 = 0 THEN 'pending' ELSE 'limbo' END AS state FROM (
 SELECT handle, task, max(cycle * 1000000 + greatest(attempt, 1) * 4 + least(phase, 2)) AS reached,
  bool_or(kind IN ('FINISHED','DROPPED','DEAD_LETTERED') OR (kind = 'FAILED' AND status = 'CANCELLED')) AS is_over FROM fx_requeued_events GROUP BY handle, task)"""),
    "fx_measures": (["fx_attempts"], """
SELECT *, handle * 1000 + attempt * 10 + CASE WHEN status = 'OK' THEN 3 ELSE 4 END AS arrival,
 list_position(['mem.peak','cpu.user_ms','exit.code','mem.cap_hit','exit.signal','start.error','cpu.throttled_ms'], name) AS nth FROM (
SELECT handle, task, attempt, status, mem_bytes, ended_ms AS ts_ms, 'mem.peak' AS name, mem_peak AS value, 'BYTES' AS unit, 'PEAK' AS kind, method FROM fx_attempts
UNION ALL SELECT handle, task, attempt, status, mem_bytes, ended_ms, 'cpu.user_ms', (ended_ms - started_ms) * (1 + handle % 3), 'MS', 'TOTAL', 'rusage.process' FROM fx_attempts
UNION ALL SELECT handle, task, attempt, status, mem_bytes, ended_ms, 'exit.code', CAST(exit_code AS BIGINT), 'CODE', 'CURRENT', 'posix.wait' FROM fx_attempts WHERE status = 'TASK' AND exit_code NOT IN (7, 9)
UNION ALL SELECT handle, task, attempt, status, mem_bytes, ended_ms, 'exit.signal', CAST(exit_code AS BIGINT), 'CODE', 'CURRENT', 'posix.wait' FROM fx_attempts WHERE status = 'TASK' AND exit_code = 9
UNION ALL SELECT handle, task, attempt, status, mem_bytes, ended_ms, 'start.error', 2, 'CODE', 'CURRENT', 'posix.exec' FROM fx_attempts WHERE status = 'TASK' AND exit_code = 7
UNION ALL SELECT handle, task, attempt, status, mem_bytes, ended_ms, 'cpu.throttled_ms', (ended_ms - started_ms) // 8 * (handle % 4), 'MS', 'TOTAL', 'cgroup.job' FROM fx_attempts WHERE method = 'cgroup.job.resident' AND handle % 3 = 0
UNION ALL SELECT handle, task, attempt, status, mem_bytes, ended_ms, 'mem.cap_hit', CASE WHEN mem_peak > mem_bytes THEN 1 ELSE 0 END, 'FLAG', 'FLAG', 'cgroup.job' FROM fx_attempts WHERE method = 'cgroup.job.resident')"""),
    "fx_samples": ([], f"""
SELECT user_id + 1 AS handle, event_id AS arrival, CAST({_days('ts')} AS BIGINT) * 86400000 AS ts_ms,
       'mem.current' AS name, CAST(floor(value * 1024) AS BIGINT) AS value, 'procfs.process.resident' AS method
FROM events"""),
    "fx_journal": (["fx_items", "fx_attempts"], """
SELECT * REPLACE ('j' || file AS file) FROM (WITH s AS (SELECT handle, task, handle % 4 AS f, row_number() OVER (PARTITION BY handle % 4 ORDER BY handle) AS seq,
  {'priority': CAST(handle % 7 AS INT), 'timeout_ms': handle * 10, 'due_ms': CASE WHEN handle % 2 = 1 THEN handle * 1000 END, 'flags': CAST(handle % 3 AS INT)} AS o FROM fx_items)
SELECT f AS file, seq * 100 AS pos, 'P' AS type, seq, task AS name, CAST(NULL AS BIGINT) AS k, task || ':' || handle AS payload,
  CAST(NULL AS STRUCT(priority INT, timeout_ms BIGINT, due_ms BIGINT, flags INT)) AS opts FROM s
UNION ALL SELECT f, seq * 100 + 1, 'K', seq, NULL, handle % 4, NULL, NULL FROM s WHERE handle % 5 = 0
UNION ALL SELECT s.f, s.seq * 100 + 2 * a.attempt, 'S', s.seq, NULL, NULL, NULL, NULL FROM s JOIN fx_attempts a ON a.handle = s.handle
UNION ALL SELECT s.f, s.seq * 100 + 2 * a.attempt + 1,
       CASE WHEN a.attempt < a.n_attempts OR a.status = 'CANCELLED' THEN 'F' WHEN a.status = 'OK' THEN 'D'
            WHEN a.handle % 2 = 0 THEN 'Q' ELSE 'D' END, s.seq, NULL, NULL, NULL, NULL
FROM s JOIN fx_attempts a ON a.handle = s.handle WHERE NOT (a.attempt = a.n_attempts AND a.handle % 7 = 0)
UNION ALL SELECT f, seq * 100 + 99, 'P', seq - 1, 'stale', NULL, NULL, NULL FROM s WHERE handle % 50 = 0 AND seq > 1
UNION ALL SELECT f, seq * 100 + 40, 'O', seq, NULL, NULL, NULL, o FROM s WHERE handle % 6 < 2
UNION ALL SELECT f, seq * 100 + 41, 'O', seq, NULL, NULL, NULL, struct_update(o, priority := CAST(o.priority + 100 AS INT)) FROM s WHERE handle % 12 = 1
UNION ALL SELECT f, seq * 100 - 2, 'O', seq, NULL, NULL, NULL, struct_update(o, priority := CAST(o.priority + 200 AS INT)) FROM s WHERE handle % 10 = 0)"""),
    "fx_config": ([], """
SELECT entity, key, value FROM (SELECT o_orderkey AS entity, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderpriority AS prio FROM orders) o,
LATERAL (VALUES
 ('tasks.' || CASE WHEN entity % 9 = 0 THEN replace(prio, 'E', '3') ELSE prio END || '.max_kb', CAST(price AS VARCHAR)),
 ('retry.mode', lower(substr(prio, 3))),
 (CASE WHEN c % 7 = 0 THEN 'dispatch.interva1' ELSE 'dispatch.interval' END, CASE c % 5 WHEN 0 THEN ' ' || c WHEN 1 THEN '0x1f' WHEN 2 THEN '-' || c ELSE CAST(c AS VARCHAR) END),
 (CASE WHEN c % 8 = 0 THEN 'trace.ration' ELSE 'trace.ratio' END, CASE c % 6 WHEN 0 THEN '0.5' WHEN 1 THEN '1e-3' WHEN 2 THEN 'nan' WHEN 3 THEN '1e999' WHEN 4 THEN '-0.25' ELSE '2' END),
 ('audit.on', CASE entity % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'yes' END),
 ('serial.first', CASE entity % 4 WHEN 0 THEN '9223372036854775808' WHEN 1 THEN '-9223372036854775808' ELSE CAST(price * entity AS VARCHAR) END),
 ('label', repeat('x', CAST(250 + c % 12 AS INT))),
 ('resources.' || CASE WHEN c % 10 = 0 THEN 'disk' ELSE 'gpu' END, CAST(c AS VARCHAR)),
 (['tasks.2-HIGH.batch.max_kb', 'tasks.2-HIGH.bogus', 'tasks.2-HIGH.batch.resources.disk', 'tasks.3-MEDIUM.resources.gpu', 'taks.1-URGENT.max_kb',
   'resource.gpu', 'tasks.2-HIGH.batch.deep.max_kb', 'tasks.2-HIGH', 'trac.ratio', 'tasks.2-HIGHH.max_kb'][entity % 10 + 1], CAST(c AS VARCHAR))) t(key, value)"""),
    "settings_schema": ([], """
SELECT * FROM (VALUES (1, 'dispatch.interval', 'UINT', TRUE, 1.0, 1000.0, '', '50'), (2, 'retry.mode', 'ENUM', FALSE, 0.0, 0.0, 'urgent|high|medium|low', 'low'),
 (3, 'trace.ratio', 'DOUBLE', TRUE, 0.0, 1.0, '', '0.1'), (4, 'audit.on', 'BOOL', FALSE, 0.0, 0.0, '', 'false'),
 (5, 'serial.first', 'INT', FALSE, 0.0, 0.0, '', '1'), (6, 'label', 'STRING', FALSE, 0.0, 0.0, '', ''), (7, 'trace.rate', 'DOUBLE', FALSE, 0.0, 0.0, '', '1'))
 AS s(nth, key, type, has_range, min, max, choices, dflt)"""),
    "fx_checked": (["fx_config", "settings_schema"], """
SELECT entity, key, value, CASE WHEN length(value) >= 256 THEN 'too long'
 WHEN type IN ('INT', 'UINT') AND NOT regexp_full_match(value, '[+-]?[0-9]+') THEN 'not a number'
 WHEN type = 'UINT' AND value LIKE '-%' THEN 'negative'
 WHEN type = 'INT' AND (TRY_CAST(value AS HUGEINT) IS NULL OR TRY_CAST(value AS HUGEINT) NOT BETWEEN -9223372036854775808 AND 9223372036854775807) THEN 'beyond its type'
 WHEN type = 'UINT' AND (TRY_CAST(value AS HUGEINT) IS NULL OR TRY_CAST(value AS HUGEINT) > 18446744073709551615) THEN 'beyond its type'
 WHEN type = 'DOUBLE' AND NOT regexp_full_match(value, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'not a number'
 WHEN type = 'DOUBLE' AND (TRY_CAST(value AS DOUBLE) IS NULL OR isinf(TRY_CAST(value AS DOUBLE))) THEN 'beyond its type'
 WHEN type IN ('INT', 'UINT', 'DOUBLE') AND has_range AND TRY_CAST(value AS DOUBLE) NOT BETWEEN min AND max THEN 'out of range'
 WHEN type = 'BOOL' AND value NOT IN ('true', 'false') THEN 'not true or false'
 WHEN type = 'ENUM' AND NOT list_contains(string_split(choices, '|'), value) THEN 'not a choice' END AS problem
FROM fx_config JOIN settings_schema USING (key)"""),
    "fx_history": ([], f"""
SELECT task, key, ts_ms, value FROM (SELECT o_orderpriority AS task, date_trunc('month', o_orderdate) AS m, CAST(floor(max(o_totalprice)) AS BIGINT) AS top, count(*) AS n
  FROM orders GROUP BY ALL), LATERAL (VALUES ('max_kb', CAST(top AS VARCHAR)), ('workers', CAST(n AS VARCHAR))) v(key, value),
  LATERAL (SELECT CAST({_days('m')} AS BIGINT) * 86400000 AS ts_ms)
WHERE NOT (key = 'workers' AND month(m) % 3 = 0)"""),
    "fx_gates": ([], """
SELECT c_custkey AS gate, CASE c_custkey % 6 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED'
 WHEN 4 THEN '5-LOW' ELSE 'none' END AS task, (c_custkey % 600) * 1000000 AS mem_bytes FROM customer"""),
    "fx_gate_deps": (["fx_items"], "SELECT tenant AS gate, handle AS dep FROM fx_items"),
    "fx_outcomes": (["fx_lifecycle"], """
SELECT handle, arg_min(kind, k) AS outcome, arg_min(status, k) AS status, arg_min(attempt, k) AS attempt, min(ts_ms) AS ended_ms, count(*) - 1 AS confirmations
FROM (SELECT *, CAST(ts_ms AS HUGEINT) * 1000000000000 + arrival AS k FROM fx_lifecycle
  WHERE kind IN ('FINISHED','DROPPED','DEAD_LETTERED') OR (kind = 'FAILED' AND status = 'CANCELLED')) GROUP BY handle"""),
    "fx_submissions": (["fx_items"], """
SELECT 'b' || (seq // 3) AS business_id, CAST(seq % 3 AS INT) AS round, handle, enqueue_ms + (seq % 3) * 3600000 AS ts_ms FROM fx_items"""),
    "fx_damaged": (["fx_lifecycle"], """
SELECT kind, handle, task, CASE WHEN kind = 'STARTED' AND attempt = 1 AND handle % 97 = 0 THEN ts_ms + 86400000 ELSE ts_ms END AS ts_ms, status, attempt, arrival,
 CASE WHEN kind = 'FAILED' AND handle % 211 = 0 THEN 1 ELSE 0 END AS flags, kind IN ('FINISHED', 'FAILED') AND handle % 223 = 0 AS twice
FROM fx_lifecycle WHERE NOT (kind = 'RETRIED' AND attempt = 3 AND handle % 101 = 0) AND NOT (kind = 'STARTED' AND attempt = 2 AND handle % 103 = 0)
UNION ALL SELECT 'DROPPED', handle, task, ts_ms + 1, status, attempt, arrival + 5, 0, FALSE FROM fx_lifecycle WHERE kind = 'FINISHED' AND handle % 37 = 0"""),
    "fx_state": (["fx_journal"], """
SELECT p.file, p.seq, p.name, coalesce(bool_or(m.type = 'D'), FALSE) AS done, coalesce(bool_or(m.type = 'Q'), FALSE) AS quarantined,
 coalesce(arg_max(m.type, m.pos) FILTER (m.type IN ('S','F')) = 'S', FALSE) AS inflight,
 coalesce(arg_max(CASE WHEN m.type = 'K' THEN m.k ELSE 0 END, m.pos) FILTER (m.type IN ('K','F')), 0) AS crashes,
 any_value(p.payload) AS payload, arg_max(m.opts, m.pos) FILTER (m.type = 'O') AS opts
FROM (SELECT * FROM (SELECT *, max(CASE WHEN type = 'P' THEN seq END) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
  FROM fx_journal) WHERE type = 'P' AND seq > coalesce(above, 0)) p
LEFT JOIN fx_journal m ON m.file = p.file AND m.seq = p.seq AND m.type <> 'P' AND m.pos > p.pos GROUP BY p.file, p.seq, p.name"""),
    "fx_opened": (["fx_state"], """
SELECT file, seq, name, payload, opts, done, quarantined OR state = 'crash-quarantined' AS quarantined, inflight AND (done OR quarantined) AS inflight, n AS crashes, state FROM (
 SELECT *, CASE WHEN done THEN 'done' WHEN quarantined THEN 'quarantined' WHEN n >= 3 THEN 'crash-quarantined' WHEN n >= 2 THEN 'suspect' ELSE 'pending' END AS state
 FROM (SELECT *, crashes + CASE WHEN inflight AND NOT done AND NOT quarantined THEN 1 ELSE 0 END AS n FROM fx_state))"""),
    # Small rule tables used by the queries that need them.
    "policies": ([], """
SELECT * FROM (VALUES ('1-URGENT', 0, 1, 0, 'dead_letter', 400000000, FALSE), ('2-HIGH', 1200, 2, 60, 'requeue', 300000000, FALSE),
 ('3-MEDIUM', 1800, 3, 0, 'drop', 450000000, FALSE), ('4-NOT SPECIFIED', 0, 8, 30, 'requeue', 500000000, TRUE),
 ('5-LOW', 2400, 4, 5, 'dead_letter', 250000000, FALSE)) AS p(task, timeout_s, max_retries, backoff_s, on_failure, max_mem, paused)"""),
    "resources": ([], "SELECT * FROM (VALUES ('gpu', 4), ('io', 10)) AS r(name, budget)"),
    "task_costs": ([], """
SELECT * FROM (VALUES ('1-URGENT', 'gpu', 2), ('1-URGENT', 'io', 1), ('2-HIGH', 'gpu', 1), ('3-MEDIUM', 'io', 3),
 ('5-LOW', 'gpu', 5), ('5-LOW', 'io', 2)) AS c(task, name, cost)"""),
    "retry_rules": ([], """
SELECT * FROM (VALUES (NULL, FALSE, 2, 4294967295), (NULL, FALSE, 3, 3600000), ('1-URGENT', FALSE, 2, 0),
 (NULL, TRUE, 0, 4294967295)) AS r(task, is_start, code, wait_ms)"""),
}


def with_views(sql: str, names: list[str]) -> str:
    """The query with every view it needs, as CTEs."""
    need: set[str] = set()

    def add(name: str) -> None:
        for dep in VIEWS[name][0]:
            add(dep)
        need.add(name)

    for name in names:
        add(name)
    ctes = [f"{name} AS ({VIEWS[name][1]})" for name in VIEWS if name in need]
    sql = sql.strip()
    if not ctes:
        return sql
    if sql.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + sql
