"""Outcomes, rules, layers, gates and ledgers: facts brought together by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workfold import model as M
from workfold.functions.exprs import code_of, name_of, point, terminal
from workfold.operators.validation import setting_problem
from workfold.plans.pin import pin
from workfold.plans.running import UPTO, running
from workfold.plans.short import rule_table

ENDS = ["FINISHED", "FAILED", "DEAD_LETTERED", "DROPPED"]
STATUSES = list(M.STATUS_TEXT)


def end_facts(lifecycle: DataFrame) -> DataFrame:
    """Terminal events as numbers, so that they aggregate by hash; a stream keeps its event time ``ts``."""
    return lifecycle.where(terminal()).select(
        "handle", "ts_ms", "attempt", point().alias("_at"),
        code_of("kind", ENDS).alias("_kind"), code_of("status", STATUSES).alias("_status"), *(["ts"] if "ts" in lifecycle.columns else []))


def first_end(ends: DataFrame, keys: list) -> DataFrame:
    """The first of the ``end_facts`` of each key, and how many there are (``n``)."""
    return ends.groupBy(*keys).agg(
        F.min("_at").alias("_at"), F.min("ts_ms").alias("ended_ms"), F.min_by("attempt", "_at").alias("attempt"),
        F.min_by("_kind", "_at").alias("_kind"), F.min_by("_status", "_at").alias("_status"), F.count("*").alias("n"))


def named_end(first: DataFrame) -> DataFrame:
    return first.select("handle", name_of("_kind", ENDS).alias("outcome"), name_of("_status", STATUSES).alias("status"),
                        "attempt", "ended_ms", (F.col("n") - 1).alias("confirmations"))


def outcomes(lifecycle: DataFrame) -> DataFrame:
    """The first terminal event of every handle that has one, and how many repeats confirmed it."""
    return named_end(first_end(end_facts(lifecycle), ["handle"]))


def first_terminal(handles: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """What became of each handle asked for; NULL while it is open."""
    return handles.join(outcomes(lifecycle), "handle", "left")


def rule_lookup(failures: DataFrame, rules: DataFrame) -> DataFrame:
    """The retry rule for each failure: its task's own, else the one for any task.

    A start failure looks only at start rules, whatever its code.
    """
    def side(rows: DataFrame, extra: list[str], out: str) -> DataFrame:
        # a start rule is found by the flag alone
        code = F.when(F.col("is_start"), F.lit(-1).cast("long")).otherwise(F.col("code"))
        return rows.select(*extra, F.col("is_start").alias("_start"), code.alias("_code"), F.col("wait_ms").alias(out))

    own = side(rules.where("task is not null"), ["task"], "_own")
    general = side(rules.where("task is null"), [], "_any")
    keyed = failures.withColumns({
        "_start": F.col("start_error").isNotNull(),
        "_code": F.when(F.col("start_error").isNotNull(), F.lit(-1).cast("long")).otherwise(F.col("exit_code").cast("long"))})
    return keyed.join(own, ["task", "_start", "_code"], "left").join(general, ["_start", "_code"], "left").select(
        *failures.columns, F.coalesce("_own", "_any").alias("wait_ms"))


def layer_config(wanted: DataFrame, own: DataFrame, shared: DataFrame, schema: DataFrame) -> DataFrame:
    """Effective value per (entity, key): its own, else its group's, else the compiled default.

    A value that breaks its rule counts as absent. ``wanted`` holds entity, grp and key.
    """
    rules = rule_table(schema.select("key", "type", "has_range", "min", "max", "choices", "dflt"))

    def valid(layer: DataFrame, by: str, out: str) -> DataFrame:
        checked = layer.join(rules, "key")
        return checked.where(setting_problem(F.col("value"), F.col).isNull()).select(by, "key", F.col("value").alias(out))

    joined = (wanted.join(valid(own, "entity", "_own").hint("merge"), ["entity", "key"], "left")
              .join(rule_table(valid(shared, "grp", "_shared")), ["grp", "key"], "left")
              .join(rules.select("key", "dflt"), "key"))
    layer = (F.when(F.col("_own").isNotNull(), "own").when(F.col("_shared").isNotNull(), "shared").otherwise("default"))
    return joined.select("entity", "key", F.coalesce("_own", "_shared", "dflt").alias("value"), layer.alias("layer"))


def settings_asof(items: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """The value of each key in force when each item was submitted (a change at that instant counts).

    Changes and reads are one stream per (task, key); the latest change so far is a running
    maximum, which is carried over cells, so one task with most of the items is split.
    """
    changes = history.select("task", "key", "ts_ms", F.lit(0).alias("_read"), F.lit(None).cast("long").alias("handle"),
                             F.struct("ts_ms", "value").alias("_set"))
    reads = items.select("task", F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"),
                         F.col("enqueue_ms").alias("ts_ms"), F.lit(1).alias("_read"), "handle",
                         F.lit(None).cast(changes.schema["_set"].dataType).alias("_set"))
    line = changes.unionByName(reads).withColumn("_who", F.coalesce("handle", F.lit(0)))
    run = running(line, ["task", "key"], ["ts_ms", "_read", "_who"], {"_now": ("max", F.col("_set"), UPTO)})
    return run.where("_read = 1").select("handle", "task", "key", F.col("_now.value").alias("value"))


def attach_samples(attempts: DataFrame, samples: DataFrame, name: str = "mem.current") -> DataFrame:
    """Each attempt with how often it was sampled and its latest sample. Samples fold before the join."""
    folded = samples.where(F.col("name") == name).groupBy("handle", "attempt").agg(
        F.count("*").alias("samples"), F.max_by("value", point()).alias("current"), F.max("ts_ms").alias("sampled_ms"))
    return attempts.join(folded, ["handle", "attempt"])


def _edges(gate_deps: DataFrame, lifecycle: DataFrame) -> DataFrame:
    return gate_deps.select("gate", "dep").distinct().join(
        outcomes(lifecycle).select(F.col("handle").alias("dep"), "outcome", "ended_ms"), "dep", "left")


def gate_release(gates: DataFrame, gate_deps: DataFrame, lifecycle: DataFrame, now_ms: int | None = None) -> DataFrame:
    """When each gate opens: once every distinct dependency is over, whatever its outcome.

    No dependency: open now. Dependency 0: invalid. One never seen: pending for ever.
    """
    per = _edges(gate_deps, lifecycle).groupBy("gate").agg(
        F.count("*").alias("deps"), F.count("ended_ms").alias("over"), F.max("ended_ms").alias("last_ms"),
        F.max(F.col("dep") == 0).alias("invalid"))
    joined = gates.join(per, "gate", "left")
    deps = F.coalesce("deps", F.lit(0))
    state = (F.when(F.coalesce("invalid", F.lit(False)), "invalid").when(deps == F.coalesce("over", F.lit(0)), "open")
             .otherwise("pending"))
    opened = F.when(state == "open", F.coalesce(F.col("last_ms"), F.lit(now_ms).cast("long")))
    return joined.select(*gates.columns, deps.alias("deps"), F.coalesce("over", F.lit(0)).alias("over"),
                         state.alias("state"), opened.alias("release_ms"))


def gate_release_success(gates: DataFrame, gate_deps: DataFrame, lifecycle: DataFrame, now_ms: int | None = None) -> DataFrame:
    """The success-only gate: open once every dependency has finished (none: now); dead once one ended otherwise."""
    per = _edges(gate_deps, lifecycle).groupBy("gate").agg(
        F.count("*").alias("deps"), F.count_if(F.col("outcome") == "FINISHED").alias("finished"),
        F.count_if(F.col("outcome") != "FINISHED").alias("unsuccessful"), F.max("ended_ms").alias("last_ms"))
    joined = gates.join(per, "gate", "left").fillna(0, ["deps", "finished", "unsuccessful"])
    state = (F.when(F.col("unsuccessful") > 0, "dead").when(F.col("deps") == F.col("finished"), "open").otherwise("pending"))
    return joined.select(*gates.columns, "deps", "finished", state.alias("state"),
                         F.when(state == "open", F.coalesce(F.col("last_ms"), F.lit(now_ms).cast("long"))).alias("release_ms"))


# Refusals a released gate tries again.
TRANSIENT = ["NOTFOUND", "FULL", "NOMEM"]


def gate_outcome(released: DataFrame, screened: DataFrame, max_tries: int | None = None) -> DataFrame:
    """What submitting an open gate's task gives: submitted, to retry, or stalled after ``max_tries``.

    ``screened`` holds gate and verdict (see ``screen_submissions``) and may hold ``tries``.
    """
    tries = F.coalesce(F.col("tries"), F.lit(1)) if "tries" in screened.columns else F.lit(1)
    again = F.col("verdict").isin(*TRANSIENT)
    result = (F.when(F.col("verdict") == "OK", "submitted").when(again & (F.lit(True) if max_tries is None else tries < max_tries), "retry").otherwise("stalled"))
    return released.where(F.col("state") == "open").join(screened, "gate").select(
        "gate", "release_ms", "verdict", result.alias("result"))


def claimed_rest(keys: DataFrame, table: str, names: DataFrame) -> DataFrame:
    """(key, rest): for keys ``table.<name>.<rest>`` what follows the longest known name, names may hold dots.

    Every dotted prefix of what follows the table is looked up among the names, and the longest one wins.
    """
    below = F.substring("key", len(table) + 2, 1 << 30)
    own = keys.where(F.col("key").startswith(table + ".")).select("key", F.split(below, r"\.").alias("_parts")).where(F.size("_parts") > 1)
    cuts = own.withColumn("_n", F.explode(F.sequence(F.lit(1), F.size("_parts") - 1)))
    probe = cuts.select("key", "_n", F.array_join(F.slice("_parts", F.lit(1), F.col("_n")), ".").alias("name"),
                        F.array_join(F.slice("_parts", F.col("_n") + 1, F.size("_parts")), ".").alias("rest"))
    return probe.join(rule_table(names.select("name").distinct()), "name").groupBy("key").agg(F.max_by("rest", "_n").alias("rest"))


def unused_keys(config: DataFrame, tasks: DataFrame, resources: DataFrame, schema: DataFrame, task_keys: list[str]) -> DataFrame:
    """Config rows whose key nothing uses, with the reason.

    A key is used if it is a setting, ``resources.<name>`` of a resource, ``task_defaults.<task key>``, or
    belongs to a task - the longest known name its part below ``tasks`` begins with - and goes on with one of
    ``task_keys`` or with ``resources.<name>`` of a resource. Only distinct keys are judged; what is said of them
    is written, so its size is known where it meets the rows.
    """
    keys = config.select("key").distinct()
    rest = claimed_rest(keys, "tasks", tasks.select(F.col("task").alias("name")))
    per = keys.join(rest, "key", "left")
    resource = F.when(F.col("key").startswith("resources."), F.substring("key", 11, 1 << 30)).when(
        F.col("rest").startswith("resources."), F.substring("rest", 11, 1 << 30))
    leaf = F.when(F.col("key").startswith("task_defaults."), F.substring("key", 15, 1 << 30)).otherwise(F.col("rest"))
    known = resources.select(F.col("name").alias("_resource")).distinct().withColumn("_defined", F.lit(True))
    named = schema.select("key").distinct().withColumn("_setting", F.lit(True))
    judged = per.withColumns({"_resource": resource, "_leaf": leaf}).join(known, "_resource", "left").join(named, "key", "left")
    used = F.coalesce("_setting", F.lit(False)) | F.coalesce("_defined", F.lit(False)) | F.coalesce(F.col("_leaf").isin(*task_keys), F.lit(False))
    reason = (F.when(F.col("_resource").isNotNull(), "no such resource").when(F.col("rest").isNotNull(), "no such key of a task")
              .when(F.col("key").startswith("tasks."), "no such task").otherwise("no such key"))
    return config.join(rule_table(pin(judged.where(~used).select("key", reason.alias("reason")), "unused")), "key")


def closest(wanted: DataFrame, known: DataFrame, limit: Callable[[Column], Column]) -> DataFrame:
    """For each ``wanted.key`` the nearest ``known.key`` within ``limit(length)`` edits, first best wins.

    Keys within so many edits differ in length by no more, so pairs meet on the length, by an equi-join.
    ``known`` is a rule table and holds key and its rank ``nth``.
    """
    size = F.length("key")
    probe = wanted.select("key", size.alias("ls"), limit(size).cast("int").alias("tau")).distinct()
    probe = probe.select("key", "tau", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ls") - F.col("tau")), F.col("ls") + F.col("tau"))).alias("len"))
    pairs = probe.join(rule_table(known.select(F.col("key").alias("near"), "nth", size.alias("len"))), "len")
    measured = pairs.withColumn("distance", F.levenshtein("key", "near")).where("distance <= tau")
    return measured.groupBy("key").agg(F.min_by(F.struct("near", "distance"), F.struct("distance", "nth", "near")).alias("best")).select(
        "key", F.col("best.near").alias("suggestion"), F.col("best.distance").alias("distance"))


def key_limit(length: Column) -> Column:
    """How many edits off a setting's key may be: a quarter of its length, at least 2."""
    return F.greatest(F.lit(2), F.floor(length / 4).cast("int"))


def suggest_keys(keys: DataFrame, schema: DataFrame) -> DataFrame:
    """The setting each unused key was probably meant to be."""
    return closest(keys, schema.select("key", "nth"), key_limit)


def suggest_names(names: DataFrame, known: DataFrame, within: int = 3) -> DataFrame:
    """The same for task names (3 edits) and table names (2)."""
    return closest(names, known, lambda _: F.lit(within))


def suggest_tables(keys: DataFrame, tables: DataFrame) -> DataFrame:
    """The table the first part of a key is probably meant to be: within 2 edits, for parts longer than 3.

    ``tables`` holds key and nth. A part that is a table needs none.
    """
    first = keys.where(F.instr("key", ".") > 0).select(F.substring_index("key", ".", 1).alias("key")).where(F.length("key") > 3).distinct()
    return suggest_names(first.join(tables.select("key"), "key", "left_anti"), tables, within=2)


def ledger(submissions: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per business id, driven by terminal facts about its current handle.

    ``submissions`` holds business_id, round, handle and ts_ms (when the round took over);
    ``facts`` handle, ts_ms, arrival, status, attempt and ok. The first fact closes a round,
    later ones confirm; a fact that arrives once the next round took over matches nothing.
    Confirmations survive a re-drive, the close does not.
    """
    taken = submissions.select("business_id", (F.col("round") - 1).alias("round"), F.col("ts_ms").alias("_until"))
    rounds = submissions.select("business_id", "round", "handle").join(taken, ["business_id", "round"], "left")
    live = facts.select(F.col("handle").alias("_handle"), "ts_ms", "arrival", "status", "attempt", "ok")
    in_time = F.col("_until").isNull() | (F.col("ts_ms") < F.col("_until"))
    matched = rounds.join(live, (F.col("handle") == F.col("_handle")) & in_time, "left")
    return current_rounds(facts_of_round(matched, ["business_id", "round", "handle"]))


def facts_of_round(rows: DataFrame, keys: list) -> DataFrame:
    """How many facts (rows with a stamp) a round has, and status, attempts and ok of the first."""
    facts = rows.withColumns({"_first": F.when(F.col("ts_ms").isNotNull(), point()), "_status": code_of("status", STATUSES)})
    return facts.groupBy(*keys).agg(
        F.count("_first").alias("n"), F.min("_first").alias("_first"), F.min_by("_status", "_first").alias("_status"),
        F.min_by("attempt", "_first").alias("attempts"), F.min_by("ok", "_first").alias("ok"))


def current_rounds(per_round: DataFrame) -> DataFrame:
    """One row per business id from (business_id, round, handle, n, _status, attempts, ok)."""
    extra = F.greatest(F.col("n") - 1, F.lit(0))
    current = {c: F.max_by(c, "round").alias(c) for c in ("handle", "n", "_status", "attempts", "ok")}
    rows = per_round.groupBy("business_id").agg(F.max("round").alias("rounds"), *current.values(), F.sum(extra).alias("confirmations"))
    closed = F.col("n") > 0
    return rows.select(
        "business_id", "handle", "rounds", F.when(~closed, "open").when(F.col("ok"), "recovered").otherwise("dead").alias("state"),
        F.when(closed, name_of("_status", STATUSES)).alias("status"), F.when(closed, F.col("attempts")).alias("attempts"),
        closed.cast("long").alias("closes"), "confirmations")
