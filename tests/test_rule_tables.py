"""Rule tables meet many rows: the rules are broadcast while they are few, the rows never are."""

import re

import pytest
from pyspark.sql import functions as F

from tests.test_scale import plan_of
from workfold.operators import joins as J
from workfold.operators import validation as V

SCHEMA = [(1, "a", "UINT", False, 0.0, 0.0, "", "1"), (2, "b", "BOOL", False, 0.0, 0.0, "", "false")]


def rules(spark):
    return spark.createDataFrame(SCHEMA, "nth int, key string, type string, has_range boolean, min double, max double, choices string, dflt string")


def written(spark, tmp_path, n=50):
    """Rows that a generator makes from a small file, as the settings of the given tables are."""
    spark.range(n).write.parquet(str(tmp_path / "ids"))
    ids = spark.read.parquet(str(tmp_path / "ids"))
    return ids.select(F.col("id").alias("entity"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in (("a", "7"), ("b", "maybe"), ("c", "x" * 200), ("tasks.t.bogus", "1"))])))


def broadcasts_of_generated(df):
    """Whether a broadcast holds the generated rows."""
    lines = plan_of(df).split("\n\n")[0].splitlines()
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            depth = re.search(r"BroadcastExchange", line).start()
            for below in lines[i + 1:]:
                if re.search(r"[A-Z]", below).start() <= depth:
                    break
                if "Generate" in below:
                    return True
    return False


QUERIES = {
    "validate": lambda c, s, t, r: V.validate_settings(c, s),
    "unused": lambda c, s, t, r: J.unused_keys(c, t, r, s, ["max_kb"]),
    "layers": lambda c, s, t, r: J.layer_config(c.select("entity", "key").withColumn("grp", F.lit("g")), c, c.limit(0).select(F.lit("g").alias("grp"), "key", "value"), s),
    "suggest": lambda c, s, t, r: J.suggest_keys(c.select("key"), s),
}


@pytest.mark.parametrize("few", ["200000", "1"])
@pytest.mark.parametrize("op", QUERIES)
def test_generated_rows_are_not_broadcast(spark, tmp_path, op, few):
    config = written(spark, tmp_path)
    tasks, resources = spark.createDataFrame([("t",)], "task string"), spark.createDataFrame([("gpu", 1)], "name string, budget long")
    spark.conf.set("workfold.broadcastRows", few)
    try:
        df = QUERIES[op](config, rules(spark), tasks, resources)
        assert not broadcasts_of_generated(df), plan_of(df)
        got = df.collect()
    finally:
        spark.conf.unset("workfold.broadcastRows")
    if op == "validate":
        assert {(r.key, r.problem) for r in got} == {("a", None), ("b", "not true or false")} and len(got) == 100
    if op == "unused":
        assert {(r.key, r.reason) for r in got} == {("c", "no such key"), ("tasks.t.bogus", "no such key of a task")} and len(got) == 100
    if op == "layers":
        assert {(r.key, r.value, r.layer) for r in got} == {("a", "7", "own"), ("b", "false", "default")} and len(got) == 100
    if op == "suggest":
        assert {(r.key, r.suggestion, r.distance) for r in got} == {("a", "a", 0), ("b", "b", 0), ("c", "a", 1)}
