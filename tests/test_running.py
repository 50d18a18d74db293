"""Running columns in cells against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from workfold.plans import running as R


def rows_of(seed, n, hot_share):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        group = "hot" if rnd.random() < hot_share else f"g{rnd.randrange(30)}"
        out.append((group, rnd.randrange(50) if seed % 2 else 7, i, rnd.randrange(-5, 100)))
    rnd.shuffle(out)
    return out


def brute(rows):
    groups = {}
    for g, o, i, v in rows:
        groups.setdefault(g, []).append((o, i, v))
    want = {}
    for g, part in groups.items():
        part.sort()
        total, high = 0, None
        for o, i, v in part:
            before = high
            total += v
            high = v if high is None else max(high, v)
            want[i] = (total, total - v, high, before, sum(x[2] for x in part))
    return want


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
@pytest.mark.parametrize("hot_share", [0.0, 0.35, 1.0])
def test_running_matches_brute_force(spark, small_cells, seed, hot_share):
    rows = rows_of(seed, 900, hot_share)
    df = spark.createDataFrame(rows, "g string, o int, i int, v long")
    v = F.col("v")
    got = R.running(df, ["g"], ["o", "i"], {
        "upto": ("sum", v, R.UPTO), "before": ("sum", v, R.BEFORE), "high": ("max", v, R.UPTO),
        "high_before": ("max", v, R.BEFORE), "total": ("sum", v, R.ALL)})
    have = {r.i: (r.upto, r.before, r.high, r.high_before, r.total) for r in got.collect()}
    assert have == brute(rows)


def test_global_ordinal_is_cut_into_cells(spark, small_cells):
    df = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("k"))
    assert R._layout(df, [], ["k"])[0].select(R.CELL).distinct().count() > 20
    out = R.ordinal(df, [], ["k"], "n", total="all")
    assert out.where("n <> k + 1 or all <> 2000").count() == 0


def test_hot_tie_is_split_by_the_next_column(spark, small_cells):
    df = spark.range(1000).select(F.lit(5).alias("ts"), "id")
    cells = R._layout(df, [], ["ts", "id"])[0].groupBy(R.CELL).count().agg(F.max("count")).first()[0]
    assert cells < 200


def test_groups_that_cross_no_border_have_no_offset(spark, small_cells):
    df = spark.createDataFrame([("hot" if i % 2 else f"g{i}", i) for i in range(1000)], "g string, i int")
    layout, bound = R._layout(df, ["g"], ["i"])
    offsets = R._offsets(layout, bound, ["g"], {"n": ("sum", F.lit(1).cast("long"), R.UPTO)})
    cells = layout.select(R.CELL).distinct().count()
    assert 20 < cells <= bound and offsets.count() <= 2 * cells
    assert offsets.where("_g_g = 'hot'").count() > 5


def shape(df):
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert "SinglePartition" not in plan
    return [w for w in re.findall(r"\b(Window|Sort|SortMergeJoin|BroadcastHashJoin|HashAggregate|Exchange|BroadcastExchange|FileScan)\b", plan)]


def test_one_plan_for_every_size(spark):
    spark.conf.set("workfold.rowsPerCell", "500000")
    try:
        small, large = (R.ordinal(spark.range(n).select((F.col("id") * 7919 % n).alias("k")), [], ["k"], "n", total="all") for n in (1000, 10_000_000))
        assert shape(small) == shape(large)
        assert large.where("n <> k + 1 or all <> 10000000").count() == 0
    finally:
        spark.conf.set("workfold.rowsPerCell", "1500")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("workfold.broadcastRows", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("workfold.broadcastRows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("hot_share", [0.35, 1.0])
def test_many_cells_join_by_shuffle(spark, small_cells, no_broadcast, hot_share):
    rows = [(None if g == "g3" else g, o, i, v) for g, o, i, v in rows_of(5, 900, hot_share)]
    df = spark.createDataFrame(rows, "g string, o int, i int, v long")
    got = R.running(df, ["g"], ["o", "i"], {
        "upto": ("sum", F.col("v"), R.UPTO), "before": ("sum", F.col("v"), R.BEFORE), "high": ("max", F.col("v"), R.UPTO),
        "high_before": ("max", F.col("v"), R.BEFORE), "total": ("sum", F.col("v"), R.ALL)})
    assert {"SortMergeJoin"} == {s for s in shape(got) if "Join" in s or s == "BroadcastExchange"}
    have = {r.i: (r.upto, r.before, r.high, r.high_before, r.total) for r in got.collect()}
    assert have == brute(rows)


def test_null_groups_and_no_rows(spark, small_cells):
    df = spark.createDataFrame([(None if i % 2 else "a", i) for i in range(400)], "g string, i int")
    out = R.ordinal(df, ["g"], ["i"], "n")
    assert out.groupBy("g").agg(F.max("n").alias("n")).where("n <> 200").count() == 0
    assert R.ordinal(df.where("i < 0"), ["g"], ["i"], "n").count() == 0


def test_descending_decimals_and_strings(spark, small_cells):
    df = spark.range(300).select(F.format_string("%05d", "id").alias("s"), (-F.col("id")).cast("decimal(20,0)").alias("d"), "id")
    assert R.ordinal(df, [], ["s"], "n").where("n <> id + 1").count() == 0
    assert R.ordinal(df, [], ["d"], "n").where("n <> 300 - id").count() == 0
