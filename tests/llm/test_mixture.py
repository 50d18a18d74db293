"""The mixture against SQL, and its flow against every small network."""

import itertools

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from tools.check import TABLES, compare
from workfold.llm import mixture, queries

SCHEMA = "doc_id long, text string, source string, size string, key string, members string"


def test_matches_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ok, note, _ = compare(spark, con, queries.op12_flow_mixture, queries.OP12_SQL, SF)
    assert ok, note


def cost_of(given, tokens, costs):
    return sum(costs[k] * max(0, min(t, g - k * t)) for g, t in zip(given, tokens) for k in range(len(costs)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sets(st.integers(0, 2), min_size=1)), min_size=1, max_size=3), st.lists(st.integers(0, 5), min_size=3, max_size=3))
def test_flow_is_greatest_and_cheapest(patterns, quotas):
    costs = [0, 1, 3]
    tokens, members = [p[0] for p in patterns], [sorted(p[1]) for p in patterns]
    sent = mixture.cheapest_flow(tokens, members, quotas, costs)
    given_ = [sum(v for (i, _), v in sent.items() if i == n) for n in range(len(tokens))]
    assert all(g <= 3 * t for g, t in zip(given_, tokens)) and all(j in members[i] for i, j in sent)
    assert all(sum(v for (_, j), v in sent.items() if j == n) <= q for n, q in enumerate(quotas))

    def reaches(given):  # the greatest flow when each pattern gives at most so much, by cuts over sets of sources
        return min(sum(q for j, q in enumerate(quotas) if j in cut) + sum(g for g, own in zip(given, members) if not set(own) <= cut)
                   for r in range(4) for cut in map(set, itertools.combinations(range(3), r)))

    most = reaches([3 * t for t in tokens])
    assert sum(given_) == most
    every = itertools.product(*[range(3 * t + 1) for t in tokens])
    assert cost_of(given_, tokens, costs) == min(cost_of(g, tokens, costs) for g in every if sum(g) == most and reaches(g) == most)


def test_overlapping_sources_take_from_the_one_that_is_free(spark):
    rows = [(i, "w " * 10, s, None, None, None) for i, s in enumerate(["a"] * 10 + ["a,b"] * 10 + ["b"] * 2 + [None] + ["zz"] * 10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mix = mixture.mix_sources(docs, F.split("source", ","), weights=(1, 1, 1), most=3)
    targets = {r.source: r.target for r in mix.sources.collect()}
    sizes = {r.source: r["size"] for r in mix.sources.collect()}
    assert sizes == {"a": 200, "b": 120, "zz": 100}
    taken = mix.documents.groupBy("members").agg(F.sum("taken").alias("t"), F.max(F.col("taken") / F.col("size")).alias("times")).collect()
    assert all(r.t == 0 or r.times <= 3 for r in taken)
    filled = {r.source: r.w for r in mix.flows.groupBy("source").agg(F.sum("words").alias("w")).collect()}
    assert all(abs(filled[s] - t) <= 1 for s, t in targets.items())
    by = {tuple(r.members): r.t for r in taken}
    assert by[()] == 0 and sum(by.values()) == sum(filled.values())
    # Fresh words of the shared documents go before a second time of any.
    assert by[("=a", "=b")] >= 100


def test_odd_rows_skew_and_reruns(spark, small_cells):
    rows = [(i % 50, f"hot {'x ' * (i % 7)}", "hot", "s", "k", "m") for i in range(900)] + [
        (None, "a b c", None, "s", "k", "m"), (None, "a b c", None, "s", "k", "m"), (1, None, "", "s", "k", "m"), (2, "", "empty", "s", "k", "m"),
        (3, "long\x0bword " * 40000, "Z", "s", "k", "m"), (4, "one", "é", "s", "k", "m"), (5, "two words", "hot\n=x", "s", "k", "m")]
    docs = spark.createDataFrame(rows, SCHEMA)

    def run():
        mix = mixture.mix_sources(docs)
        out = mix.documents.join(mix.sources.select(F.array("key").alias("members"), "source", "target", F.col("size").alias("whole")), "members")
        return sorted(map(tuple, out.select("id", "source", "size", "whole", "target", "taken").collect()), key=repr)

    got = run()
    assert got == run() and len(got) == len(rows)
    names = sorted({r[2] for r in rows if r[2] is not None}, key=lambda s: s.encode()) + [None]
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    sizes = {s: sum(r[2] for r in got if r[1] == s) for s in names}
    targets, open_ = {}, set(names)
    while True:
        level = (sum(sizes.values()) - sum(targets.values())) / sum(weights[s] for s in open_)
        above = {s for s in open_ if weights[s] * level > 3 * sizes[s]}
        if not above:
            break
        targets |= {s: 3 * sizes[s] for s in above}
        open_ -= above
    targets |= {s: weights[s] * level for s in open_}
    for s in names:
        own = [r for r in got if r[1] == s]
        assert all(r[5] <= 3 * r[2] and r[3] == sizes[s] and r[4] == pytest.approx(targets[s]) for r in own)
        assert 0 <= targets[s] - sum(r[5] for r in own) < 1 + 1e-6


def test_empty_table(spark):
    mix = mixture.mix_sources(spark.createDataFrame([], SCHEMA))
    assert mix.documents.count() == 0 and mix.sources.count() == 0
    mix = mixture.mix_sources(spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA))
    assert [(r["size"], r.taken) for r in mix.documents.collect()] == [(0, 0)]
