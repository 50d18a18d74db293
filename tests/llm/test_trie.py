"""The z-fast trie against plain Python over every prefix."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from tests.conftest import SF
from tools.check import TABLES, compare
from workfold.llm import queries, zfast

SCHEMA = "conv_id long, turn long, role string, text string, depth string, ext string, conv string"


def plain_nodes(strings: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    """Every prefix of every conversation by plain dictionaries."""
    members: dict[tuple, list[int]] = {}
    for c, turns in strings.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict[tuple, list[tuple]] = {k: [] for k in members}
    for k in members:
        if k:
            kids[k[:-1]].append(k)

    def words(k):
        return len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0

    saved = {k: (len(v) - 1) * words(k) for k, v in members.items()}
    leaves = {k: int(not kids[k]) for k in members}
    for k in sorted(members, key=len, reverse=True):
        if k:
            saved[k[:-1]] += saved[k]
            leaves[k[:-1]] += leaves[k]
    out = set()
    for k, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(strings[c]) == len(k))))
        out.add((min(own), len(k), min(members[k[:-1]]) if k else None, len(own), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def nodes_of(spark, rows, shares=zfast.SHARES):
    turns = zfast.numbered_turns(spark.createDataFrame(rows, SCHEMA))
    got = zfast.prefix_nodes(*zfast.conversation_strings(turns), shares).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_matches_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ok, note, _ = compare(spark, con, queries.op11_prefix_trie, queries.OP11_SQL, SF)
    assert ok, note


@pytest.mark.parametrize("shares", [(1,), (1, 3, 12), (1, 1, 1, 1, 1, 1)])
def test_random_shared_beginnings(spark, shares):
    rnd = random.Random(len(shares))
    strings: dict[int, list] = {}
    for c in range(-3, 70):
        base = list(strings[rnd.choice(list(strings))]) if strings and rnd.random() < 0.8 else []
        turns = base[:rnd.randint(0, len(base))] + [(rnd.choice(("user", "")), rnd.choice(("a b", "c", "", "d\x0be f"))) for _ in range(rnd.choice((0, 0, 1, 2, 9, 40)))]
        strings[c] = turns or [("user", "x")]
    rows = [(c, i, r, t, "x", "y", "z") for c, turns in strings.items() for i, (r, t) in enumerate(turns)]
    assert nodes_of(spark, rows, shares) == plain_nodes(strings)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None, None, None), (1, 2, "user", "a  b", "x", "y", "z"), (1, 2, "assistant", "b", "x", "y", "z"), (1, 2, "user", "a  b", "x", "y", "z"),
            (2, 0, "", "", "x", "y", "z"), (None, 0, "user", "of no conversation", "x", "y", "z"), (9, -5, "user", "long " * 30000, None, None, None)]
    strings = {1: [("", ""), ("assistant", "b"), ("user", "a  b"), ("user", "a  b")], 2: [("", "")], 9: [("user", "long " * 30000)]}
    assert nodes_of(spark, rows) == plain_nodes(strings)
    assert nodes_of(spark, []) == set()


def test_many_copies_and_one_common_turn(spark, monkeypatch):
    monkeypatch.setattr(zfast, "CHUNK_IDS", 7)
    strings = {c: [("user", "hello there")] + ([("assistant", "general")] if c % 3 else []) + ([("user", f"own {c}")] if c % 2 else []) for c in range(400)}
    rows = [(c, i, r, t, None, None, None) for c, turns in strings.items() for i, (r, t) in enumerate(turns)]
    assert nodes_of(spark, rows) == plain_nodes(strings)


def test_borrowed_turns_and_turnless_conversations(spark):
    rnd = random.Random(3)
    own = {c: [(rnd.choice(("user", "system")), rnd.choice("pqrs")) for _ in range(rnd.randint(1, 4))] for c in [*range(0, 30), *range(43, 60), 100, -7]}
    rebuilt = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = own.get(base, [])[:h] + turns[h:]
    assert any(not t for t in rebuilt.values())
    turns = zfast.numbered_turns(spark.createDataFrame([(c, i, r, t, None, None, None) for c, ts in own.items() for i, (r, t) in enumerate(ts)], SCHEMA))
    got = {tuple(r) for r in zfast.prefix_nodes(*zfast.conversation_strings(queries.with_borrowed_turns(turns))).collect()}
    assert got == plain_nodes(rebuilt)


def test_two_fattest(spark):
    from pyspark.sql import functions as F
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", zfast.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in got)
