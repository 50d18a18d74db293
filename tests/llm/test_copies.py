"""Near copies: the Jaccard join and graph helpers against brute force."""

import random

import numpy as np
import pytest

from tests.conftest import SF
from workfold.llm import jaccard, links


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 400)]
    noise = [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(7, 7)]
    edges = chain + star + noise
    got = {r.id: r.root for r in links.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    edges = [e for e in edges if e[0] != e[1]]
    want = union(edges, {x for e in edges for x in e})
    assert got == want
    assert links.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(rows, n=5, threshold=0.8):
    """Per row: class, copies, links between classes, group, by comparing all pairs of n-gram sets."""
    def grams(t):
        w = (t or "").lower().split()
        k = min(n, len(w))
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()

    key = lambda r: (r[0] is not None, r[0] or 0)
    sets = [grams(t) for _, t in rows]
    classes = {}
    for r, s in zip(rows, sets):
        classes.setdefault(s, []).append(r)
    names = list(classes)
    pairs = []
    by_gram = {}
    for i, s in enumerate(names):
        for g in s:
            by_gram.setdefault(g, []).append(i)
    from collections import Counter
    common = Counter((a, b) for v in by_gram.values() for x, a in enumerate(v) for b in v[x + 1:])
    for (a, b), c in common.items():
        if c / (len(names[a]) + len(names[b]) - c) >= threshold:
            pairs.append((a, b))
    n_links = Counter(x for p in pairs for x in p)
    roots = union(pairs, range(len(names)))
    heads = {}
    for i, s in enumerate(names):
        heads.setdefault(roots[i], []).append(min(classes[s], key=key)[0])
    out = []
    for r, s in zip(rows, sets):
        i = names.index(s)
        out.append((r[0], min(classes[s], key=key)[0], len(classes[s]), n_links[i], min(heads[roots[i]], key=lambda v: (v is not None, v or 0))))
    return out


def shuffled_copies():
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(500):  # one large group of near copies, some exactly alike
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(120)] = rng.choice(words)
        rows.append((1000 + i, " ".join(own)))
    rows += [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, " \n"), (None, "one two"), (303, "One  two"), (304, "one two three"), (305, "x " * 5000), (306, "x " * 9000), (305, "x " * 5000)]
    return rows


def test_jaccard_classes_equal_brute_force(spark):
    rows = shuffled_copies()
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, n_links int, node string")
    got = jaccard.jaccard_classes(df).collect()
    assert sorted(map(repr, brute(rows))) == sorted(repr((r.doc_id, r.class_id, r.n_copies, r.n_links, r.group_id)) for r in got)
    kept = [r for r in got if r.kept]
    assert {(r.group_id, r.doc_id) for r in kept} == {(r.group_id, r.group_id) for r in got}
    assert jaccard.jaccard_classes(df.limit(0)).count() == 0


def test_jaccard_over_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = jaccard.jaccard_classes(docs).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(want) == sorted((r.doc_id, r.class_id, r.n_copies, r.n_links, r.group_id) for r in got)


def test_depth_reaches_the_recall():
    p = jaccard.Forest()
    assert 1 - (1 - 0.8 ** p.depth) ** p.trees >= p.recall > 1 - (1 - 0.8 ** (p.depth + 1)) ** p.trees


@pytest.mark.parametrize("columns", [3, 1 << 14])
def test_same_sets(columns):
    rng = np.random.RandomState(0)
    sets = [np.unique(rng.randint(0, 40, size=rng.randint(1, 30))).astype(np.uint64) for _ in range(40)]
    got = links.same_sets(sets, 0.5, columns)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            c = len(np.intersect1d(a, b))
            assert got[i, j] == (c / (len(a) + len(b) - c) >= 0.5)


def test_pairs_of_a_large_bucket_all_meet(spark):
    p = jaccard.Forest(deepest=2)
    half = 4500
    sketches = np.random.RandomState(5).randint(0, 256, (half, p.trees * p.depth // 2)).astype(np.uint8)
    rows = [(i, [7], sketches[i % half].tobytes()) for i in range(2 * half)]  # every sketch twice, all in one bucket
    heads = spark.createDataFrame(rows, "node long, prefixes array<bigint>, sketch binary")
    met = {(min(r), max(r)) for r in jaccard.candidates(heads, p).collect()}
    assert {(i, i + half) for i in range(half)} <= met
