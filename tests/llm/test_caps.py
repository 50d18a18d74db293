"""Cap filters against brute force."""

from statistics import NormalDist

import numpy as np
import pyarrow as pa

from tests.llm.test_copies import union
from workfold.llm import caps


def brute(rows, cosine=0.98):
    usable = {}
    for i, (v, e, label) in enumerate(rows):
        if e and label is not None and all(x is not None and np.isfinite(x) for x in e) and any(e):
            usable[i] = np.array(e, np.float64)
    pairs = [(i, j) for i in usable for j in usable if i < j and rows[i][2] == rows[j][2] and len(usable[i]) == len(usable[j])
             and usable[i] @ usable[j] / (np.linalg.norm(usable[i]) * np.linalg.norm(usable[j])) >= cosine]
    roots = union(pairs, range(len(rows)))
    out = []
    for i, r in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if roots[j] == roots[i]), key=lambda v: (v is not None, v or 0))
        out.append((r[0], sum(i in p for p in pairs), least, r[0] == least))
    return out


def vectors(n_hot=600):
    rng = np.random.RandomState(2)
    rows, base = [], rng.standard_normal((30, 64))
    for i in range(n_hot):  # one large group, other groups, alone
        rows.append((1000 + i, (base[0] + rng.standard_normal(64) * 0.11).tolist(), 1))
    for i in range(300):
        rows.append((i, (base[i % 30] * (1 + i) + rng.standard_normal(64) * rng.choice([0.01, 0.15, 0.2]) * (1 + i)).tolist(), i % 3))
    rows += [(5000 + i, rng.standard_normal(64).tolist(), 2) for i in range(200)]
    rows += [(6000, None, 1), (6001, [], 1), (6002, [0.0] * 64, 1), (6003, [1.0, None], 1), (6004, [1.0, float("nan")], 1), (6005, base[0].tolist(), None),
             (6006, [float("inf")] * 64, 1), (6007, [1.0, 0.0], 1), (6008, [2.0, 0.0], 1), (6009, [3.0], 7), (6010, [4.0], 7), (6011, [-4.0], 7), (None, [1.0, 0.0], 1)]
    return rows


def test_links_and_components_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, node int, n_links string")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in caps.cap_components(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    twice = caps.cap_components(df.unionAll(df)).collect()
    assert sorted(map(repr, [(r.vec_id, r.n_links, r.component_id, r.kept) for r in twice])) == sorted(map(repr, brute(rows) * 2))
    assert caps.cap_components(df.limit(0)).count() == 0


def test_list_decoding_finds_every_filter():
    p = caps.Caps(directions=30, listed=20, least=12)
    x = np.random.RandomState(1).standard_normal((50, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = caps.product_code(16, 30, p.seed)
    every = (code[0][:, None, :] + code[1][None, :, :]).reshape(900, 16)
    assert np.allclose(np.linalg.norm(every, axis=1), 1)
    inner = x @ every.T
    limit = np.minimum(NormalDist().inv_cdf(1 - p.listed / 900) / 4, np.sort(inner, axis=1)[:, -12])
    want = {(int(r), int(f)) for r, f in zip(*np.nonzero(inner >= limit[:, None] - 1e-12))}
    rows, filters = caps.list_decode(x, p)
    assert set(zip(rows.tolist(), filters.tolist())) == want


def test_recall_near_the_threshold():
    rng = np.random.RandomState(4)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    other = rng.standard_normal((3000, 64))
    other -= (other * x).sum(1, keepdims=True) * x
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98 ** 2) * other
    held = [set() for _ in range(3000)]
    for r, f in zip(*caps.list_decode(x, caps.Caps())):
        held[r].add(f)
    met = np.zeros(3000, bool)
    for r, f in zip(*caps.list_decode(y, caps.Caps())):
        met[r] |= f in held[r]
    assert met.mean() >= 0.995


def crowd(n=14000, pairs=200):
    """A crowd in one cone, nearly all of it not linked, with linked pairs among it."""
    rng = np.random.RandomState(8)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)

    def leaning(x, cosine):
        other = rng.standard_normal(x.shape)
        other -= (other * x).sum(1, keepdims=True) / (x * x).sum(1, keepdims=True) * x
        return cosine * x + np.sqrt(1 - cosine ** 2) * other / np.linalg.norm(other, axis=1, keepdims=True)

    x = leaning(np.tile(centre, (n, 1)), np.sqrt(0.94))
    return np.concatenate([x, leaning(x[:pairs], 0.981)])


def test_pairs_of_a_bucket_of_many_parts_all_meet(spark):
    x = crowd()
    _, filters = caps.list_decode(x, caps.Caps())
    assert np.bincount(filters).max() > 4096 * 2
    inner = x @ x.T >= 0.98
    np.fill_diagonal(inner, False)
    rows = pa.table({"vec_id": np.arange(len(x)), "embedding": list(x), "label": np.zeros(len(x), np.int64)})
    got = {r.vec_id: r.n_links for r in caps.cap_components(spark.createDataFrame(rows)).collect()}
    assert inner.sum() >= 400
    assert [got[i] for i in range(len(x))] == inner.sum(1).tolist()


def test_copies_are_one_class(spark, monkeypatch):
    rng = np.random.RandomState(6)
    v = rng.standard_normal(32)
    rows = [(i, v.tolist(), 1) for i in range(1500)] + [(2000, (v + rng.standard_normal(32) * 0.01).tolist(), 1), (None, v.tolist(), 2), (2001, v.tolist(), 2)]
    rows += [(3000 + i, [0.0] * 32, 1) for i in range(5)]
    compared = []
    compare = caps.compare_in_blocks
    monkeypatch.setattr(caps, "compare_in_blocks", lambda df, linked: compared.append(df.count()) or compare(df, linked))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in caps.cap_components(df).collect()]
    want = [(i, 1500, 0, i == 0) for i in (*range(1500), 2000)] + [(None, 1, None, True), (2001, 1, None, False)]
    want += [(3000 + i, 0, 3000 + i, True) for i in range(5)]
    assert sorted(map(repr, got)) == sorted(map(repr, [(a, b, c, d) for a, b, c, d in want]))
    assert compared == [2]
