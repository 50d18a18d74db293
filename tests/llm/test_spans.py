"""Personal data, secrets and toxicity: spans against the plain patterns, models on rows they have not seen."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from workfold.llm import pii, queries, secrets, toxicity

BIG = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (None, "mail a@b.co or +1 (301) 555-0346"), (2, ""), (3, "a@b.co " * 20000), (4, "1" * 50000), (5, "@" * 3000 + "a" * 30000), (6, "token = \"" + "ab12" * 9 + "\"")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ODD], "doc_id long, text string, spans string, f int")


def plain_personal(text):
    """The patterns as they are written down."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


bits = st.lists(st.sampled_from(["a", "@", ".", "-", " ", "+", "1", "4", "255", "0346", "(301) ", "x.y", "\n", "é", "a@b.c", "256.", "4111111111111111", "+1 301 555 0346", "%"]), max_size=40).map("".join)
keys = st.lists(st.sampled_from(["token", "TOKEN", "ſecret", "api_key", "apikey", "=", ":", " ", "\"", "'", "ab12cd34ef56", "AKIA", "ABCDEFGH12345678", "deadbeef", "K", "x", "\n", "+/"]), max_size=30).map("".join)


@given(bits)
@settings(max_examples=400, deadline=None)
def test_base_personal_spans(text):
    assert pii.base_spans(text) == plain_personal(text)


@given(keys)
@settings(max_examples=400, deadline=None)
def test_base_secret_spans(text):
    assert secrets.base_spans(text) == plain_secrets(text)


def digest(spans, kinds):
    return hashlib.sha256(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_personal_query_keeps_base_spans(spark, odd):
    got = {(r.doc_id, r.base_sha256): r for r in queries.op4_pii_weak_supervision(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base = plain_personal(d.text)
        r = got[(d.doc_id, digest(base, pii.KINDS))]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base} <= set(r.spans.split(","))
    out = pii.find_personal(odd).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in out) == Counter((i, digest(plain_personal(t or ""), pii.KINDS)) for i, t in ODD)
    assert pii.find_personal(odd.limit(0)).count() == 0


def test_votes_are_weighed_without_labels(spark):
    texts = [f"call me, phone {200 + i} 555-{1000 + i}" for i in range(60)] + [f"write to joe{i} (at) mail{i}.com please" for i in range(40)]
    texts += [f"version {100 + i}-{200 + i}-{i:04d}5x" for i in range(60)] + [f"order id {1000000 + i * 7}" for i in range(60)] + ["mail a@b.com", "phone +1 301 555 0346"] * 20
    model = pii.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    find = pii.finder(model)
    assert [pii.KINDS[k] for _, k, _, _ in find("please call, phone 301 555-0199 now")] == ["phone"]
    assert find("order id 1234567") == []
    assert [pii.KINDS[k] for _, k, _, _ in find("send to ann (at) mail7.com soon")] == ["email"]


def test_expectation_maximisation_finds_the_reliable_labelers():
    rng = np.random.RandomState(0)
    truth = rng.rand(20000) < 0.3
    right = np.array([0.95, 0.9, 0.6, 0.85])
    votes = np.where(rng.rand(20000, 4) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.rand(20000, 4) < 0.2] = pii.NOTHING
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, rate, post = pii.expectation_maximisation(patterns, counts)
    assert abs(prior - 0.3) < 0.02
    said = rate[:, 1, 1] / (rate[:, 1, 1] + rate[:, 1, 0])
    assert np.abs(said - right).max() < 0.03


def test_masking_keeps_rows_and_columns(spark, odd):
    out = pii.mask_personal(odd)
    assert out.columns == odd.columns
    rows = {(r.doc_id, r.text) for r in out.collect()}
    assert (None, "mail [EMAIL] or [PHONE]") in rows and (1, None) in rows and (2, "") in rows


def test_secret_query_keeps_base_spans(spark, odd):
    got = {(r.doc_id, r.base_sha256): r for r in queries.op9_secret_field(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    for d in docs:
        base = plain_secrets(d.text)
        r = got[(d.doc_id, digest(base, secrets.KINDS))]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
    out = secrets.find_secrets(odd).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in out) == Counter((i, digest(plain_secrets(t or ""), secrets.KINDS)) for i, t in ODD)
    assert secrets.find_secrets(odd.limit(0)).count() == 0


def test_field_tags_unseen_documents(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    field = secrets.learn(docs.where("doc_id % 2 = 0"))
    tp = fp = fn = 0
    for r in docs.where("doc_id % 2 = 1").collect():
        spans, file = secrets.base_spans(r.text), secrets.file_features(r.text)
        for run in secrets.token_runs(r.text):
            for want, got in zip(secrets.gold(run, spans), field.decode(secrets.features(r.text, run, file))):
                tp, fp, fn = tp + (want == got != 0), fp + (got != 0 and want != got), fn + (want != 0 and want != got)
    assert tp > 50 and 2 * tp / (2 * tp + fp + fn) >= 0.95


def test_field_is_a_probability_and_viterbi_is_best():
    rng = np.random.RandomState(1)
    field = secrets.Field(rng.standard_normal((secrets.N_FEATURES, 3)), rng.standard_normal((3, 3)))
    rows = [[0, 5, 9], [0, 3], [0, 7, 8, 11], [0]]
    import itertools

    def score(labels):
        path = [0, *labels, 0]
        return sum(field.transition[a, b] for a, b in zip(path, path[1:])) + sum(field.emission[r].sum(0)[x] for r, x in zip(rows, labels))

    assert tuple(field.decode(rows)) == max(itertools.product(range(3), repeat=4), key=score)
    fitted = secrets.fit([([[0, 1], [0, 2]], [1, 2], 5), ([[0, 3]], [0], 9), ([[0, 1]], [1], 2), ([[0, 2]], [0], 4)])
    assert fitted.decode([[0, 1], [0, 2]]) == [1, 2] and fitted.decode([[0, 3]]) == [0] and fitted.decode([[0, 2]]) == [0]


@given(st.text(alphabet="ab 1=:\n\"_Z+", max_size=60))
@settings(max_examples=200, deadline=None)
def test_token_runs_hold_every_token_that_may_be_secret(text):
    tokens = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    may = [bool(secrets.MAY.search(text[s:e])) for s, e in tokens]
    want, last = [], False
    for t, m in zip(tokens, may):
        if m and last:
            want[-1].append(t)
        elif m:
            want.append([t])
        last = m
    assert secrets.token_runs(text) == want


def test_toxicity_of_held_out_rows(spark):
    got = queries.op6_toxicity(spark, BIG)
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = got.join(labels, "doc_id").where("held_out").collect()
    tp = sum(r.predicted == r.toxic == 1 for r in rows)
    assert 2 * tp / (sum(r.predicted for r in rows) + sum(r.toxic for r in rows)) >= 0.9
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert got.count() == spark.read.parquet(f"{BIG}/documents.parquet").count()


def test_toxicity_folding_and_exceptions():
    assert toxicity.fold("Id1ot 1D10T іdіоt i​diot") == "idiot idiot idiot idiot"
    assert toxicity.fold("a 10 b2b 2024") .startswith("a 10")
    lexicon = toxicity.Lexicon({"idiot ": 5.0, "scum": 4.0}, ("useful idiot ", "scum|bag"))
    matcher = lexicon.matcher()
    assert [m[2] for m in lexicon.matches("idiot idiotic scummy oscum", matcher)] == ["idiot ", "scum"]
    assert lexicon.features("an idiot", matcher)[0] == 5.0
    assert lexicon.features("a useful idiot", matcher)[0] == 0.0
    assert lexicon.features("scum bag", matcher)[0] == 0.0


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0, 1), (3, 0, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(odd, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity_scores(odd, labels.limit(0)).count() == len(ODD)
    assert toxicity.toxicity_scores(odd.limit(0), labels).count() == 0


def test_secret_field_finds_more_than_the_patterns_and_leaves_prose_alone(spark):
    rng = random.Random(31)
    words = ["".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    value = lambda: "".join(rng.choice("abcdefghABCDEFGH0123456789_") for _ in range(rng.randint(12, 30)))
    train = [(i, f"{say(12)}. {rng.choice(['password', 'api_key', 'secret', 'token'])}{rng.choice([': ', '=', ' = '])}{value()}\n{say(20)}, {say(2).replace(' ', '-')}.") for i in range(300)]
    train += [(1000 + i, f"{say(30)} the key of {say(2)} and a {'-'.join(say(4).split())} token {say(20)}") for i in range(300)]
    field = secrets.learn(spark.createDataFrame(train, "doc_id long, text string"))
    hidden = ["-".join(say(4).split()), "QWERTYUIOPASDFGHJK", "abcdefghijklmnopqrstu", "zz-yy-xx-ww-vv-uu", "ABCDEFGHIJKLMNOPABCD"]
    planted = [(f"{say(8)} {name}{v}\n{say(9)}", v) for name in ("passphrase: ", "client key = ", "Authorization: Bearer ", "credential: ", "private_key=") for v in hidden for _ in range(4)]
    found = [[text[s:e] for s, _, e in secrets.find(text, field)[1]] for text, _ in planted]
    hits, added = sum(v in f for f, (_, v) in zip(found, planted)), sum(map(len, found))
    clean = [f"{say(20)} the {'-'.join(say(4).split())} of {say(8)} key {say(9)} www.{rng.choice(words)}.org" for _ in range(200)]
    wrong = sum(len(secrets.find(t, field)[1]) for t in clean)
    assert hits >= 0.9 * len(planted) and hits >= 0.9 * (added + wrong), (hits, len(planted), added, wrong)
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(planted)], "doc_id long, text string, f string")
    assert {r.doc_id for r in secrets.find_secrets(docs, field=field).where("spans LIKE '%secret:%'").collect()} == {i for i, f in enumerate(found) if f}


def test_every_token_is_decoded():
    rng = np.random.RandomState(5)
    field = secrets.Field(rng.standard_normal((secrets.N_FEATURES, 3)), rng.standard_normal((3, 3)))
    texts = ["", "plain words only here", "a key= Zz9/x then\nmany  plain words", " ", "one", "plain " * 40 + "x=1"]
    labels = secrets.Chains(field, words=2).labels(texts)
    for text, got in zip(texts, labels):
        run = [m.span() for m in re.finditer(r"\S+", text)]
        assert len(got) == len(run)
        if run:
            assert field.decode(secrets.features(text, run, secrets.file_features(text))) == got.tolist()
    assert sum(map(len, labels)) == 53 and labels[1].any() and set(np.concatenate(labels)) == {0, 1, 2}


def test_a_secret_of_plain_letters_is_found(spark):
    from workfold.llm.secrets import Field

    weights = np.zeros((secrets.N_FEATURES, 3))
    weights[0, secrets.OUT] = 1.0
    weights[1 + 4, secrets.BEGIN] = 9.0  # 16 to 23 characters
    docs = spark.createDataFrame([(1, "the correcthorsebattery is plain"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.find_secrets(docs, field=Field(weights, np.zeros((3, 3)))).collect()}
    assert got == {1: "secret:4:23", 2: "", 3: ""}


def test_lone_tokens_are_counted_by_shapes_that_tell_their_features():
    far = "password: " + "x" * 50 + " = tail\n" + " " * 60 + "end token: Ab3"
    for text in ("", "one", "the Key, is 'secret' = a1B2 (DEAF) beef", far, "a\u00a0b c\x0bd e", "\u0130stanbul \u00e9t\u00e9 passwd="):
        shapes = secrets.Shapes(words=3)
        tokens = [m.span() for m in secrets.TOKEN.finditer(text)]
        for token, held in zip(tokens, shapes.each(text, tokens), strict=True):
            assert shapes.features((*held, 1), 1) == secrets.features(text, [token], [1])
        if tokens:
            assert shapes.features(tuple(shapes.of(text, tokens)), len(tokens)) == secrets.features(text, tokens, [])
