"""The corpus pipeline, stage by stage, on the given and on planted rows."""

import random
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C
from tests.conftest import SF
from tests.llm.test_copies import brute as near_copies
from tests.llm.test_spans import plain_personal
from workfold.llm import decontaminate, packing
from workfold.llm.common import vocabulary_path

SF_BIG = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_BIG}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in C.STAGES:
        docs = C.pin(stage(spark, docs, SF_BIG), name)
        out.append((name, docs))
    return out


def test_columns_stay_and_rows_only_shrink(stages):
    documents = stages[0][1]
    before = documents.count()
    for name, df in stages[1:-1]:
        assert df.columns == documents.columns and df.dtypes == documents.dtypes
        n = df.count()
        assert 0 < n <= before
        before = n


def test_each_decision_takes_effect(spark, stages):
    by = dict(stages)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_BIG}/labels.parquet").collect()}
    kept = {r.doc_id for r in by["toxicity"].collect()}
    gone = {r.doc_id for r in by["documents"].collect()} - kept
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i in kept for i in clean) >= 0.98 * len(clean) and sum(labels.get(i, 0) for i in gone) >= 0.7 * sum(labels.values())
    rows = [(r.doc_id, r.text) for r in by["toxicity"].collect()]
    want = {g for _, _, _, _, g in near_copies(rows)}
    assert {r.doc_id for r in by["near_copies"].collect()} == want
    items = spark.read.parquet(f"{SF_BIG}/benchmark.parquet").collect()
    flat = lambda t: " " + " ".join(decontaminate.WORD.findall(t.lower())) + " "
    left = by["benchmark"].collect()
    assert not [1 for r in left for i in items if flat(i.text) in flat(r.text)]
    held = {r.doc_id for r in by["near_copies"].collect()} - {r.doc_id for r in left}
    texts = {r.doc_id: r.text for r in by["near_copies"].collect()}
    assert all(any(set(flat(i.text).split()) & set(flat(texts[d]).split()) for i in items) for d in held) and len(held) < 0.1 * len(texts)
    masked = by["personal_data"].collect()
    assert {r.doc_id for r in masked} == {r.doc_id for r in left}
    assert not [1 for r in masked if plain_personal(r.text)] and all(r.n_chars == len(r.text) for r in masked)
    untouched = {r.doc_id: r.text for r in left if not plain_personal(r.text)}
    same = sum(untouched[r.doc_id] == r.text for r in masked if r.doc_id in untouched)
    assert same >= 0.95 * len(untouched)
    vocabulary = Tokenizer.from_file(vocabulary_path())
    pieces = Counter((r.doc_id, r.start, r.length) for r in by["packing"].collect())
    want = Counter()
    for r in masked:
        start = 0
        for n in packing.binary_lengths(len(vocabulary.encode(r.text, add_special_tokens=False).ids) + 1, 4096):
            want[(r.doc_id, start, n)] += 1
            start += n
    assert pieces == want


def test_odd_rows_pass_every_stage(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w%d" % rng.randrange(500) for _ in range(40)), "en", "s", 1) for i in range(30)]
    rows += [(1, rows[1][1], "en", "s", 1), (100, None, None, None, None), (101, "", None, None, 0), (None, "one two three", None, None, None), (None, None, None, None, None),
             (102, "long " * 20000, "en", None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in C.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        docs = C.pin(stage(spark, docs, SF), name)
        if name == "near_copies":
            assert Counter(r.doc_id for r in docs.collect()) == Counter([*range(30), None, None, 102])
    assert {r.doc_id for r in docs.collect()} == {*range(30), None, 102}


def test_columns_of_any_name_come_back_unchanged(spark):
    rows = [(i, f"some words of text number {i} and more of them here", "en", "s", 5, f"own {i}", i * 7, "r", "m", "ID", "n") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, _mark long, row string, mark string, id string, node string")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {(r.doc_id, r._id, r._mark, r.row, r.mark, r.id, r.node) for r in out.collect()} <= {(r[0], *r[5:]) for r in rows}
        docs = C.pin(out, name)
    assert docs.count() > 0


def test_run_gives_the_last_stage(spark):
    got = C.pipeline(spark, SF)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_text_stages_send_few_texts_at_once_and_leave_the_session_alone(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(C.pii, "mask_personal", lambda docs: seen.append(int(spark.conf.get(C.BATCH_CONF))) or docs)
    before = spark.conf.get(C.BATCH_CONF)
    docs = spark.createDataFrame([(1, "a", None), (None, None, 4)], "doc_id long, text string, n_chars long")
    assert C.mask_personal(spark, docs, SF).count() == 2
    assert seen == [C.TEXTS] and spark.conf.get(C.BATCH_CONF) == before
