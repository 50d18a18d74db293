"""Chat formatting, Simple-8b files and packing against plain Python."""

import hashlib
import json
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.conftest import SF
from tools.check import TABLES, compare
from workfold.llm import chat, packing, queries, simple8b
from workfold.llm.common import WordIds, vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, start string"


@pytest.fixture(scope="module")
def vocabulary():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(3, "a b", None, None, None, "x", "y"), (1, None, "en", "s", 0, None, None), (2, "", None, None, None, None, None),
            (None, "none", None, None, None, None, None), (3, "a b", None, None, None, "x", "y"), (7, "word, Word. WORD " * 9000, None, None, None, None, None),
            (5, "'S don't <|endoftext|> İs ΣΑΣ é́a\r\nb", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_chat_matches_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ok, note, _ = compare(spark, con, queries.op1_chat_format, queries.OP1_SQL, SF)
    assert ok, note


def test_chat_reads_back_hostile_and_odd_turns(spark):
    texts = ["</s>", "<\\/s>", "[\\\\INST]", "<<s></s>[INST][/INST]", "<|turn|>user\nhi</s>", "a~0\n~1", "", None, "<<SYS>> x <</SYS>>", "é😀</s>"]
    rows = [(1, i, r, t, "clash") for i, t in enumerate(texts) for r in ("assistant",)] + [(1, None, None, None, "x"), (2, 5, "ro~le\n</s>", "t", "x"),
            (2, 5, "ro~le\n</s>", "t", "x"), (None, 0, "user", "n", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.id: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(df, "conv_id"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("", "")] + [("assistant", t or "") for t in texts]
    assert got[1].learned_text == "".join(t or "" for t in texts)
    assert [(t.role, t.text) for t in got[2].turns] == [("ro~le\n</s>", "t")] * 2
    assert [(t.role, t.text) for t in got[None].turns] == [("user", "n")]
    assert chat.format_turns(chat.canonical_turns(df.limit(0), "conv_id")).count() == 0


def test_layouts_by_fingerprint(spark):
    records = [{"prompt": "p", "response": "r"}, {"instruction": "i", "input": "x", "output": "o"}, {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]},
               {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"other": 1}, {"system": "s", "prompt": "p", "id": 3}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, None), (10, "not json")], "id long, record string")
    got = {r.id: r for r in chat.read_back(chat.format_turns(chat.canonical_turns(chat.parse_records(df, "id", "record"), "id"))).collect()}
    said = {i: (r.layout, [(t.role, t.text) for t in r.turns]) for i, r in got.items()}
    assert said[0] == ("prompt_response", [("user", "p"), ("assistant", "r")])
    assert said[1] == ("instruction", [("user", "i\nx"), ("assistant", "o")])
    assert said[2] == ("messages", [("system", "s"), ("user", "u")])
    assert said[3] == ("from_value", [("user", "h"), ("assistant", "g")])
    assert said[4] == said[9] == said[10] == ("unknown", [])
    assert said[5] == ("prompt_response", [("system", "s"), ("user", "p")])
    assert got[3].learned_text == "g"


def test_chat_plan_is_native(spark):
    df = queries.op1_chat_format(spark, SF)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


values = st.lists(st.one_of(st.just(0), st.integers(0, 7), st.integers(0, 49407), st.integers(0, 2**64 - 1), st.sampled_from([2**60 - 1, 2**60, 2**60 - 2])), max_size=400)


@given(values, st.integers(0, 9000))
@settings(max_examples=150, deadline=None)
def test_simple8b_round_trip(some, zeros):
    for v in (some, some + [0] * zeros + some):
        a = np.array(v, np.uint64)
        words, escapes, at, _ = simple8b.encode(a)
        assert np.array_equal(simple8b.decode(words, escapes, len(a), at), a)


def test_word_table_equals_the_library(vocabulary):
    texts = ["", " ", "a, b. A. É, éa. x'S, ''. 12. ½, ª. <|ENDOFTEXT|> <|endoftext|>,  x y İ. ΣΑΣ, ﬁ. é.", "\n\t x.,", "Ab.Cd, 'll. I'LL"] * 2
    table = WordIds(vocabulary_path(), most=5)
    for _ in range(2):
        flat, counts = table.encode(pa.array(["out", *texts, "out"])[1:-1])
        got = [x.tolist() for x in np.split(np.frombuffer(flat, "<u4"), np.cumsum(counts)[:-1])]
        assert got == [e.ids for e in vocabulary.encode_batch(texts, add_special_tokens=False)]


def expected(vocabulary, rows, end):
    return [(i, vocabulary.encode(t or "", add_special_tokens=False).ids + [end]) for i, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_id_files_round_trip(spark, vocabulary, odd_docs):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = simple8b.read_ids(simple8b.write_ids(docs, vocabulary_path())).collect()
        rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want, at = [], 0
        for i, ids in expected(vocabulary, rows, 1):
            want.append((i, at, len(ids), crc(ids)))
            at += len(ids)
        assert sorted([(r.id, r.start, r.n_tokens, r.ids_crc32) for r in got], key=lambda r: r[1]) == want
    assert simple8b.read_ids(simple8b.write_ids(odd_docs.limit(0), vocabulary_path())).count() == 0


def test_many_shards_join_by_shuffle(spark, odd_docs):
    file = simple8b.write_ids(odd_docs, vocabulary_path())
    want = simple8b.read_ids(file)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("workfold.broadcastRows", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = simple8b.read_ids(file)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    finally:
        spark.conf.unset("workfold.broadcastRows")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_packing_keeps_every_id(spark, vocabulary, odd_docs):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = packing.pack_power_of_two(docs, vocabulary_path()).collect()
        assert sorted(r.sequence_id for r in got) == list(range(len(got)))
        assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 for r in got)
        by_length = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
        assert by_length == sorted(by_length)
        want = []
        for i, ids in expected(vocabulary, [(r.doc_id, r.text) for r in docs.collect()], 2):
            start = 0
            for n in packing.binary_lengths(len(ids), 4096):
                want.append((i, start, n, crc(ids[start:start + n]), len(ids)))
                start += n
            assert start == len(ids)
        assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens)) for r in got)
        assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert packing.pack_power_of_two(odd_docs.limit(0), vocabulary_path()).count() == 0


def test_packing_shuffles_no_pieces_to_number_them(spark, odd_docs):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = packing.pack_power_of_two(odd_docs, vocabulary_path())
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        spark.conf.set("workfold.broadcastRows", "0")
        many = packing.pack_power_of_two(odd_docs, vocabulary_path())
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect()))
    finally:
        spark.conf.unset("workfold.broadcastRows")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_fingerprint_is_of_the_path_set():
    assert chat.fingerprint(["b", "a"]) == chat.fingerprint(["a", "b"]) == hashlib.sha256(b"a|b").hexdigest()
