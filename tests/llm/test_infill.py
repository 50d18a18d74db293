"""Fill-in-the-middle against SQL and plain Python."""

import hashlib
import random
import re

import duckdb
import numpy as np

from tests.conftest import SF
from tools.check import TABLES, compare
from workfold.llm import infill, queries

SCHEMA = "doc_id long, text string, id string, n string, output string, form string"


def plain_rows(key, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return key, len(units), "plain", None, None, text, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h4 % 100 < 50
    return key, len(units), "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}", text


def test_matches_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ok, note, _ = compare(spark, con, queries.op13_infill, queries.OP13_SQL, SF)
    assert ok, note


def test_odd_and_random_texts(spark):
    rnd = random.Random(5)
    passage = "".join(rnd.choice("ab c\né😀\r") for _ in range(5000))
    texts = [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "<P>", "x<M>y\n", "<S", "P>\n<", "<<P\n>S>", "é\n😀 \n\x00b\n", "line\n" * 30000, "x" * 200_000 + "\n" + "é" * 90_000,
             *("".join(rnd.choice("ab\né😀<P>") for _ in range(rnd.randint(0, 60))) for _ in range(150)), *(passage[rnd.randint(0, 99):] + str(i) + passage for i in range(20))]
    rows = [(None if i % 11 == 3 else i // 2, t, "x", "y", "z", "w") for i, t in enumerate(texts)] + [(0, None, "x", "y", "z", "w")]
    small = infill.Infill(bits=5, longest=100, cached=4000)  # many chunks, forced ends and a cache that is too small
    for p in (infill.Infill(), small):
        shaped = infill.restored(infill.fill_in_middle(spark.createDataFrame(rows, SCHEMA), p), p)
        got = [(r.id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.text) for r in shaped.collect()]
        assert sorted(got, key=repr) == sorted((plain_rows(r[0], r[1]) for r in rows), key=repr)
    assert infill.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_passages_have_equal_chunks():
    rnd = np.random.RandomState(1)
    passage = rnd.randint(0, 256, 60_000).astype(np.uint8)
    texts = [np.concatenate([rnd.randint(0, 256, n).astype(np.uint8), passage, rnd.randint(0, 256, 50).astype(np.uint8)]) for n in (3, 777, 10_001)]
    sizes = np.cumsum([0] + [len(t) for t in texts])
    ends = infill.chunk_ends(np.concatenate(texts), sizes[:-1], sizes[1:], 10, 1 << 14)
    assert np.isin(sizes[1:], ends).all() and np.diff(ends, prepend=0).max() <= 1 << 14
    whole = np.concatenate(texts).tobytes()
    chunks = [{whole[a:b] for a, b in zip([s, *ends], ends) if s < b <= e} for s, e in zip(sizes[:-1], sizes[1:])]
    common = set.intersection(*chunks)
    assert sum(map(len, common)) > 50_000


def test_summaries_are_bounded_and_checked_by_content():
    cache = infill.Summaries(1000)
    for i in range(500):
        chunk = bytes([i % 7, 10]) * 20 + str(i).encode()
        assert cache.of(chunk)[:2] == (20, len(chunk))
    assert sum(map(len, cache.young)) + sum(map(len, cache.old)) <= 1000
