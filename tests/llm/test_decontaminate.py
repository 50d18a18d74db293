"""Benchmark decontamination against plain alignment."""

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from workfold.llm import decontaminate as D
from workfold.llm import queries

P = D.Alignment()


def plain_align(a, b, p=P):
    best, rows = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (p.match if a[i - 1] == b[j - 1] else p.mismatch), rows[i - 1][j] + p.gap, rows[i][j - 1] + p.gap)
            best = max(best, rows[i][j])
    return best


@given(st.lists(st.integers(1, 4), min_size=1, max_size=12), st.lists(st.integers(0, 4), max_size=20))
@settings(max_examples=200, deadline=None)
def test_alignment_equals_the_table(a, b):
    assert D.align(np.array(a), np.array(b, dtype=np.int64), P)[0] == plain_align(a, b)


def corpus():
    rng = random.Random(8)
    words = ["v%d" % i for i in range(3000)]
    common = ["the", "of", "and", "to"]
    say = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n)]
    items = [(i, say(30)) for i in range(60)]
    docs, leaks = [], set()
    for d in range(400):
        text = say(rng.randrange(5, 400))
        if d % 4 == 0:
            item, own = rng.choice(items)
            own = list(own)
            for _ in range(d % 3 * 3):  # whole, or edited in three or six places
                at = rng.randrange(len(own))
                own[at:at + 1] = rng.choice([[], ["x%d" % at], [own[at], "y"]])
            if d % 16 == 12:
                own = own[:22]
            cut = rng.randrange(len(text))
            text[cut:cut] = own
            leaks.add((d, item))
        docs.append((d, " ".join(text).replace(" v1", ", V1").capitalize()))
    docs += [(1000 + i, "Intro. " + " ".join(items[0][1]) + " end") for i in range(300)]  # a passage many documents share
    leaks |= {(1000 + i, 0) for i in range(300)}
    return [(i, " ".join(w).upper()) for i, w in items], docs, leaks


def test_planted_copies_are_found_and_nothing_else(spark):
    items, docs, leaks = corpus()
    items += [(900, None), (901, ""), (902, "the of"), (902, "the of")]
    docs += [(5000, None), (5001, ""), (None, " ".join(items[3][1].split())), (5002, "The of!"), (5003, "the of and"), (5002, "The of!")]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*r, "s") for r in items], "item_id long, text string, score string")
    got = D.contaminated(df, bench).collect()
    want = leaks | {(None, 3)}
    assert {(r.doc_id, r.item_id) for r in got if r.item_id < 900} == want
    assert sorted((r.doc_id, r.item_id) for r in got if r.item_id >= 900) == [(5002, 902)] * 4
    texts = dict(docs)
    whole = next(r for r in got if r.score == 1.0 and r.item_id < 900)
    assert D.WORD.findall(texts[whole.doc_id][whole.start:whole.end].lower()) == D.WORD.findall(dict(items)[whole.item_id].lower())
    left = {r.doc_id for r in D.without_contaminated(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want} - {5002}
    small = D.Alignment(slice_chars=4000)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(df, bench, small).collect() if r.item_id < 900} == want
    assert D.contaminated(df.limit(0), bench).count() == D.contaminated(df, bench.limit(0)).count() == 0
    assert D.without_contaminated(df, bench.limit(0)).count() == len(docs)


def test_short_items_are_found_anywhere(spark):
    items = [(1, "what is the capital"), (2, "Two words"), (3, "what is"), (4, "何が好きですか"), (5, "one two three four five six seven"), (6, "one two three")]
    docs = [(1, "x " * 3000 + "What is -- the\n" + " " * 9000 + "capital? " + "y " * 3000), (2, "two " + " " * 20000 + "words!"), (3, "two words more"), (4, "what is it"),
            (5, "あの、何が好きですか？"), (6, "zero one two three four five six seven eight"), (7, "what is the capita l"), (8, "What is")]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 2), (5, 4), (6, 5), (6, 6), (8, 3)}
    texts = dict(docs)
    assert D.WORD.findall(texts[1][got[0].start:got[0].end].lower()) == ["what", "is", "the", "capital"]
    left = D.without_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {3, 4, 7}


def test_seeds_keep_half_of_a_copied_item():
    items = D.Items([(1, " ".join("w%d" % i for i in range(20))), (2, " ".join("u%d" % i for i in range(20)))], P)
    often = np.where(np.arange(len(items.grams)) % 2, 5000, 4000)
    seeds = items.seeds(often, 10000)
    for i in (0, 1):
        assert seeds[items.owner == i].sum() >= 9


def test_query_over_the_given_tables(spark):
    """Every document that holds the words of an item in order is found."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    flat = lambda t: " " + " ".join(D.WORD.findall(t.lower())) + " "
    want = {(d.doc_id, i.item_id) for d in docs for i in items if flat(i.text) in flat(d.text)}
    got = queries.op8_decontaminate(spark, SF).collect()
    assert want and want <= {(r.doc_id, r.item_id) for r in got}


def test_places_in_a_batch_do_not_cross_texts():
    items = D.Items([(1, "a b c d e f g h i j")], P)
    found = list(items.found_in(pa.array(["x a b", "c d e", "", "a b c"])))
    assert [(r, at.tolist()) for r, _, at, _ in found] == [(1, [0]), (3, [0])]
