"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Words are runs of letters and digits in lower case. The n-grams of the test items are counted over all
documents; an item's seeds are its n-grams that are rare there, and the rarer half of its n-grams in any
case, so an item that itself was copied often keeps its seeds. Where two seeds of an item lie near each
other in a document, the item is aligned locally with the words around them: copies that were edited,
shortened or paraphrased in part still score. The score is the alignment's share of a perfect one.

The items are looked up in slices of at most ``slice_chars`` characters, whose size is summed before they
are read to the driver and shipped; more items mean more slices, each one over all documents, never a
larger shipment. Defined results: NULL and empty texts match nothing; items with fewer than ``least_words``
words match wherever these words follow each other, those of one or two words (``ngram`` - 1) only documents of
exactly these words, empty ones none; letters of scripts without blanks are words each; NULL ids stay NULL; repeated documents
are judged alone, repeated items each; an empty table on either side gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workfold.llm.common import WordTable, ragged, shipped, text_chunks, text_of

UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
WORD = re.compile(rf"[{UNSPACED}]|[^\W_{UNSPACED}]+")


@dataclass(frozen=True)
class Alignment:
    ngram: int = 3
    rare: float = 0.0002
    least_hits: int = 2
    least_words: int = 8
    match: int = 2
    mismatch: int = -1
    gap: int = -1
    threshold: float = 0.4
    slice_chars: int = 32_000_000


class Items(WordTable):
    """One slice of the test items: words as numbers from 1 (0 is any other), and where each n-gram stands."""

    def __init__(self, rows: list[tuple], p: Alignment):
        super().__init__()
        self.p = p
        self.of: dict[str, int] = {}
        self.ids: list = []
        self.words: list[np.ndarray] = []
        short: list[tuple[int, list[int]]] = []
        for item, text in rows:
            words = WORD.findall((text or "").lower())
            if len(words) < max(p.least_words, p.ngram):
                if words:
                    short.append((item, [self.of.setdefault(w, len(self.of) + 1) for w in words]))
                continue
            self.ids.append(item)
            self.words.append(np.array([self.of.setdefault(w, len(self.of) + 1) for w in words], np.int64))
        self.as_bytes = {w: n.to_bytes(4, "little") for w, n in self.of.items()}
        # Short items by their number of words: (hashes of all words in order, items).
        self.short: dict[int, tuple[np.ndarray, list]] = {}
        for n in sorted({len(w) for _, w in short}):
            own = sorted((int(self.keys(np.array(w, np.int64), n)[0]), str(item), item) for item, w in short if len(w) == n)
            self.short[n] = np.array([k for k, _, _ in own], np.uint64), [item for _, _, item in own]
        owner = np.repeat(np.arange(len(self.ids)), [len(w) - p.ngram + 1 for w in self.words]).astype(np.int64)
        keys = np.concatenate([self.keys(w) for w in self.words]) if self.words else np.zeros(0, np.uint64)
        place = np.concatenate([np.arange(len(w) - p.ngram + 1) for w in self.words]) if self.words else np.zeros(0, np.int64)
        order = np.lexsort((place, owner, keys))
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first, self.often = np.unique(keys[order], return_index=True, return_counts=True)

    def keys(self, words: np.ndarray, n: int | None = None) -> np.ndarray:
        """One number for the n-gram that begins at each word."""
        n = n or self.p.ngram
        out = np.zeros(len(words) - n + 1, np.uint64)
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k:len(words) - n + 1 + k].astype(np.uint64)
        return out

    def _learn(self, words: pa.Array) -> pa.Array:
        get, split, other = self.as_bytes.get, WORD.findall, bytes(4)
        parts = [split(w.lower()) for w in words.to_pylist()]
        return pa.array([get(p[0], other) if len(p) == 1 else b"".join([get(x, other) for x in p]) for p in parts], pa.binary())

    def short_in(self, words: np.ndarray) -> Iterator[tuple[object, int, int]]:
        """(item, first word, words) of the short items a text holds, the first place of each."""
        for n, (hashes, items) in self.short.items():
            if len(words) < n or (n < self.p.ngram and len(words) != n):
                continue
            known = words > 0
            at = np.flatnonzero(np.convolve(known, np.ones(n, int), "valid") == n)
            keys = self.keys(words, n)[at]
            low, high = np.searchsorted(hashes, keys, "left"), np.searchsorted(hashes, keys, "right")
            seen = set()
            for place, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                if a not in seen:
                    seen.add(a)
                    yield from ((item, place, n) for item in items[a:b])

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, number of the n-gram) wherever an n-gram of the items stands."""
        none = np.zeros(0, np.int64)
        if len(words) < self.p.ngram or not len(self.grams):
            return none, none
        all_known = words[:len(words) - self.p.ngram + 1] > 0
        for k in range(1, self.p.ngram):
            all_known &= words[k:len(words) - self.p.ngram + 1 + k] > 0
        at = np.flatnonzero(all_known)
        if not len(at):
            return none, none
        keys = self.keys(words)[at]
        gram = np.minimum(np.searchsorted(self.grams, keys), len(self.grams) - 1)
        hit = self.grams[gram] == keys
        return at[hit], gram[hit]

    def found_in(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(row, words, place, n-gram) of the texts that hold an n-gram of the items; all texts if there are short ones."""
        none = np.zeros(0, np.int64)
        for a, b in text_chunks(texts):
            words, counts = self.numbers(texts[a:b])
            ends = np.cumsum(counts)
            at, gram = self.found(words)
            row = np.searchsorted(ends, at, "right")
            inside = at + self.p.ngram <= ends[row]
            at, gram, row = at[inside], gram[inside], row[inside]
            edges = np.append(np.flatnonzero(np.append(True, row[1:] != row[:-1])), len(row)) if len(row) else none
            of_row = {int(row[low]): (low, high) for low, high in zip(edges[:-1], edges[1:])}
            for r in range(b - a) if self.short else of_row:
                start = int(ends[r] - counts[r])
                low, high = of_row.get(r, (0, 0))
                yield a + r, words[start:ends[r]], at[low:high] - start, gram[low:high]

    def seeds(self, often: np.ndarray, documents: int) -> np.ndarray:
        """Which of the items' n-gram places are seeds, given in how many documents each n-gram stands."""
        df = np.repeat(often, self.often)
        limit = np.zeros(len(self.ids))
        order = np.lexsort((df, self.owner))
        sizes = np.bincount(self.owner, minlength=len(self.ids))
        starts = np.cumsum(sizes) - sizes
        if len(order):
            limit = df[order][starts + (sizes - 1) // 2]
        return df <= np.maximum(limit[self.owner], max(2.0, self.p.rare * documents))


def align(item: np.ndarray, text: np.ndarray, p: Alignment) -> tuple[int, int]:
    """(score, end) of the best local alignment; a word of the text that no item holds matches nothing."""
    columns = -p.gap * np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        here = np.zeros(len(text) + 1, np.int64)
        here[1:] = np.maximum(above[:-1] + np.where(text == w, p.match, p.mismatch), above[1:] + p.gap)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + columns) - columns  # gaps along the text
        top = int(here.argmax())
        if here[top] > best:
            best, end = int(here[top]), top
        above = here
    return best, end


def word_places(text: str) -> list[tuple[int, int]]:
    """Where the words of a text stand; where lower case has another length, those of the text as it is."""
    low = text.lower()
    return [m.span() for m in WORD.finditer(low if len(low) == len(text) else text)]


def matches(text: str, words: np.ndarray, at: np.ndarray, gram: np.ndarray, items: Items, seeds: np.ndarray) -> list[tuple[int, float, int, int, int]]:
    """(item, score, start, end, seeds) of the items a text holds, the best place of each; in characters."""
    p = items.p
    entry = ragged(items.first[gram], items.often[gram])
    at = np.repeat(at, items.often[gram])
    keep = seeds[entry]
    at, owner, place = at[keep], items.owner[entry[keep]], items.place[entry[keep]]
    if len(at) < p.least_hits:
        return []
    order = np.lexsort((at, owner))
    at, owner, place = at[order], owner[order], place[order]
    out = []
    size = np.array([len(w) for w in items.words], np.int64)
    new = np.append(True, (owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > size[owner[1:]]))
    bounds = np.append(np.flatnonzero(new), len(at))
    best: dict[int, tuple[float, int, int, int]] = {}
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        hits = len(np.unique(place[a:b]))
        if hits < p.least_hits:
            continue
        i = int(owner[a])
        own, spare = items.words[i], 4 + len(items.words[i]) // 4
        low = max(0, int((at[a:b] - place[a:b]).min()) - spare)
        high = min(len(words), int((at[a:b] - place[a:b]).max()) + len(own) + spare)
        window = words[low:high]
        score, end = align(own, window, p)
        share = score / (p.match * len(own))
        if share >= p.threshold and share > best.get(i, (0.0,))[0]:
            _, back = align(own[::-1], window[:end][::-1], p)
            best[i] = (share, low + end - back, low + end, hits)
    if best:
        places = word_places(text)
        for i, (share, first, last, hits) in sorted(best.items()):
            last = min(last, len(places))
            first = min(first, last - 1)
            out.append((i, share, places[first][0], places[last - 1][1], hits))
    return out


def slices(benchmark: DataFrame, p: Alignment, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in slices of a bounded number of characters."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), text_of(text_col).alias("text")).where("text <> ''")
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = -(-2 * chars // p.slice_chars)  # items are dealt by hash, so slices aim at half the bound
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield sorted(((r.item, r.text) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def _frequencies(texts: DataFrame, items: Items) -> np.ndarray:
    """In how many documents each n-gram of the items stands."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for _, _, _, gram in items.found_in(batch["text"]):
                seen.update(np.unique(gram).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["gram", "n"])

    out = np.zeros(len(items.grams), np.int64)
    # No more rows than the slice has n-grams.
    for r in texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r.gram] = r.n
    return out


def _matchers(texts: DataFrame, benchmark: DataFrame, p: Alignment, item_col: str, text_col: str):
    """For each slice of the items a function texts -> [(item, score, start, end, seeds)] of each."""
    shipped(texts.sparkSession)
    documents = None
    for rows in slices(benchmark, p, item_col, text_col):
        if not rows:
            continue
        documents = texts.count() if documents is None else documents
        items = Items(rows, p)
        chosen = items.seeds(_frequencies(texts, items), documents)

        def match(texts: pa.Array, items=items, chosen=chosen) -> list[list[tuple]]:
            out: list[list[tuple]] = [[] for _ in range(len(texts))]
            for row, words, *found in items.found_in(texts):
                if len(found[0]):
                    out[row] = [(items.ids[i], *rest) for i, *rest in matches(texts[row].as_py(), words, *found, items, chosen)]
                short = list(items.short_in(words))
                if short:
                    places = word_places(texts[row].as_py())
                    for item, first, n in short:
                        start, end = min(first, len(places) - 1), min(first + n, len(places)) - 1
                        out[row].append((item, 1.0, places[start][0], places[max(start, end)][1], 1))
            return out

        yield match


HITS = "array<struct<item_id:bigint,score:double,start:bigint,end:bigint,seeds:bigint>>"


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Alignment = Alignment(), id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, start, end, seeds), one row for each document and item it holds."""
    spark = docs.sparkSession
    texts = docs.select(text_of(text_col).alias("text"))
    out = spark.createDataFrame([], "doc_id long, item_id long, score double, start long, end long, seeds long")
    for match in _matchers(texts, benchmark, p, item_col, item_text_col):
        hits = docs.select(F.col(id_col).cast("long").alias("doc_id"), _hits(match)(text_of(text_col)).alias("hits"))
        out = out.unionByName(hits.select("doc_id", F.inline("hits")))
    return out


def _hits(match):
    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.Series:
        names = ("item_id", "score", "start", "end", "seeds")
        return pd.Series([[dict(zip(names, m)) for m in found] for found in match(pa.array(texts, pa.string()))])

    return hits


def without_contaminated(docs: DataFrame, benchmark: DataFrame, p: Alignment = Alignment(), text_col: str = "text",
                         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows whose text holds no item; all columns stay."""
    texts = docs.select(text_of(text_col).alias("text"))
    out = docs
    for match in _matchers(texts, benchmark, p, item_col, item_text_col):
        out = out.where(F.size(_hits(match)(text_of(text_col))) == 0)
    return out
