"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

Folding lowers the text, maps letters of other scripts that look like Latin ones, digits and signs that
stand for letters inside a word, and drops characters without width. The lexicon is learned from labelled
rows: words and word beginnings that are dense in toxic texts, chosen greedily until no entry explains
enough toxic texts that are still unexplained; weights are log odds. Phrases of an entry and a neighbouring word
that only clean texts hold are exceptions, which cancel a match. A logistic curve over the summed weight
and its density gives the score.

Learning uses at most about ``train_rows`` labelled rows (a stated bound, chosen by the hash of the id);
scoring reads every whole text. Defined results: NULL and empty texts score as texts without a match;
rows with a NULL id are never training rows; repeated rows score alike; without toxic training rows the
lexicon is empty and every score is the share of toxic labels; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workfold.llm.common import shipped, text_of

# Fixed values of the folding: look-alikes, and signs that stand for letters between letters.
LOOK_ALIKES = dict(zip("аеорсухіјѕԁԛԝһкмнтвαοερτικνυχωη", "aeopcyxijsdqwhkmhtbaoeptikvuxwn"))
SIGNS = dict(zip("013457@$!|", "oieastasil"))
WIDTHLESS = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])
_FULL_WIDTH = {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: str(i) for i in range(10)}
_TABLE = {ord(a): b for a, b in LOOK_ALIKES.items()} | WIDTHLESS | _FULL_WIDTH
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in _TABLE) + "]")
_SIGN = re.compile(r"(?<=[^\W\d_])[013457@$!|]+(?=[^\W\d_])|(?<!\w)[01345@$](?=[^\W\d_]{2})|(?<=[^\W\d_]{2})[01347](?!\w)")
_SIGN_TABLE = str.maketrans(SIGNS)
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """The text with case, look-alike letters and letter-like signs undone."""
    text = text.lower()
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_TABLE)
    for _ in range(2):  # a sign may stand for a letter only beside one that stood for a letter
        text, n = _SIGN.subn(lambda m: m[0].translate(_SIGN_TABLE), text)
        if not n:
            break
    return text


@dataclass(frozen=True)
class Toxicity:
    train_rows: int = 20_000
    shortest: int = 3
    longest: int = 8
    min_density: float = 0.005
    min_docs: int = 3
    min_precision: float = 0.6
    min_gain: float = 0.002
    times: int = 2
    threshold: float = 0.3


@dataclass
class Lexicon:
    """Entries (a word beginning, or a whole word where it ends in a blank) with weights, exceptions, curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    curve: tuple[float, ...] = ()
    base: float = 0.0

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry in self.weights:
            found.add_word(entry.rstrip(), (len(entry.rstrip()), entry))
        for entry in self.weights:  # a whole word and the beginning of others may be one string
            plain = entry.rstrip()
            if plain in self.weights:
                found.add_word(plain, (len(plain), plain))
        if len(found):
            found.make_automaton()
        return found

    def matches(self, folded: str, matcher) -> list[tuple[int, int, str]]:
        """(start, end, entry) of the longest entry at each word that begins with one."""
        if not len(matcher):
            return []
        best: dict[int, tuple[int, str]] = {}
        n = len(folded)
        for last, (size, entry) in matcher.iter(folded):
            start, end = last - size + 1, last + 1
            if start and folded[start - 1].isalpha():
                continue
            if entry[-1] == " " and end < n and folded[end].isalpha():
                continue
            if start not in best or size >= best[start][0]:
                best[start] = (size, entry)
        return [(s, s + size, entry) for s, (size, entry) in sorted(best.items())]

    def features(self, folded: str, matcher) -> tuple[float, float]:
        """The weight of all matches that no exception cancels, and the number of words."""
        words = folded.count(" ") + folded.count("\n") + 1
        total = 0.0
        exceptions = set(self.exceptions)
        for start, end, entry in self.matches(folded, matcher):
            if not exceptions or not exceptions.intersection(phrases(folded, start, end, entry)):
                total += self.weights[entry]
        return total, float(words)

    def score(self, total: np.ndarray, words: np.ndarray) -> np.ndarray:
        if not self.curve:
            return np.full(len(total), self.base)
        z = _inputs(total, words) @ np.array(self.curve)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _inputs(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), (total > 0).astype(float), np.log1p(total), np.log1p(100 * total / np.maximum(words, 1))], 1)


def phrases(folded: str, start: int, end: int, entry: str) -> list[str]:
    """The entry with the word before and the word after it."""
    before = _WORD.findall(folded[max(0, start - 40):start])
    while end < len(folded) and folded[end].isalpha():
        end += 1
    after = _WORD.search(folded, end, end + 40)
    return ([f"{before[-1]} {entry}"] if before else []) + ([f"{entry}|{after[0]}"] if after else [])


def terms_of(folded: str, p: Toxicity) -> set[str]:
    """Whole words (marked by a blank) and word beginnings that are dense enough in a text."""
    words = Counter(_WORD.findall(folded))
    n, out = sum(words.values()), Counter()
    for w, c in words.items():
        if len(w) >= p.shortest:
            out[w + " "] += c
            for k in range(p.shortest, min(p.longest, len(w) - 1) + 1):
                out[w[:k]] += c
    return {t for t, c in out.items() if c >= p.min_density * n}


def held_out(id_col: str = "doc_id") -> Column:
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4) == 2


def learn(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity(), id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Fit the lexicon on labelled rows that are not held out."""
    shipped(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    known = known.where(~held_out("_id")).groupBy("_id").agg(F.max("_y").alias("_y"))
    n = known.count()
    if not n:
        return Lexicon()
    share = min(1.0, p.train_rows / n)
    picked = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # The sample is bounded, and repeated texts count once.
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("text")).join(picked, "_id")
    rows = rows.groupBy("text").agg(F.max("_y").alias("y")).persist()
    try:
        return _fit(rows, p)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame, p: Toxicity) -> Lexicon:
    sizes = rows.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    if not sizes.n:
        return Lexicon()
    pos, neg = int(sizes.y), int(sizes.n - sizes.y)
    base = pos / sizes.n
    if not pos or not neg:
        return Lexicon(base=base)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist()):
                seen[y].update(terms_of(fold(text), p))
            if len(seen[0]) + len(seen[1]) > 500_000:
                yield _counts(seen)
                seen = (Counter(), Counter())
        yield _counts(seen)

    counted = rows.mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    good = counted.where((F.col("pos") >= p.min_docs) & (F.col("pos") / (F.col("pos") + F.col("neg")) >= p.min_precision))
    # Bounded by the sample: a term stands in ``min_docs`` of its texts and is dense there, so a text has 1 / min_density at most.
    table = {r.term: (r.pos, r.neg) for r in good.collect()}

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(terms_of(fold(t), p) & table.keys()) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], ["terms"])

    toxic = [set(r.terms) for r in rows.where("y = 1").mapInArrow(held, "terms array<string>").collect()]
    chosen = cover(toxic, table, max(p.min_docs, math.ceil(p.min_gain * pos)), p.times)
    weights = {t: math.log((table[t][0] + 0.5) / (pos + 1)) - math.log((table[t][1] + 0.5) / (neg + 1)) for t in chosen}
    lexicon = Lexicon({t: w for t, w in weights.items() if w > 0}, base=base)
    if not lexicon.weights:
        return lexicon

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            out = [sorted({x for s, e, t in lexicon.matches(f, matcher) for x in phrases(f, s, e, t)}) for f in map(fold, batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), batch["y"]], ["said", "y"])

    said = rows.mapInArrow(told, "said array<string>, y int").select(F.explode("said").alias("phrase"), "y")
    only_clean = said.groupBy("phrase").agg(F.sum("y").alias("pos"), F.count("*").alias("n")).where(f"pos = 0 AND n >= {p.min_docs}")
    lexicon.exceptions = tuple(sorted(r.phrase for r in only_clean.select("phrase").collect()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = lexicon.matcher()
        for batch in batches:
            got = [lexicon.features(fold(t), matcher) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), batch["y"]], ["total", "words", "y"])

    got = rows.mapInArrow(measured, "total double, words double, y int").collect()
    lexicon.curve = fit_curve(_inputs(np.array([r.total for r in got]), np.array([r.words for r in got])), np.array([r.y for r in got], float))
    return lexicon


def _counts(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
    terms = list(seen[0].keys() | seen[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], ["term", "pos", "neg"])


def cover(toxic: list[set[str]], table: dict[str, tuple[int, int]], least: int, times: int) -> list[str]:
    """Entries in the order they explain the most texts that earlier entries do not explain ``times`` times.

    A clean text that holds an entry costs what two toxic ones gain. Among equals the longer entry, so the
    more specific one, is taken.
    """
    where = defaultdict(set)
    for i, terms in enumerate(toxic):
        for t in terms:
            where[t].add(i)
    left, missing, chosen = set(range(len(toxic))), [times] * len(toxic), []
    gains = {t: len(where[t]) - 2 * table[t][1] for t in where}
    order = sorted(where, key=lambda t: (-gains[t], -len(t), t))
    while True:
        best, best_gain = None, least - 1
        for t in order:
            if gains[t] <= best_gain:
                break
            gain = len(where[t] & left) - 2 * table[t][1]
            if gain > best_gain and t not in chosen and not any(nested(t, c) for c in chosen):
                best, best_gain = t, gain
        if best is None:
            return chosen
        chosen.append(best)
        for i in where[best]:
            missing[i] -= 1
            if not missing[i]:
                left.discard(i)
    return chosen


def nested(a: str, b: str) -> bool:
    """Whether one entry's words are among the other's."""
    a, b = sorted((a, b), key=len)
    return b.startswith(a.rstrip()) and (a[-1] != " " or a == b)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, weight: np.ndarray | None = None) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with a small ridge."""
    w, weight = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    for _ in range(50):
        m = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * (m * (1 - m) + 1e-9))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (m - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


_MATCHERS: dict[int, tuple] = {}


def scorer(lexicon: Lexicon):
    """A column function: text -> score."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        key = hash((tuple(lexicon.weights.items()), lexicon.exceptions))
        if key not in _MATCHERS:  # built once a worker
            _MATCHERS.clear()
            _MATCHERS[key] = (lexicon.matcher(),)
        matcher = _MATCHERS[key][0]
        got = [lexicon.features(fold(t), matcher) for t in texts]
        return pd.Series(lexicon.score(np.array([g[0] for g in got]), np.array([g[1] for g in got])))

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    score = scorer(learn(docs, labels, p, id_col, text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), score(text_of(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= p.threshold).cast("int"))
