"""Secrets by a linear-chain conditional random field over the tokens of a text.

Base spans are those of fixed patterns (assignments, access keys, hex strings); they always stay. Tokens
are runs without white space. Features of a token's shape, its neighbours' words and the file give emission
weights, and Viterbi decodes begin, inside or outside over all tokens of the whole text, as one chain.

The weights are learned by maximum likelihood on the tokens of a bounded sample of documents, labelled by
the base patterns. Each assignment found there is shown again under other names and with values of other
shapes (capitals, small letters, hyphenated words), so that the field learns what surrounds a secret rather
than the patterns. Tokens that hold a digit, a sign that keys are made of or a capital after a small letter, that are
long and in capitals or joined by hyphens or dots, or that follow a cue word are learned in runs of neighbours
(``token_runs``), the others one by one between outside tokens; equal ones are counted, and together the others weigh no more
than the runs. Decoding reads every whole text. Defined results: NULL and empty texts have no spans;
ids may be NULL or repeated (each row is judged alone); an empty table gives no rows and learns nothing
(then only base spans are found); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import merge
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workfold.llm.common import shipped, text_of

KINDS = ("assign", "access", "hex", "secret")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEY_PARTS = ("passw", "secret", "token", "api")
KEY_PART = re.compile("|".join(KEY_PARTS))
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")

MAY = re.compile(r"[0-9=_+/\\{}]|[a-z][A-Z]")
LONG = re.compile(r"[A-Z]{16}|(?<=[A-Za-z0-9])[-.](?=[A-Za-z0-9])")
NEAR = re.compile(r"""(?:passw|passphrase|secret|token|key|auth|bearer|credential|login)[a-z]*["']?(?:[ \t]*[:=]+)?[ \t]*["']?(?=\S{8})""")
LEAST_LONG = 16
BLANK = re.compile(r"[ \n\t\r]")
TOKEN = re.compile(r"[^ \n\t\r]+")
OTHER_BLANK = re.compile(r"[^\S \n\t\r]")
CUE_WORDS = frozenset("password passwd pwd secret token apikey api_key key auth authorization bearer credential credentials access private client_secret passphrase login".split())
EDGE = "\"'`(),;:.<>{}[]"
VALUE = re.compile(r"""[\w.\-]*["']?[:=]["']?(?=\S{8})""")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order of start and kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEY_PARTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _candidates(text: str) -> Iterator[int]:
    """Places inside tokens that may be part of a secret, in order."""
    low = text.lower()
    near = (m.end() for m in NEAR.finditer(low)) if len(low) == len(text) else iter(())
    return merge((m.start() for m in MAY.finditer(text)), near, (~m.start() for m in LONG.finditer(text)), key=lambda at: at if at >= 0 else ~at)


def token_runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that may be part of a secret, as (start, end)."""
    found: list[list[tuple[int, int]]] = []
    reach = 0
    for at in _candidates(text):
        at, long = (at, False) if at >= 0 else (~at, True)
        if at < reach:
            continue
        start = max(text.rfind(c, reach, at) for c in " \n\t\r") + 1 or reach
        stop = BLANK.search(text, at)
        end = stop.start() if stop else len(text)
        if long and end - start < LEAST_LONG:
            continue
        if found and not text[found[-1][-1][1]:start].strip(" \n\t\r"):
            found[-1].append((start, end))
        else:
            found.append([(start, end)])
        reach = end
    return found


def _word(token: str) -> str:
    return token.strip(EDGE + "=").lower()


SIZES = (4, 8, 12, 16, 24, 40)
N_OWN, N_SIDE = 24, 6
N_FEATURES = 1 + N_OWN + 3 * N_SIDE + 2


HEX_DIGITS, KEY_SIGNS = "0123456789abcdef", frozenset("+/=_-")
NO_DIGITS, NO_LOWER, NO_UPPER = (str.maketrans("", "", cs) for cs in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def _mix(value: str) -> float:
    """Bits a character; of fewer than eight different ones it is below 3 and taken as 0."""
    kinds, n = set(value), len(value)
    return -sum(k / n * math.log2(k / n) for k in map(value.count, kinds)) if len(kinds) >= 8 else 0.0


def own_features(token: str) -> list[int]:
    """Shape of a token: size, kinds of characters, their mix, quotes, assignment, cue word."""
    body = token.strip(EDGE)
    if body.isalpha() and body.isascii():  # most words: letters alone, which hold no name, digit or sign
        kinds = len(SIZES) + 1
        mix = _mix(body)
        out = [bisect_right(SIZES, len(body))]
        if not body.isupper():
            out.append(kinds + 1)
        if not body.islower():
            out.append(kinds + 2)
        if not body.strip(HEX_DIGITS):
            out.append(kinds + 5)
        if mix >= 3:
            out.append(kinds + 6)
        if mix >= 3.5:
            out.append(kinds + 7)
        if token[0] in "\"'`":
            out.append(kinds + 10)
        out.append(kinds + 11)
        if body.lower() in CUE_WORDS:
            out.append(kinds + 15)
        return out
    value = body[m.end():] if (m := VALUE.match(body)) else body
    n, plain = len(value), value.isascii()
    digits = n - len(value.translate(NO_DIGITS))
    lower, upper = (n - len(value.translate(NO_LOWER)), n - len(value.translate(NO_UPPER))) if plain else (sum(c.islower() for c in value), sum(c.isupper() for c in value))
    mix = _mix(value)
    held = (digits > 0, lower > 0, upper > 0, n > digits + lower + upper, digits == n, not value.strip(HEX_DIGITS), mix >= 3, mix >= 3.5,
            0 < digits < n and lower + upper > 0, value is not body, token != body and token[:1] in "\"'`", plain, "://" in token or "@" in token,
            value.count(".") >= 2, not KEY_SIGNS.isdisjoint(value), _word(token) in CUE_WORDS)
    return [bisect_right(SIZES, n), *(len(SIZES) + 1 + i for i, h in enumerate(held) if h)]


def side_features(token: str) -> list[int]:
    """What a neighbour tells: none, cue word, assignment sign alone or at its end, quote, number."""
    if not token:
        return [0]
    word, last, out = _word(token), token[-1], []
    if word in CUE_WORDS or KEY_PART.search(word):
        out.append(1)
    if token in ("=", ":", ":=", "=>"):
        out.append(2)
    if last in "=:" and len(token) > 1:
        out.append(3)
    if last in "\"'":
        out.append(4)
    if word.isdigit():
        out.append(5)
    return out


def file_features(text: str) -> list[int]:
    """Whether the text looks like settings, and whether it looks like code."""
    head = text.count("\n") + 1
    return [i for i, held in enumerate((text.count("=") + text.count(": ") > 0.3 * head, text.count("{") + text.count(";\n") > 0.1 * head)) if held]


@lru_cache(100_000)
def _kept(word: str) -> tuple[tuple[int, ...], ...]:
    return tuple(own_features(word)), tuple(side_features(word))


def _features_of(word: str) -> tuple:
    """Own and side features of a word; a worker remembers those of short ones."""
    return _kept(word) if len(word) <= 64 else (own_features(word), side_features(word))


def around(text: str, run: list[tuple[int, int]]) -> list[str]:
    """Two words before a run, its tokens and the word after it; those that are not there are empty."""
    start, end = run[0][0], run[-1][1]
    before = text[max(0, start - 40):start].rsplit(None, 2)[-2:]
    after = text[end:end + 40].split(None, 1)[:1]
    return ["", "", *before][-2:] + [text[s:e] for s, e in run] + (after or [""])


def listed(shapes: list[tuple], file: list[int] | tuple[int, ...]) -> list[list[int]]:
    """The feature numbers of a run's tokens, by the own and side features of the words of ``around``."""
    out = []
    for i in range(len(shapes) - 3):
        own = [0] + [1 + f for f in shapes[i + 2][0]]
        for k, (_, side) in enumerate((shapes[i + 1], shapes[i], shapes[i + 3])):
            own += [1 + N_OWN + k * N_SIDE + f for f in side]
        out.append(own + [1 + N_OWN + 3 * N_SIDE + f for f in file])
    return out


def features(text: str, run: list[tuple[int, int]], file: list[int]) -> list[list[int]]:
    """The feature numbers of every token of a run."""
    return listed([_features_of(w) for w in around(text, run)], file)


class Shapes:
    """Numbers of words that look alike (``_features_of``), so that runs are counted without spelling their features out."""

    def __init__(self, words: int = 300_000):
        self.words = words
        self.known: dict[str, int] = {}
        self.numbers: dict[tuple, int] = {}
        self.shapes: list[tuple] = []

    def _number(self, word: str) -> int:
        own, side = _features_of(word)
        shape = tuple(own), tuple(side)
        n = self.numbers.setdefault(shape, len(self.shapes))
        if n == len(self.shapes):
            self.shapes.append(shape)
        if len(word) <= 64:
            if len(self.known) >= self.words:
                self.known.clear()
            self.known[word] = n
        return n

    def of(self, text: str, run: list[tuple[int, int]]) -> list[int]:
        """The shapes of two words before a run, of its tokens and of the word after it."""
        get, number = self.known.get, self._number
        return [number(w) if (n := get(w)) is None else n for w in around(text, run)]

    def each(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, ...]]:
        """``of`` for every token of a text as a run of its own; ``tokens`` are all its tokens."""
        if not tokens or OTHER_BLANK.search(text):
            return [tuple(self.of(text, [token])) for token in tokens]
        get, number = self.known.get, self._number
        none = number("")
        at = [none, none, *[number(w) if (n := get(w)) is None else n for w in (text[s:e] for s, e in tokens)], none]
        out = list(zip(at, at[1:], at[2:], at[3:]))
        # ``around`` looks 40 characters far, so words that reach beyond are cut there.
        starts, ends = np.array(tokens).T
        far = np.zeros(len(out), bool)
        far[1:] |= starts[1:] - starts[:-1] > 40
        far[2:] |= starts[2:] - starts[:-2] > 40
        far[:-1] |= ends[1:] - ends[:-1] > 40
        for i in np.flatnonzero(far).tolist():
            out[i] = tuple(self.of(text, [tokens[i]]))
        return out

    def features(self, held: tuple[int, ...], length: int) -> list[list[int]]:
        """The feature numbers of a run's tokens, by the shapes of ``of`` and the features of the file behind them."""
        return listed([self.shapes[n] for n in held[:length + 3]], held[length + 3:])


OUT, BEGIN, INSIDE = 0, 1, 2
NEVER = -30.0


def gold(run: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """Labels of a run's tokens by the base spans that reach into them."""
    out, last, low = [], None, 0
    for s, e in run:
        while low < len(spans) and spans[low][2] <= s:
            low += 1
        hit = None
        for b, k, f in islice(spans, low, None):
            if b >= e:
                break
            if f > s and (k != 0 or f <= e):  # the value of an assignment is the secret, so its last token counts
                hit = b, k, f
                break
        out.append(OUT if hit is None else INSIDE if hit == last else BEGIN)
        last = hit
    return out


@dataclass
class Field:
    """Weights of a linear chain: emission (feature, label) and transition (label, label)."""

    emission: np.ndarray
    transition: np.ndarray

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The best labels of a run that has outside tokens on both sides."""
        best, back = self.transition[OUT] + self.emission[rows[0]].sum(0), []
        for row in rows[1:]:
            all_ = best[:, None] + self.transition
            back.append(all_.argmax(0))
            best = all_.max(0) + self.emission[row].sum(0)
        labels = [int((best + self.transition[:, OUT]).argmax())]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


class Chains:
    """Decodes whole texts with a field, many side by side. What words weigh is remembered and decides no result."""

    def __init__(self, field: Field, words: int = 600_000):
        self.field, self.words = field, words
        self.known: dict[str, int] = {}
        self.shapes: dict[tuple, int] = {}
        self.weights = np.empty((1024, 4, 3))

    def _number(self, word: str) -> int:
        shape = tuple(own_features(word)), tuple(side_features(word))
        n = self.shapes.get(shape)
        if n is None:  # few shapes among many words
            n = self.shapes[shape] = len(self.shapes)
            if n == len(self.weights):
                self.weights = np.concatenate([self.weights, np.empty_like(self.weights)])
            own, side = shape
            self.weights[n, 0] = self.field.emission[[0, *(1 + f for f in own)]].sum(0)
            for k in range(3):
                self.weights[n, 1 + k] = self.field.emission[[1 + N_OWN + k * N_SIDE + f for f in side]].sum(0)
        if len(word) <= 64:
            self.known[word] = n
        return n

    def emissions(self, text: str) -> np.ndarray:
        """The weights of every label at every token: its own, those of two tokens before and one after, the file's."""
        none = self.known.get("")
        none = self._number("") if none is None else none
        get, number = self.known.get, self._number
        at = np.array([none, none, *[number(w) if (n := get(w)) is None else n for w in TOKEN.findall(text)], none])
        own, before, second, after = (self.weights[:, k] for k in range(4))
        file = self.field.emission[[1 + N_OWN + 3 * N_SIDE + f for f in file_features(text)]].sum(0)
        return own[at[2:-1]] + before[at[1:-2]] + second[at[:-3]] + after[at[3:]] + file

    def labels(self, texts: list[str]) -> list[np.ndarray]:
        """The best labels of all tokens of each text; outside stands on both sides of a text."""
        if len(self.known) > self.words:
            self.known.clear()
        rows = [self.emissions(t) for t in texts]
        sizes = np.array([len(r) for r in rows])
        order = np.argsort(-sizes, kind="stable")
        held = sizes[order]
        first = np.concatenate([[0], np.cumsum(held)[:-1]])  # where a chain begins among all tokens
        flat = np.concatenate([rows[i] for i in order]) if len(rows) else np.empty((0, 3))
        steps = int(held[0]) if len(held) else 0
        live = np.searchsorted(-held, -np.arange(steps), side="left")  # chains longer than t
        transition, back, found = self.field.transition, np.zeros(flat.shape, np.uint8), np.zeros(len(flat), np.uint8)
        if steps:
            best = transition[OUT] + flat[np.minimum(first, len(flat) - 1)]
        for t in range(1, steps):
            n = live[t]
            all_ = best[:n, :, None] + transition
            back[first[:n] + t] = all_.argmax(1)
            best[:n] = all_.max(1) + flat[first[:n] + t]
        if steps:
            now = (best + transition[:, OUT]).argmax(1)
        for t in range(steps - 1, -1, -1):
            n = live[t]
            found[first[:n] + t] = now[:n]
            now[:n] = back[first[:n] + t, now[:n]]
        out = [found[:0]] * len(rows)
        for i, low, n in zip(order, first, held):
            out[i] = found[low:low + n]
        return out


@lru_cache(1)
def _chains(emission: bytes, transition: bytes) -> Chains:
    """The chains of a field, kept by a worker from task to task with the words it remembers."""
    return Chains(Field(np.frombuffer(emission).reshape(-1, 3), np.frombuffer(transition).reshape(3, 3)))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def fit(runs: list[tuple[list[list[int]], list[int], int]], rounds: int = 300, ridge: float = 1e-4) -> Field:
    """Maximum likelihood by gradient steps with momentum; runs are (features, labels, how often)."""
    groups: dict[int, list] = {}
    for rows, labels, n in runs:
        groups.setdefault(len(rows), []).append((rows, labels, n))
    data = []
    for length, own in sorted(groups.items()):
        x = np.zeros((len(own), length, N_FEATURES), np.float32)
        for i, (rows, _, _) in enumerate(own):
            for t, row in enumerate(rows):
                x[i, t, row] = 1
        data.append((x, np.array([labels for _, labels, _ in own]), np.array([n for _, _, n in own], float)))
    total = sum(w.sum() for _, _, w in data)
    emission, transition = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    transition[OUT, INSIDE] = NEVER
    first = [np.zeros_like(emission), np.zeros_like(transition)]
    second = [np.zeros_like(emission), np.zeros_like(transition)]
    for step in range(1, rounds + 1):
        grads = [ridge * emission, ridge * transition]
        for x, y, weight in data:
            n, length, _ = x.shape
            e = x @ emission
            alpha, beta = [transition[OUT] + e[:, 0]], [np.broadcast_to(transition[:, OUT], (n, 3))]
            for t in range(1, length):
                alpha.append(_logsum(alpha[-1][:, :, None] + transition, 1) + e[:, t])
                beta.append(_logsum(transition[None] + (e[:, length - t] + beta[-1])[:, None, :], 2))
            beta = beta[::-1]
            whole = _logsum(alpha[-1] + transition[:, OUT], 1)
            w = weight / total
            for t in range(length):
                p = np.exp(alpha[t] + beta[t] - whole[:, None])
                grads[0] += x[:, t].T @ ((p - np.eye(3)[y[:, t]]) * w[:, None])
                if t:
                    pair = np.exp(alpha[t - 1][:, :, None] + transition + (e[:, t] + beta[t])[:, None, :] - whole[:, None, None])
                    np.subtract.at(pair, (np.arange(n), y[:, t - 1], y[:, t]), 1)
                    grads[1] += (pair * w[:, None, None]).sum(0)
            for p, label, ends in ((np.exp(alpha[0] + beta[0] - whole[:, None]), y[:, 0], False), (np.exp(alpha[-1] + beta[-1] - whole[:, None]), y[:, -1], True)):
                edge = ((p - np.eye(3)[label]) * w[:, None]).sum(0)
                if ends:
                    grads[1][:, OUT] += edge
                else:
                    grads[1][OUT] += edge
        grads[1][OUT, INSIDE] = 0
        for i, value in enumerate((emission, transition)):
            first[i] = 0.9 * first[i] + 0.1 * grads[i]
            second[i] = 0.99 * second[i] + 0.01 * grads[i] ** 2
            value -= 0.2 * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-8)
    return Field(emission, transition)


OTHER_NAMES = ("passphrase: ", "client key = ", "Bearer ", "auth: ", "private_key=", "credential: ", "access key: ", "login = ", "Authorization: Bearer ")


def shown_again(text: str, span: tuple[int, int, int]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """An assignment under other names and with values of other shapes, each with its surroundings and labelled
    span, and such values without a name, which are none."""
    start, _, end = span
    m = ASSIGN.match(text, start, end)
    if not m:
        return []
    before, after = text[max(0, start - 80):start], text[end:end + 80]
    value = m[2]
    turn = int.from_bytes(hashlib.blake2b(value.encode(), digest_size=4).digest(), "little")
    letters = "".join(c if c.isalpha() else "bcdfghjkmp"[ord(c) % 10] for c in value)
    words = [w for w in re.findall(r"[a-z]{3,8}", (before + after).lower())][:4] or ["some", "other", "words"]
    out = []
    for i, other in enumerate((letters.upper(), letters.lower(), "-".join(words), value)):
        if len(other) >= 8:
            name = OTHER_NAMES[(turn + i * 3) % len(OTHER_NAMES)]
            at = len(before) + len(name)
            out.append((before + name + other + after, [(at, 3, at + len(other))]))
            if i < 3:  # of the same shape, but nothing says that it is a secret
                out.append((f"{before}the {other} {after}", []))
    return out


@dataclass(frozen=True)
class Sample:
    """Bounds of what is learned from: documents, and tokens of one run (longer runs are cut)."""

    documents: int = 20_000
    run: int = 30


def learn(docs: DataFrame, sample: Sample = Sample(), text_col: str = "text") -> Field | None:
    """Fit the field on a bounded sample of documents, chosen by the hash of their texts."""
    shipped(docs.sparkSession)
    rows = docs.select(text_of(text_col).alias("text"))
    n = rows.count()
    if not n:
        return None
    share = int(min(1.0, sample.documents / n) * 1_000_000)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        shapes = Shapes()
        for batch in batches:
            for text in batch["text"].to_pylist():
                spans, file = base_spans(text), file_features(text)
                for shown, own in [(text, spans), *(x for span in spans if span[1] == 0 for x in shown_again(text, span))]:
                    runs = token_runs(shown)
                    for run in runs:
                        for low in range(0, len(run), sample.run):
                            part = run[low:low + sample.run]
                            seen[(*shapes.of(shown, part), *file), tuple(gold(part, own)), False] += 1
                    tokens = [m.span() for m in TOKEN.finditer(shown)]
                    inside = {token for run in runs for token in run}
                    alone = [(token, held) for token, held in zip(tokens, shapes.each(shown, tokens)) if token not in inside]
                    seen.update(((*held, *file), tuple(gold([token], own)) if own else (OUT,), True) for token, held in alone)
        # Equal features are written alike, whatever the numbers of a worker's shapes.
        told: Counter = Counter()
        for (held, labels, other), n in seen.items():
            told[json.dumps([shapes.features(held, len(labels)), labels]), other] += n
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in told], pa.string()), pa.array([p for _, p in told], pa.bool_()),
                                          pa.array(told.values(), pa.int64())], ["run", "other", "n"])

    picked = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share)
    counted = picked.mapInArrow(label, "run string, other boolean, n long").groupBy("run", "other").agg(F.sum("n").alias("n"))
    # All different runs of the sampled documents; equal ones are counted, so they are far fewer than its tokens.
    found = [(*json.loads(r.run), r.other, r.n) for r in counted.collect()]
    weight = [sum(n for _, _, o, n in found if o == other) for other in (False, True)]
    less = min(1.0, weight[0] / weight[1]) if weight[0] and weight[1] else 1.0
    runs = sorted((rows, labels, n * less if other else n) for rows, labels, other, n in found)
    return fit(runs) if runs else None


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without quotes and marks at its edges, and without the name it is assigned to."""
    while start < end and text[start] in EDGE:
        start += 1
    while end > start and text[end - 1] in EDGE:
        end -= 1
    m = VALUE.match(text, start, end)
    return (m.end() if m else start), end


def find(text: str, field: Field | None, labels: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and added ones, by the ``labels`` of all tokens (decoded here if not given); an added span touches no base span."""
    base = base_spans(text)
    if labels is None:
        labels = Chains(field).labels([text])[0] if field else np.zeros(0, np.uint8)
    if not labels.any():
        return base, []
    added = []
    taken = sorted((s, e) for s, _, e in base)
    run = [m.span() for m in TOKEN.finditer(text)]
    i = at = 0
    while i < len(run):
        if labels[i] == OUT:
            i += 1
            continue
        j = i + 1
        while j < len(run) and labels[j] == INSIDE:
            j += 1
        start, end = trimmed(text, run[i][0], run[j - 1][1])
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if end > start and not any(b < end and f > start for b, f in taken[max(0, at - 2):at + 4]):
            added.append((start, 3, end))
        i = j
    return base, added


CHARS = 4_000_000


def together(texts: list[str], chars: int = CHARS) -> Iterator[list[str]]:
    """The texts in order, in groups of so many characters or one longer text."""
    group, held = [], 0
    for text in texts:
        if group and held + len(text) > chars:
            yield group
            group, held = [], 0
        group.append(text)
        held += len(text)
    if group:
        yield group


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    shipped(docs.sparkSession)
    field = field or learn(docs, text_col=text_col)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        chains = field and _chains(field.emission.tobytes(), field.transition.tobytes())
        for texts in batches:
            rows = []
            for group in together(texts.tolist()):
                for text, labels in zip(group, chains.labels(group) if chains else [np.zeros(0, np.uint8)] * len(group)):
                    base, added = find(text, field, labels)
                    counts = [sum(k == i for _, k, _ in base) for i in range(3)]
                    rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added))))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), found(text_of(text_col)).alias("f")).select("doc_id", "f.*")
