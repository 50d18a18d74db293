"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

Base spans are those of fixed patterns with checks (e-mail, IP address, payment card, phone number); they
always stay. Wider patterns and a list of first names propose further spans. On every span regex,
gazetteer and context labelers vote yes, no or nothing. How often each pattern of votes occurs is counted
over all documents; expectation-maximisation over these counts estimates how reliable each labeler is and
how likely each pattern is personal data, without labels. A logistic classifier over votes and shape is
trained on those probabilities and decides on the proposed spans. Those it accepts are added where they
touch no base span.

What reaches the driver is one row per kind, pattern of votes and shape: at most 5 x 3^6 x 2^8, however
many documents there are. Defined results: NULL and empty texts have no spans; ids may be NULL or repeated
(each row is judged alone); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workfold.llm.common import shipped, text_of
from workfold.llm.toxicity import fit_curve

KINDS = ("email", "ip", "card", "phone", "name")
# Gazetteers and cue words of the labelers.
FIRST_NAMES = ("James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica "
               "Thomas Sarah Charles Karen Daniel Nancy Matthew Lisa Anthony Betty Mark Sandra Steven Ashley Paul Emily Andrew Donna "
               "Hans Peter Wolfgang Klaus Ursula Monika Petra Sabine Pierre Jean Michel Philippe Nathalie Isabelle Sylvie "
               "Antonio Manuel Carmen Francisco Dolores Pilar Javier Miguel Alejandro Lucia").split()
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Madame", "Monsieur", "Senor", "Señor", "Señora")
DOMAIN_ENDS = frozenset("com org net edu gov io de fr es uk eu it nl ch at be us ca au info biz co".split())
CUES = {
    "email": re.compile(r"e-?mail|contact|write to|correo|kontakt|courriel|@"),
    "ip": re.compile(r"\bip\b|host|server|address|addr|login from|ping"),
    "card": re.compile(r"card|visa|master|amex|credit|debit|karte|carte|tarjeta"),
    "phone": re.compile(r"phone|tel\b|tel[.:]|call|fax|mobile|telefon|appel|whatsapp|sms"),
    "name": re.compile(r"name|contact|dear|author|signed|regards|\bby\b|heiss|je m'appelle|me llamo"),
}
AGAINST = re.compile(r"version|isbn|order|invoice|serial|section|page|figure|chapter|build|rev|no\.|id\b|[$€£%#]\s*$")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WIDE_EMAIL = re.compile(r"[\w.+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63}){1,4}")
AT_MARK = re.compile(r"(?i)[(\[{]at[)\]}]| dot ")
WIDE_DIGITS = re.compile(r"(?<![\w.+-])\(?[0-9][0-9 ().-]{5,30}[0-9](?![\w])")
IP6 = re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![\w:])")
NAMED = re.compile(r"(?: [A-Z][\w'-]+){0,2}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, found from their @ outwards in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        m, start = DOMAIN.match(text, at), at
        if m:
            while start > last and text[start - 1] in LOCAL:
                start -= 1
        if start < at:
            yield start, m.end()
            last = m.end()
        at = text.find("@", m.end() if start < at else at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def small_parts(dotted: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in dotted.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order of start and kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if small_parts(m[0])]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def proposals(text: str, names) -> list[tuple[int, int, int]]:
    """(start, kind, end) of spans that may be personal data."""
    out = []
    if AT_MARK.search(text):
        out += [(m.start(), 0, m.end()) for m in WIDE_EMAIL.finditer(text)]
    if DIGIT.search(text):
        for m in WIDE_DIGITS.finditer(text):
            n = sum(map(str.isdigit, m[0]))
            if m[0].count(".") == 3 and n == len(m[0]) - 3:
                out.append((m.start(), 1, m.end()))
            elif 7 <= n <= 19:
                out.append((m.start(), 2 if n >= 12 else 3, m.end()))
    if ":" in text:
        out += [(m.start(), 1, m.end()) for m in IP6.finditer(text) if m[0].count(":") >= 3 and len(m[0]) > 7]
    for last, size in names.iter(text):
        start, end = last - size + 1, last + 1
        if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
            continue
        out.append((start, 4, NAMED.match(text, end + (text[end:end + 1] == ".")).end()))
    return sorted(out)


def name_matcher():
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in (*FIRST_NAMES, *TITLES):
        found.add_word(w, len(w))
    found.make_automaton()
    return found


NOTHING = 2


def votes(text: str, start: int, kind: int, end: int, base: bool) -> tuple[int, ...]:
    """The labelers' votes: 1 personal, 0 not, 2 none. Regex, check, gazetteer, cue, edges, counter-cue."""
    span, before = text[start:end], text[max(0, start - 40):start].lower()
    digits = "".join(filter(str.isdigit, span))
    if kind == 0:
        check, listed = NOTHING, int(re.split(r"[.\s)\]]", span)[-1].lower() in DOMAIN_ENDS)
    elif kind == 1:
        check = int(":" in span or small_parts(span))
        listed = 0 if span.split(".")[0] in ("0", "00") else NOTHING
    elif kind == 2:
        check, listed = int(luhn(digits)), int(digits[0] in "3456")
    elif kind == 3:
        check, listed = int(9 <= len(digits) <= 15), (1 if span[0] == "+" and span[1] != "0" else NOTHING)
    else:
        parts = span.split(" ")
        check, listed = int(len(parts) > 1), int(parts[0] in FIRST_NAMES)
    left, right = text[start - 1:start], text[end:end + 1]
    edges = int(not (left.isalnum() or right.isalnum()))
    return (int(base), check, listed, 1 if CUES[KINDS[kind]].search(before) else NOTHING, edges, 0 if AGAINST.search(before[-20:]) else NOTHING)


def shape(text: str, start: int, end: int) -> int:
    span = text[start:end]
    bits = ("+" in span, "(" in span, "-" in span, "." in span, " " in span, start == 0 or text[start - 1] == "\n",
            text[end:end + 1] in ("", " ", ".", ",", "\n"), end - start >= 16)
    return sum(b << i for i, b in enumerate(bits))


def scan(text: str, names) -> list[tuple[int, int, int, bool, tuple[int, ...], int]]:
    """All spans with what the model needs: (start, kind, end, base, votes, shape). Proposals touch no base span."""
    base = base_spans(text)
    out = [(s, k, e, True, votes(text, s, k, e, True), shape(text, s, e)) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    at, reach = 0, 0
    for s, k, e in proposals(text, names):
        if s < reach:
            continue
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if any(b < e and f > s for b, f in taken[at:at + 8]):
            continue
        out.append((s, k, e, False, votes(text, s, k, e, False), shape(text, s, e)))
        reach = e
    return out


@dataclass
class SpanModel:
    """For each kind the labelers' reliabilities, and the weights of the classifier."""

    prior: dict[int, float] = field(default_factory=dict)
    reliability: dict[int, np.ndarray] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)
    threshold: float = 0.5

    def accepts(self, kind: int, vote: tuple[int, ...], form: int) -> bool:
        w = self.weights.get(kind)
        return w is not None and float(_features(vote, form) @ w) >= np.log(self.threshold / (1 - self.threshold))


def _features(vote: tuple[int, ...], form: int) -> np.ndarray:
    return np.array([1.0, *(float(v == x) for v in vote for x in (0, 1)), *(float(form >> i & 1) for i in range(8))])


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """(prior, P(vote | class) by labeler, class and vote, posterior of each pattern).

    Two classes; labelers are independent given the class. Starts from labelers that are right four
    times out of five when they vote, and keeps a little of that as pseudo-counts.
    """
    n, m = patterns.shape
    one_hot = np.eye(3)[patterns]
    start = np.array([[[0.4, 0.1, 0.5], [0.1, 0.4, 0.5]]] * m)  # not, personal; vote 0, 1, none
    rate, prior = start.copy(), 0.5
    post = np.full(n, 0.5)
    for _ in range(rounds):
        log = np.einsum("nmv,mcv->nc", one_hot, np.log(rate)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        weight = np.stack([counts * (1 - new), counts * new])
        rate = np.einsum("cn,nmv->mcv", weight, one_hot) + 4 * start
        rate /= rate.sum(2, keepdims=True)
        prior = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 1e-4, 1 - 1e-4))
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return prior, rate, new


def learn(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Count vote patterns and shapes over all documents, then fit the model on the counts."""
    shipped(docs.sparkSession)
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, seen = name_matcher(), {}
        for batch in batches:
            for text in batch["text"].to_pylist():
                for _, k, _, _, vote, form in scan(text, names):
                    key = (k, sum(v * 3 ** i for i, v in enumerate(vote)), form)
                    seen[key] = seen.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in seen], pa.int32()) for i in range(3)] + [pa.array(list(seen.values()), pa.int64())], ["kind", "pattern", "form", "n"])

    counted = docs.select(text_of(text_col).alias("text")).mapInArrow(count, "kind int, pattern int, form int, n long")
    rows = counted.groupBy("kind", "pattern", "form").agg(F.sum("n").alias("n")).collect()
    model = SpanModel()
    for kind in sorted({r.kind for r in rows}):
        own = sorted((r.pattern, r.form, r.n) for r in rows if r.kind == kind)
        patterns = np.array([[p // 3 ** i % 3 for i in range(6)] for p, _, _ in own])
        counts = np.array([n for _, _, n in own], float)
        model.prior[kind], model.reliability[kind], post = expectation_maximisation(patterns, counts)
        x = np.array([_features(tuple(v), f) for v, (_, f, _) in zip(patterns.tolist(), own)])
        # A soft label is two rows: personal with the posterior's weight, and not with the rest.
        model.weights[kind] = np.array(weighted_curve(np.concatenate([x, x]), np.repeat([1.0, 0.0], len(x)), np.concatenate([counts * post, counts * (1 - post)])))
    return model


def weighted_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    return fit_curve(x, y, weight=weight / max(1.0, weight.sum()) * 1000, ridge=0.5)


def finder(model: SpanModel):
    """A function text -> accepted spans (start, kind, end, base), in order."""
    names = name_matcher()

    def find(text: str) -> list[tuple[int, int, int, bool]]:
        return sorted((s, k, e, b) for s, k, e, b, vote, form in scan(text, names) if b or model.accepts(k, vote, form))

    return find


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document."""
    shipped(docs.sparkSession)
    model = model or learn(docs, text_col)

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def found(texts: pd.Series) -> pd.DataFrame:
        find, rows = finder(model), []
        for text in texts:
            spans = find(text)
            base = [(s, k, e) for s, k, e, b in spans if b]
            counts = [sum(k == i for _, k, _ in base) for i in range(4)]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined([x[:3] for x in spans])))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), found(text_of(text_col)).alias("f")).select("doc_id", "f.*")


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for s, k, e, _ in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_personal(docs: DataFrame, text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """The same rows and columns, personal data in the texts masked (NULL stays NULL)."""
    shipped(docs.sparkSession)
    model = model or learn(docs, text_col)

    @F.pandas_udf("string")
    def hide(texts: pd.Series) -> pd.Series:
        find = finder(model)
        return pd.Series([None if t is None else masked(t, find(t)) for t in texts], dtype=object)

    return docs.withColumn(text_col, hide(F.col(text_col).cast("string")))
