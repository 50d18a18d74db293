"""Fill-in-the-middle texts: whole lines are cut into prefix, middle and suffix and put in another order.

A text is cut into chunks where a rolling hash of its last 32 bytes says so, so equal passages give equal
chunks wherever they stand. What a chunk holds is summarised once a worker: its line ends and its characters
(code points). A cache of bounded size, keyed by the chunk's bytes (so a hit is verified by content), gives
the summary back when the chunk is met again. The counts of a text are the sums over its chunks, and a cut
after so many lines is looked up in those sums, then in the line ends of one chunk.

Defined results: NULL texts are empty; empty texts and texts that hold a mark stay as they are ('plain');
a NULL id counts as an empty string in the draw and stays NULL; repeated rows are kept, each as its own;
an empty table gives no rows; other columns are ignored, whatever their names. The last line may lack its
line break. A text is held whole by one task, its chunks are not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workfold.llm.common import mixed, ragged, shipped, text_chunks, text_of

GEAR = mixed(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
WINDOW = 32
SHAPED = "id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Infill:
    """Marks, draws and the sizes of chunks; ``cached`` bounds the bytes of chunks a worker remembers."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 7
    rate: int = 100
    spm_rate: int = 50
    bits: int = 10
    longest: int = 1 << 14
    cached: int = 24 << 20


def chunk_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, longest: int) -> np.ndarray:
    """Where chunks end in the bytes of texts that stand one after the other, texts' own ends included.

    A chunk ends where the top bits of the hash of the last 32 bytes are zero, not before the text has 32
    bytes, and ``longest`` bytes after the last end where that comes first.
    """
    h = GEAR[data]
    for shift in (1, 2, 4, 8, 16):  # sums of 2, 4, .. 32 bytes, each shifted once a step
        h[shift:] += h[:-shift] << np.uint32(shift)
    hits = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    if len(hits):
        text = np.searchsorted(ends, hits, "left")
        hits = hits[hits - starts[text] >= WINDOW]
    found = np.union1d(hits, ends[ends > starts])
    gaps = np.diff(found, prepend=starts[0] if len(starts) else 0)
    more = (gaps - 1) // longest
    extra = np.repeat(found - gaps, more) + longest * (ragged(np.ones(len(more), np.int64), more))
    return np.union1d(found, extra)


class Summaries:
    """(line breaks, code points, ends of the lines) of chunks, remembered by content in bounded memory.

    Two generations: a full young one becomes the old one, and what is used again moves back.
    """

    def __init__(self, most: int):
        self.half, self.held = most // 2, 0
        self.young: dict[bytes, tuple[int, int, np.ndarray]] = {}
        self.old: dict[bytes, tuple[int, int, np.ndarray]] = {}

    def of(self, chunk: bytes) -> tuple[int, int, np.ndarray]:
        known = self.young.get(chunk)
        if known is None:
            known = self.old.get(chunk)
            if known is None:
                raw = np.frombuffer(chunk, np.int8)
                breaks = np.flatnonzero(raw == 10) + 1
                known = (len(breaks), int(np.count_nonzero(raw >= -64)), breaks.astype(np.int32))
            if self.held + len(chunk) > self.half:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[chunk] = known
            self.held += len(chunk)
        return known


_CACHES: dict[int, Summaries] = {}


def _draw(key: str, p: Infill) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{p.seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[8 * i:8 * i + 8], 16) for i in range(4))


class _Cuts:
    """The lines of one text, known by the summaries of its chunks."""

    def __init__(self, chunks: list[bytes], cache: Summaries):
        self.chunks = chunks
        self.known = [cache.of(c) for c in chunks]
        self.lines = np.cumsum([k[0] for k in self.known], dtype=np.int64)
        self.chars = np.cumsum([k[1] for k in self.known], dtype=np.int64)
        self.bytes = np.cumsum([len(c) for c in chunks], dtype=np.int64)
        whole = int(self.lines[-1]) if chunks else 0
        self.n = whole + bool(chunks and not chunks[-1].endswith(b"\n"))

    def after(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``k`` lines."""
        if k == 0:
            return 0, 0
        if k == self.n:
            return int(self.bytes[-1]), int(self.chars[-1])
        i = int(np.searchsorted(self.lines, k))
        before = (int(self.lines[i - 1]), int(self.bytes[i - 1]), int(self.chars[i - 1])) if i else (0, 0, 0)
        end = int(self.known[i][2][k - before[0] - 1])
        part = np.frombuffer(self.chunks[i], np.int8, end)
        return before[1] + end, before[2] + int(np.count_nonzero(part >= -64))


def _shaper(p: Infill):
    marks = [m.encode() for m in (p.prefix, p.suffix, p.middle)]

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _CACHES.setdefault(p.cached, Summaries(p.cached))
        for batch in batches:
            for a, b in text_chunks(batch["text"]):
                ids, texts = batch["id"].slice(a, b - a), batch["text"].slice(a, b - a).cast(pa.large_binary())
                edges = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
                raw = texts.buffers()[2].slice(int(edges[0]), int(edges[-1] - edges[0])).to_pybytes() if edges[-1] > edges[0] else b""
                edges = edges - edges[0]
                ends = chunk_ends(np.frombuffer(raw, np.uint8), edges[:-1], edges[1:], p.bits, p.longest) if raw else edges[:0]
                first = np.searchsorted(ends, edges[:-1], "right").tolist()
                last = np.searchsorted(ends, edges[1:], "right").tolist()
                ends, edges = ends.tolist(), edges.tolist()
                cols: list[list] = [[] for _ in range(5)]
                for i, key in enumerate(ids.to_pylist()):
                    inner = ends[first[i]:last[i]]
                    cuts = _Cuts([raw[s:e] for s, e in zip([edges[i], *inner], inner)], cache)
                    text = raw[edges[i]:edges[i + 1]]
                    h1, h2, h3, h4 = _draw("" if key is None else str(key), p)
                    row = (cuts.n, "plain", None, None, text)
                    if text and h3 % 100 < p.rate and not any(m in text for m in marks):
                        x, y = h1 % (cuts.n + 1), h2 % (cuts.n + 1)
                        (one, one_chars), (two, two_chars) = cuts.after(min(x, y)), cuts.after(max(x, y))
                        start, mid, rest = marks[0] + text[:one], marks[2] + text[one:two], marks[1] + text[two:]
                        spm = h4 % 100 < p.spm_rate
                        row = (cuts.n, "spm" if spm else "psm", one_chars, two_chars - one_chars,
                               rest + start + mid if spm else start + rest + mid)
                    for c, v in zip(cols, row):
                        c.append(v)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(c, t) for c, t in zip(cols, types)], pa.array(cols[4], pa.binary()).cast(pa.string())],
                    ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return shape


def fill_in_middle(docs: DataFrame, p: Infill = Infill(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every whole text, one row each."""
    shipped(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).mapInArrow(_shaper(p), SHAPED)


def restored(shaped: DataFrame, p: Infill = Infill()) -> DataFrame:
    """The rows with ``text``, rebuilt from the output and its form alone."""
    escaped = ["".join("\\" + c if not c.isalnum() else c for c in m) for m in (p.prefix, p.suffix, p.middle)]
    parts = F.split("output", "|".join(escaped))
    text = F.when(F.col("form") == "psm", F.concat(parts[1], parts[3], parts[2])).when(
        F.col("form") == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(F.col("output"))
    return shaped.withColumn("text", text)
