"""Small helpers the operators share: texts, tokens, runs of sorted rows, ragged arrays."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = -(1 << 63)
"""The order key of a NULL id: it comes before every other id."""


def text_of(name: str) -> Column:
    """A text column, NULL as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_key(name: str) -> Column:
    """An integer id that sorts and joins like any other where it is NULL."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LEAST))


def id_back(key: Column) -> Column:
    return F.when(key != LEAST, key)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1 of every i, one after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of at least ``least`` rows with equal keys, from batches sorted by them.

    A run may span batches; only the last run of a batch is kept back, so memory holds one batch and
    one run.
    """
    held: list[pa.Table] = []
    held_key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        cols = [table[k].to_numpy() for k in keys]
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], table.num_rows)
        if held_key is not None:
            if tuple(c[0] for c in cols) == held_key:
                held.append(table.slice(0, int(ends[0])))
                if len(starts) == 1:
                    continue
                starts, ends = starts[1:], ends[1:]
            if sum(t.num_rows for t in held) >= least:
                yield held_key, pa.concat_tables(held)
        for i in np.flatnonzero(ends[:-1] - starts[:-1] >= least).tolist():
            s = int(starts[i])
            yield tuple(c[s] for c in cols), table.slice(s, int(ends[i]) - s)
        s = int(starts[-1])
        held, held_key = [table.slice(s)], tuple(c[s] for c in cols)
    if held_key is not None and sum(t.num_rows for t in held) >= least:
        yield held_key, pa.concat_tables(held)


class WordTable:
    """Texts as arrays of numbers: each word between blanks stands for some numbers, in a fixed width.

    Words seen before come from a table, two Arrow arrays, that stops growing at ``most`` words.
    """

    width = "<u4"

    def __init__(self, most: int = 600_000):
        self.most = most
        self.known = pa.array([], pa.string())
        self.values = pa.array([], pa.binary())

    def _learn(self, words: pa.Array) -> pa.Array:
        """The numbers of distinct words, as binary of ``width``."""
        raise NotImplementedError

    def encode(self, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
        """All numbers one after the other, little-endian, and how many each text has.

        Words are numbered by Arrow's dictionary encoding and looked up together, so a word of a batch is
        looked at once, and Python only sees new ones.
        """
        for blank in ("\n", "\t", "\r"):
            texts = pc.replace_substring(texts, blank, " ")
        parts = pc.split_pattern(texts, " ")
        words = parts.flatten().dictionary_encode()
        at = pc.index_in(words.dictionary, value_set=self.known).to_numpy(zero_copy_only=False)
        values, new = self.values, np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
        if new.any():
            missing = words.dictionary.filter(pa.array(new))
            learned = self._learn(missing)
            at[new] = len(values) + np.arange(len(missing))
            values = pa.concat_arrays([values, learned])
            if len(self.known) < self.most:  # a full table keeps its words
                self.known, self.values = pa.concat_arrays([self.known, missing]), values
        numbers = values.take(pa.array(at.astype(np.int64))).take(words.indices)
        ends = np.frombuffer(numbers.buffers()[1], np.int32, len(numbers) + 1, numbers.offset * 4)
        per_text = np.diff(ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()]) // np.dtype(self.width).itemsize
        flat = numbers.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])) if len(numbers) else pa.py_buffer(b"")
        return flat, per_text.astype(np.int64)

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = self.encode(texts)
        return np.frombuffer(flat, self.width), counts


LETTERS = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}]+[.,]?$"
"""Words of letters below U+0130, where lower case is one letter for one, with one closing mark at most."""


class WordIds(WordTable):
    """Token ids of whole texts by the tokenizers library, one call per distinct word.

    The vocabulary's splitter never joins characters across a blank or a line break, so the ids
    of a text are those of its words in order.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer

        super().__init__(most)
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks = pa.array([b"", *self._ids([".", ","])], pa.binary())

    def _ids(self, words: list[str]) -> list[bytes]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return [np.array(ids, "<u4").tobytes() for ids in got]

    def _ids_of_letters(self, words: pa.Array) -> pa.Array:
        """The ids of words of letters only, many in one text: each ends with its one closing token."""
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.arange(0, len(words), 500), len(words)), pa.int32()), words)
        got = self.tokenizer.encode_batch_fast(pc.binary_join(lists, " ").to_pylist(), add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(e.ids for e in got), "<u4")
        ends = np.flatnonzero(self.closing[flat]) + 1
        if len(ends) != len(words):
            return pa.array(self._ids(words.to_pylist()), pa.binary())
        offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])

    def _learn(self, words: pa.Array) -> pa.Array:
        """Words of letters by their stems in lower case, which many share, the mark apart; others as they are."""
        plain = pc.match_substring_regex(words, LETTERS)
        low = pc.utf8_lower(words.filter(plain))
        mark = np.where(pc.ends_with(low, "."), 1, np.where(pc.ends_with(low, ","), 2, 0))
        stems = pc.utf8_rtrim(low, ".,").dictionary_encode()
        of_stem = self._ids_of_letters(stems.dictionary) if len(stems) else pa.array([], pa.binary())
        learned = pc.binary_join_element_wise(of_stem.take(stems.indices), self.marks.take(pa.array(mark)), b"")
        odd = words.filter(pc.invert(plain)).to_pylist()
        where = plain.to_numpy(zero_copy_only=False)
        order = np.empty(len(words), np.int64)
        order[where], order[~where] = np.arange(where.sum()), where.sum() + np.arange(len(odd))
        return pa.concat_arrays([learned, pa.array(self._ids(odd), pa.binary())]).take(pa.array(order))


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One encoder a worker process, so its table serves all the tasks that run there."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def text_chunks(texts: pa.Array, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes together (one text at least)."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start, done = 0, 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, done + most, "right")))
        yield start, end
        start, done = end, int(sizes[end - 1])


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def shipped(spark) -> None:
    """Send this package along once a session, unless the workers find it by themselves.

    They do where it stands on PYTHONPATH, in the working folder or in an archive given to Spark.
    """
    import workfold

    root = os.path.dirname(os.path.dirname(os.path.abspath(workfold.__file__)))
    found = [os.path.abspath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p]
    if root in found or not os.path.isdir(root) or spark.conf.get("workfold.llm.shipped", None):
        return
    spark.conf.set("workfold.llm.shipped", "true")
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "workfold-llm"), "zip", root, "workfold"))


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
