"""Token ids in Simple-8b words: a selector of 4 bits and 60 bits of payload in every 64-bit word.

File format (Parquet holds the rows, so any Spark reader lists, splits and prunes them). One row is one
run of whole documents, in ascending document order within its shard:

``shard, run``       place in the order of the file; shards are in ascending order of documents
``before``           ids of the shard before this run
``doc_ids``          the documents, ``doc_lengths`` how many ids each has, the end id included
``n_ids``            ids in the run
``block_words``      where each block of 4096 ids starts in ``words`` (so blocks decode on their own)
``block_escapes``    where its escaped values start in ``escapes``
``words, escapes``   little-endian unsigned 64-bit numbers

Selectors 0 and 1 stand for 240 and 120 zeros, 2 .. 15 for 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2
and 1 values of equal width. A word of selector 15 whose payload is all ones is an escape: the value, too
large for 60 bits, is the block's next one in ``escapes``.

Defined results: NULL or empty texts hold the end id alone; NULL ids come first and stay NULL; repeated
ids are kept, each as its own document; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workfold.llm.common import id_back, id_key, ragged, shipped, text_chunks, text_of, word_ids
from workfold.plans.pin import pin
from workfold.session import broadcast_rows

BLOCK = 4096
RUN_IDS = 1 << 19
# Fixed values of the coding: how many values a selector packs, and the bits of each.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.uint64)
SIXTEEN = np.ceil(np.log2(np.arange(1 << 16) + 1)).astype(np.uint8)
LOW = np.uint64((1 << 60) - 1)
SHIFT = np.uint64(60)


def _bits(values: np.ndarray) -> np.ndarray:
    """How many bits each value takes (0 for 0)."""
    bits = np.zeros(len(values), np.uint8)
    rest = values
    for shift in (32, 16):
        if len(rest) and int(rest.max()) >> shift:
            high = rest >> np.uint64(shift)
            bits += (high != 0).astype(np.uint8) * np.uint8(shift)
            rest = np.where(high != 0, high, rest)
    return bits + SIXTEEN[rest.astype(np.uint16)]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, escapes, block_words, block_escapes) of unsigned 64-bit values.

    Each place takes the selector that packs the most of the values that follow in its block; all
    blocks are walked in step, so the loop is as long as the longest block has words.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    n_blocks = -(-n // BLOCK)
    selector = np.full(n, 15, np.uint8)
    bits = _bits(values)
    block_end = np.minimum((np.arange(n, dtype=np.int64) // BLOCK + 1) * BLOCK, n)
    top = int(bits.max()) if n else 0
    for s in range(14, -1, -1):  # from few and wide to many and narrow: narrow ones overwrite
        if s and top <= WIDTHS[s - 1]:
            continue  # all of it fits the next selector as well
        if top <= WIDTHS[s]:
            selector[:] = s
            continue
        at = np.flatnonzero(bits <= WIDTHS[s])
        if not len(at):
            break
        # A word may be filled up with zeros where its block ends.
        last = np.append(np.flatnonzero(at[1:] != at[:-1] + 1), len(at) - 1)
        run_end = np.repeat(at[last] + 1, np.diff(last, prepend=-1))
        selector[at[run_end >= np.minimum(at + int(COUNTS[s]), block_end[at])]] = s
    step = np.minimum(COUNTS[selector], block_end - np.arange(n))
    here = np.arange(n_blocks, dtype=np.int64) * BLOCK
    ends = np.minimum(here + BLOCK, n)
    walked = []
    while True:
        here = here[(live := here < ends)]
        ends = ends[live]
        if not len(here):
            break
        walked.append(here)
        here = here + step[here]
    starts = np.sort(np.concatenate(walked)) if walked else np.zeros(0, np.int64)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << SHIFT
    for s in range(2, 16):
        rows = np.flatnonzero(chosen == s)
        if not len(rows):
            continue
        first, width = starts[rows], WIDTHS[s]
        left = step[first]
        for k in range(int(COUNTS[s])):
            more = None if k < left.min() else k < left
            if more is not None and not more.any():
                break
            value = values[first + k] if more is None else np.where(more, values[np.minimum(first + k, n - 1)], np.uint64(0))
            if s == 15:
                value = np.minimum(value, LOW)
            words[rows] |= value << (np.uint64(k) * width)
    escaped = (chosen == 15) & (values[starts] >= LOW)
    escapes = values[starts[escaped]]
    edges = np.arange(n_blocks, dtype=np.int64) * BLOCK
    return words, escapes, np.searchsorted(starts, edges), np.searchsorted(starts[escaped], edges)


def decode(words: np.ndarray, escapes: np.ndarray, n: int, block_words: np.ndarray) -> np.ndarray:
    """The ``n`` values again, a vector operation for each selector and place in a word."""
    selector = (words >> SHIFT).astype(np.int64)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    # The last word of a block may hold fewer values than its selector says.
    block_words = np.asarray(block_words, np.int64)
    begins = ends - counts
    if len(block_words):
        sizes = np.minimum(BLOCK, n - np.arange(len(block_words), dtype=np.int64) * BLOCK)
        last = np.append(block_words[1:], len(words))
        spare = ends[last - 1] - begins[block_words] - sizes
        shift = np.concatenate([[0], np.cumsum(spare)[:-1]])
        begins = begins - np.repeat(shift, last - block_words)
        limit = np.repeat(np.arange(len(block_words), dtype=np.int64) * BLOCK + sizes, last - block_words)
    out = np.zeros(n, np.uint64)
    for s in range(2, 16):
        rows = np.flatnonzero(selector == s)
        if not len(rows):
            continue
        payload, begin, end = words[rows] & LOW, begins[rows], limit[rows]
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(int(COUNTS[s])):
            place = begin + k
            inside = place < end
            out[place[inside]] = (payload[inside] >> (np.uint64(k) * WIDTHS[s])) & mask
    marks = np.flatnonzero((selector == 15) & ((words & LOW) == LOW))
    out[begins[marks]] = escapes
    return out


RUN_SCHEMA = ("shard int, run long, before long, doc_ids array<bigint>, doc_lengths array<bigint>, n_ids long, "
              "block_words array<int>, block_escapes array<int>, words binary, escapes binary")
RUN_ARROW = pa.schema([("shard", pa.int32()), ("run", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())),
                       ("n_ids", pa.int64()), ("block_words", pa.list_(pa.int32())), ("block_escapes", pa.list_(pa.int32())),
                       ("words", pa.binary()), ("escapes", pa.binary())])


def _run(shard: int, run: int, before: int, docs: list[int], lengths: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
    values = np.concatenate(ids)
    words, escapes, at, at_escapes = encode(values)
    row = {"shard": shard, "run": run, "before": before, "doc_ids": docs, "doc_lengths": np.concatenate(lengths), "n_ids": len(values),
           "block_words": at, "block_escapes": at_escapes, "words": words.astype("<u8").tobytes(), "escapes": escapes.astype("<u8").tobytes()}
    return pa.RecordBatch.from_pylist([row], RUN_ARROW)


def _encoder(vocabulary: str, end_id: int):
    def encode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, run, before = TaskContext.get().partitionId(), 0, 0
        words = word_ids(vocabulary)
        docs: list[int] = []
        lengths: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            keys, texts = batch["id"].to_pylist(), batch["text"]
            for a, b in text_chunks(texts):
                flat, counts = words.encode(texts[a:b])
                whole = np.full(int(counts.sum()) + b - a, end_id, np.uint32)
                whole[ragged(np.cumsum(counts) - counts + np.arange(b - a), counts)] = np.frombuffer(flat, "<u4")
                docs += keys[a:b]
                lengths.append(counts + 1)
                ids.append(whole)
                if sum(map(len, ids)) >= RUN_IDS:
                    yield _run(shard, run, before, docs, lengths, ids)
                    before += sum(map(len, ids))
                    docs, lengths, ids, run = [], [], [], run + 1
        if docs:
            yield _run(shard, run, before, docs, lengths, ids)

    return encode_part


def write_ids(docs: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write the file to the shared folder; returns its rows as read back.

    Documents are cut into shards by ranges of their ids. A shard is written by one task, so a task
    that is run again writes the same shard.
    """
    shipped(docs.sparkSession)
    rows = docs.select(id_key(id_col).alias("id"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    # Ranges of id and text, so that one id (NULL, for one) may hold most rows.
    ordered = rows.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark").select("id", "text")
    return pin(ordered.mapInArrow(_encoder(vocabulary, end_id), RUN_SCHEMA), "token-ids")


def read_ids(file: DataFrame) -> DataFrame:
    """Every document of a file: (id, start, n_tokens, ids_crc32, ids), decoded block by block.

    ``start`` counts the ids of all documents before it: sums per shard are few rows, carried forward
    over the shards; the place inside a shard stands in the file.
    """
    per_shard = file.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = per_shard.select("shard", before.alias("before_shard"))
    # One row per task that wrote: broadcast where they are few, else joined by shard, which holds what one task wrote.
    if file.select("shard").distinct().count() <= broadcast_rows(file.sparkSession):
        shards = F.broadcast(shards)
    based = file.join(shards, "shard").withColumn("base", F.col("before_shard") + F.col("before"))
    return based.mapInArrow(_decode_part, "id long, start long, n_tokens long, ids_crc32 long, ids binary").select(
        id_back(F.col("id")).alias("id"), "start", "n_tokens", "ids_crc32", "ids")


def _decode_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch[c][i].as_py() for c in ("base", "doc_ids", "doc_lengths", "n_ids", "block_words", "words", "escapes")}
            values = decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8"), row["n_ids"], row["block_words"])
            lens = np.array(row["doc_lengths"], np.int64)
            ends = np.cumsum(lens)
            raw = values.astype("<u4").tobytes()
            parts = [raw[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lens.tolist())]
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array(row["base"] + ends - lens, pa.int64()), pa.array(lens, pa.int64()),
                pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts, pa.binary())],
                ["id", "start", "n_tokens", "ids_crc32", "ids"])
