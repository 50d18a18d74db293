"""Packing by powers of two: documents are cut into pieces of binary lengths, equal lengths share a bucket.

A document of n ids becomes n // most pieces of the greatest length and one piece for each bit of the
rest, longest first. Every piece is a sequence of its own, so no sequence crosses documents and none
needs padding: a batch is drawn from one bucket, where all sequences have one length.

Defined results: NULL or empty texts hold the end id alone; NULL ids stay NULL; repeated ids are kept,
each row as its own document; an empty table gives no rows; other columns are ignored. Sequence ids count from 0: buckets from short
to long, inside a bucket in the order the pieces were written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from workfold.llm.common import id_back, id_key, shipped, text_chunks, text_of, word_ids
from workfold.plans.pin import pin
from workfold.plans.short import rule_table

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, part int, nth long, ids binary"


def binary_lengths(n: int, most: int) -> list[int]:
    """The pieces of ``n`` ids: the greatest length as often as it fits, then the bits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cutter(vocabulary: str, end_id: int, most: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        words = word_ids(vocabulary)
        seen = [0] * most.bit_length()
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch["id"].to_pylist(), batch["text"]
            for a, b in text_chunks(texts):
                cols: list[list] = [[] for _ in range(9)]
                flat, counts = words.encode(texts[a:b])
                flat, at = flat.to_pybytes(), 0
                for key, n in zip(keys[a:b], counts.tolist()):
                    own = flat[at:at + 4 * n] + end
                    at += 4 * n
                    start = 0
                    for length in binary_lengths(n + 1, most):
                        piece = own[4 * start:4 * (start + length)]
                        bucket = length.bit_length() - 1
                        for c, v in zip(cols, (key, start, length, zlib.crc32(piece), n + 1, bucket, part, seen[bucket], piece)):
                            c.append(v)
                        seen[bucket] += 1
                        start += length
                types = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [p.split()[0] for p in PIECES.split(", ")])

    return cut


def pack_power_of_two(docs: DataFrame, vocabulary: str, end_id: int = 2, most: int = 4096, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ``ids`` are little-endian unsigned 32-bit numbers. The pieces are written once; numbering them takes
    one row per bucket and task, summed forward and broadcast while they are few.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the greatest length has to be a power of two")
    shipped(docs.sparkSession)
    rows = docs.select(id_key(id_col).alias("id"), text_of(text_col).alias("text"))
    pieces = pin(rows.mapInArrow(_cutter(vocabulary, end_id, most), PIECES), "pieces")
    counts = pieces.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    # Without its hint Spark shuffles the pieces, ids and all, before it sees how few rows these are.
    bases = rule_table(pin(counts.select("bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases"))
    return pieces.join(bases, ["bucket", "part"]).select(
        id_back(F.col("id")).alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
