"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A filter is a direction: the concatenation of one codeword for each block of the rotated space. A vector
belongs to all filters whose inner product with it reaches a threshold, which list decoding finds without
trying them: codewords of the first block that no codeword of the second can lift over the threshold are
dropped, the others are paired. The threshold is that of random vectors, lowered for a vector that would
lie in too few filters (its own list is then as long as asked for). Vectors that share a filter meet; a short code of each decides, within its
known error, whether the pair may reach the wanted cosine; groups that hang together that way are then
compared exactly in double precision, in blocks.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows with a
NULL label, link with nothing and stand alone; vectors of different lengths never link; rows equal in id,
label and vector are one vector; a NULL id comes before all others and stays NULL; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workfold.llm.common import id_back, id_key, runs, shipped
from workfold.llm.links import compare_in_blocks, components, deal_into_blocks, deal_large, forest
from workfold.plans.pin import pin


@dataclass(frozen=True)
class Caps:
    """``listed`` filters are expected per random vector, ``least`` is the shortest list of any; there are
    directions ** 2 filters, which should grow with the number of vectors."""

    cosine: float = 0.98
    directions: int = 512
    listed: float = 16.0
    least: int = 24
    seed: int = 17


BLOCKS = 2


@cache
def product_code(dim: int, directions: int, seed: int) -> np.ndarray:
    """Codewords as (block, direction, dim) in the unrotated space; one of each block add up to a unit vector."""
    random = np.random.RandomState(seed + dim)
    rotation, _ = np.linalg.qr(random.standard_normal((dim, dim)))
    out = np.zeros((BLOCKS, directions, dim))
    for b, rows in enumerate(np.array_split(np.arange(dim), BLOCKS)):
        if len(rows):
            words = random.standard_normal((directions, len(rows)))
            words *= np.sqrt(len(rows) / dim) / np.linalg.norm(words, axis=1, keepdims=True)
            out[b] = words @ rotation[rows]
    return out


def list_decode(unit: np.ndarray, p: Caps) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of every filter a unit vector lies in."""
    dim, m = unit.shape[1], p.directions
    code = product_code(dim, m, p.seed)
    limit = NormalDist().inv_cdf(1 - min(0.5, p.listed / m ** BLOCKS)) / np.sqrt(dim)
    least = min(p.least, m)
    rows, filters = [], []
    for low in range(0, len(unit), 256):
        first, second = (unit[low:low + 256] @ code[b].T for b in range(BLOCKS))
        # The best sums of any pair are among the best of either block.
        tops = [-np.partition(-v, least - 1, axis=1)[:, :least] for v in (first, second)]
        sums = (tops[0][:, :, None] + tops[1][:, None, :]).reshape(len(first), -1)
        own = np.minimum(limit, -np.partition(-sums, least - 1, axis=1)[:, least - 1])
        r, a = np.nonzero(first + second.max(1)[:, None] >= own[:, None])
        k, b = np.nonzero(second[r] + first[r, a][:, None] >= own[r][:, None])
        rows.append(r[k] + low)
        filters.append(a[k] * m + b)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(filters)


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """The vectors of a list column; None for those that cannot link."""
    out: list[np.ndarray | None] = []
    values = column.values
    flat, gone = values.to_numpy(zero_copy_only=False).astype(np.float64), values.is_null().to_numpy(zero_copy_only=False)
    at, null = column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        a, b = at[i], at[i + 1]
        v = flat[a:b]
        usable = not null[i] and b > a and not gone[a:b].any() and np.isfinite(v).all()
        norm = np.linalg.norm(v) if usable else 0.0
        out.append(v if usable and 0 < norm < np.inf else None)
    return out


FILTERED = "label long, dim int, node long, code binary, scale double, error double, buckets array<int>"


def _filterer(p: Caps):
    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch["embedding"])
            label, node = batch["label"].to_numpy(zero_copy_only=False), batch["node"].to_numpy()
            for dim in sorted({len(v) for v in vectors if v is not None}):
                own = np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == dim])
                whole = np.stack([vectors[i] for i in own])
                for low in range(0, len(own), 2048):
                    part = own[low:low + 2048]
                    unit = whole[low:low + 2048] / np.linalg.norm(whole[low:low + 2048], axis=1, keepdims=True)
                    scale = np.abs(unit).max(1) / 127
                    short = np.rint(unit / scale[:, None]).astype(np.int8)
                    error = np.linalg.norm(short * scale[:, None] - unit, axis=1)
                    rows, filters = list_decode(unit, p)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(label[part].astype(np.int64)), pa.array(np.full(len(part), dim, np.int32)), pa.array(node[part]),
                        pa.array([c.tobytes() for c in short], pa.binary()), pa.array(scale), pa.array(error),
                        pa.ListArray.from_arrays(np.searchsorted(rows, np.arange(len(part) + 1)).astype(np.int32), filters.astype(np.int32))],
                        [f.split()[0] for f in FILTERED.split(", ")])

    return filtered


def _meeting(p: Caps):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for _, table in runs(batches, ["label", "dim", "bucket", "_i", "_j"], least=2):
            node, s, e = (table[c].to_numpy() for c in ("node", "scale", "error"))
            c = np.frombuffer(b"".join(table["code"].to_pylist()), np.int8).reshape(len(node), -1).astype(np.float32)
            i, j = forest(len(node), _nearness(c, s, e, p.cosine))
            left += node[i].tolist()
            right += node[j].tolist()
            if len(left) > 10000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return meet


def _nearness(c: np.ndarray, s: np.ndarray, e: np.ndarray, cosine: float, few: int = 64):
    """Whether codes leave the cosine possible; after ``few`` questions the run hangs together loosely and all pairs are told at once."""
    asked, link = 0, None

    def near(x, rest):
        nonlocal asked, link
        asked += 1
        if asked <= few:
            return (c[rest] @ c[x]) * s[rest] * s[x] >= cosine - (e[x] + e[rest] + e[x] * e[rest] + 1e-5)
        if link is None:
            link = np.empty((len(c), len(c)), bool)
            for low in range(0, len(c), 256):
                t = slice(low, low + 256)
                link[t] = (c[t] @ c.T) * s * s[t, None] >= cosine - (e[t, None] + e + e[t, None] * e + 1e-5)
        return link[x, rest]

    return near


def cap_components(vectors: DataFrame, params: Caps = Caps(), id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label") -> DataFrame:
    """One row per input row: (vec_id, n_links, component_id, kept).

    ``n_links`` counts the other vectors of the same label with at least the wanted cosine;
    ``component_id`` is the least id reachable by links, itself included; ``kept`` marks that one.
    """
    shipped(vectors.sparkSession)
    rows = vectors.select(id_key(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("long").alias("label"))
    rows = rows.select(F.xxhash64("label", "embedding").alias("node"), "id", "label", "embedding")
    may_link = rows.where("label IS NOT NULL AND embedding IS NOT NULL")
    # Equal vectors of a label are one class, compared once for all its copies.
    classes = may_link.select("node", "label", "embedding").dropDuplicates(["node"])
    copies = may_link.select("node", "id").distinct().groupBy("node").agg(F.count("*").alias("weight"), F.min("id").alias("own"))
    decoded = pin(classes.mapInArrow(_filterer(params), FILTERED), "cap-filters")
    hung = decoded.withColumn("bucket", F.explode("buckets")).drop("buckets")
    coarse = deal_large(hung, ["label", "dim", "bucket"], "node").mapInArrow(_meeting(params), "a long, b long").where("a <> b")
    dealt = deal_into_blocks(components(coarse))
    copies = pin(copies.join(decoded.select("node"), "node"), "cap-copies")
    full = classes.select("node", "embedding").join(dealt, "node").join(copies.select("node", "weight"), "node")

    def linked(table: pa.Table) -> np.ndarray:
        v = np.stack(_vectors(table["embedding"].combine_chunks()))
        norm = np.linalg.norm(v, axis=1)
        return (v @ v.T) / (norm[:, None] * norm[None, :]) >= params.cosine

    found = pin(compare_in_blocks(full, linked), "cap-links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "node")
    ids = rows.select("node", "id")
    firsts = roots.join(copies, "node").groupBy("root").agg(F.min("own").alias("first"))
    linked_to = links.join(roots, "node").join(firsts, "root").select("node", "n_links", "first")
    per_node = copies.join(linked_to, "node", "left").select(
        "node", (F.col("weight") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("first", "own").alias("first"))
    out = ids.join(per_node, "node", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "id").alias("first"))
    return out.select(id_back(F.col("id")).alias("vec_id"), "n_links", id_back(F.col("first")).alias("component_id"), (F.col("id") == F.col("first")).alias("kept"))
