"""N-gram Jaccard join by prefixes of min-hashes, as deep as the target recall allows.

Texts are sets of word n-grams (lower case, split at white space; a text of fewer words is one n-gram).
Equal sets are one class, which is compared once for all its copies. Every class has a signature of
min-hashes dealt into trees. The prefixes that meet in a tree have one depth, worked out from the parameters:
the greatest at which the chance to meet in some tree reaches the target recall for pairs at the threshold.
No depth is adapted to the candidates found, as a forest of prefix tries would. Classes that share a prefix and whose sketches leave the
threshold possible are joined into coarse groups; the groups are compared exactly, in blocks.

Defined results: NULL and blank texts have no n-grams, are one class and link with nothing; NULL ids
come first and stay NULL; rows equal in id and text get the same values; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workfold.llm.common import id_back, id_key, mixed, runs, shipped, text_chunks, text_of
from workfold.llm.links import compare_in_blocks, components, deal_into_blocks, deal_large, forest, same_sets
from workfold.plans.pin import pin


@dataclass(frozen=True)
class Forest:
    """The join's parameters; ``slack`` is how far below the threshold a sketch may estimate."""

    ngram: int = 5
    threshold: float = 0.8
    trees: int = 20
    deepest: int = 8
    recall: float = 0.9995
    slack: float = 0.22

    @property
    def depth(self) -> int:
        """The longest prefix whose recall at the threshold is at least the target."""
        for d in range(self.deepest, 1, -1):
            if 1 - (1 - self.threshold ** d) ** self.trees >= self.recall:
                return d
        return 1


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, each distinct one hashed once; nothing is kept for later batches."""
    of = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in set(words)}
    return np.fromiter(map(of.__getitem__, words), np.uint64, len(words))


def ngram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    words = [t.lower().split() for t in texts]
    flat = word_hashes([w for ws in words for w in ws])
    out, at = [], 0
    for ws in words:
        own = flat[at:at + len(ws)]
        at += len(ws)
        if not len(own):
            out.append(own)
            continue
        k = min(n, len(own))
        grams = np.full(len(own) - k + 1, k, np.uint64)
        for i in range(k):
            grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) + own[i:len(own) - k + 1 + i])
        out.append(np.unique(grams))
    return out


def signatures(sets: list[np.ndarray], n_hashes: int) -> np.ndarray:
    """Min-hashes, one row per set; no set may be empty."""
    numbers = np.random.RandomState(11).randint(0, 1 << 32, size=(2, n_hashes), dtype=np.uint64).astype(np.uint32)
    flat = np.concatenate(sets)
    low = (flat >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), n_hashes), np.uint32)
    for j in range(n_hashes):
        out[:, j] = np.minimum.reduceat(low * (numbers[0, j] | np.uint32(1)) + numbers[1, j], starts)
    return out


def _node(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signer(p: Forest):
    depth, n_hashes = p.depth, p.trees * p.depth
    tree = mixed(np.arange(1, p.trees + 1, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks, texts = batch["id"], batch["mark"], batch["text"]
            for a, b in text_chunks(texts, 1 << 20):
                sets = ngram_sets(texts[a:b].to_pylist(), p.ngram)
                full = [i for i, s in enumerate(sets) if len(s)]
                prefixes: list = [[] for _ in sets]
                sketches: list = [b""] * len(sets)
                if full:
                    sig = signatures([sets[i] for i in full], n_hashes)
                    buckets = np.repeat(tree[None, :], len(full), 0)
                    for d in range(depth):
                        buckets = mixed(buckets * np.uint64(0x9E3779B97F4A7C15) + sig[:, d::depth])
                    small = mixed(sig.astype(np.uint64)).astype(np.uint8) & np.uint8(15)
                    small = np.pad(small, ((0, 0), (0, n_hashes % 2)))
                    packed = small[:, 0::2] | (small[:, 1::2] << np.uint8(4))
                    for i, row, sketch in zip(full, buckets.view(np.int64).tolist(), packed):
                        prefixes[i], sketches[i] = row, sketch.tobytes()
                yield pa.RecordBatch.from_arrays([
                    ids[a:b], marks[a:b], pa.array([_node(s) for s in sets], pa.int64()),
                    pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    ["id", "mark", "node", "prefixes", "sketch"])

    return sign


def _meeting(p: Forest):
    n_hashes = p.trees * p.depth
    # A sketch keeps 4 bits of a min-hash, so different ones agree once in 16.
    must = (p.threshold - p.slack) * n_hashes + (1 - p.threshold + p.slack) * n_hashes / 16

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for _, table in runs(batches, ["bucket", "_i", "_j"], least=2):
            node = table["node"].to_numpy()
            packed = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(node), -1)
            sketch = np.concatenate([packed & 15, packed >> 4], 1)
            spare = sketch.shape[1] - n_hashes
            i, j = forest(len(node), lambda x, rest: (sketch[rest] == sketch[x]).sum(1) - spare >= must)
            left += node[i].tolist()
            right += node[j].tolist()
            if len(left) > 10000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return meet


def candidates(heads: DataFrame, params: Forest) -> DataFrame:
    """Edges (a, b) of the coarse groups of (node, prefixes, sketch); all pairs of a bucket meet, however large it is."""
    hung = heads.select(F.explode("prefixes").alias("bucket"), "node", "sketch")
    return deal_large(hung, ["bucket"], "node").mapInArrow(_meeting(params), "a long, b long")


def _gram_rows(p: Forest):
    def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = ["node", "root", "n_blocks", "block"]
        for batch in batches:
            texts, nodes = batch["text"], batch["node"].to_pylist()
            for a, b in text_chunks(texts, 1 << 20):
                sets = ngram_sets(texts[a:b].to_pylist(), p.ngram)
                own = pa.RecordBatch.from_arrays([batch[c][a:b] for c in kept] + [pa.array([s.tobytes() for s in sets], pa.binary())], [*kept, "grams"])
                yield own.filter(pa.array([_node(s) == n for s, n in zip(sets, nodes[a:b])]))

    return gram_rows


def jaccard_classes(docs: DataFrame, params: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, mark, class_id, n_copies, n_links, group_id, kept).

    ``class_id`` is the least id with the same n-gram set and ``n_copies`` the size of that class;
    ``n_links`` counts the other classes linked with it; ``group_id`` is the least id reachable by links;
    ``kept`` marks one (id, text) of each group. ``mark`` is the hash of the text.
    """
    shipped(docs.sparkSession)
    rows = docs.select(id_key(id_col).alias("id"), text_of(text_col).alias("text"))
    marked = rows.select("id", F.xxhash64("text").alias("mark"), "text")
    signed = pin(marked.mapInArrow(_signer(params), "id long, mark long, node long, prefixes array<bigint>, sketch binary"), "signatures")
    classes = signed.groupBy("node").agg(F.min(F.struct("id", "mark")).alias("first"), F.count("*").alias("n_copies"))
    classes = pin(classes.select("node", F.col("first.id").alias("first_id"), F.col("first.mark").alias("first_mark"), "n_copies"), "classes")
    heads = signed.join(classes.select("node", "first_id", "first_mark"), "node").where("id = first_id AND mark = first_mark")
    heads = pin(heads.select("node", "prefixes", "sketch").dropDuplicates(["node"]), "heads")
    dealt = deal_into_blocks(components(candidates(heads, params)))
    active = dealt.join(classes, "node").select("node", "root", "n_blocks", "block", F.col("first_id").alias("id"), F.col("first_mark").alias("mark"))
    grams = marked.join(active, ["id", "mark"]).select("node", "root", "n_blocks", "block", "text").mapInArrow(
        _gram_rows(params), "node long, root long, n_blocks int, block int, grams binary")
    threshold = params.threshold
    found = pin(compare_in_blocks(grams, lambda t: same_sets([np.frombuffer(g, np.uint64) for g in t["grams"].to_pylist()], threshold)), "links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "node")
    firsts = roots.join(classes, "node").groupBy("root").agg(F.min(F.struct("first_id", "first_mark")).alias("head"))
    groups = roots.join(firsts, "root").select("node", "head")
    per_class = classes.join(links, "node", "left").join(groups, "node", "left").select(
        "node", F.col("first_id").alias("class"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("head", F.struct("first_id", "first_mark")).alias("head"))
    out = signed.select("id", "mark", "node").join(per_class, "node")
    return out.select(
        id_back(F.col("id")).alias("doc_id"), "mark", id_back(F.col("class")).alias("class_id"), "n_copies", "n_links",
        id_back(F.col("head.first_id")).alias("group_id"), ((F.col("id") == F.col("head.first_id")) & (F.col("mark") == F.col("head.first_mark"))).alias("kept"))
