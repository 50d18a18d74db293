"""Graphs of near copies: connected components, and comparing the members of a group in blocks.

Groups may be large, so no task holds one: members are dealt into blocks, every two blocks meet in one
run of rows, and a run gives back counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workfold.llm.common import runs
from workfold.session import fresh_path

BLOCK = 256
# A bucket of more than WHOLE members is dealt into parts of about PART, of which every two meet.
WHOLE, PART = 4096, 2048


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, with the path."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark, path: str) -> None:
    """Remove what ``written`` wrote, once nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _is_done(edges: DataFrame) -> bool:
    """Whether the edges (u, v) are separate stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of the edges (a, b): root is the least id reachable.

    Alternating large and small stars: the edges of every node are moved to its least neighbour. A hub's
    neighbours are aggregated with partial minima and joined, which Spark may split, never gathered. A
    round is written to the shared folder; the driver learns whether separate stars are left, which ends
    the rounds.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while not _is_done(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.inline(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        after, new_path = written(small.where("u <> v").distinct(), "stars")
        discard(spark, path)
        now, path = after, new_path
    roots = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of n members; ``near(i, others)`` tells which of them i is linked with.

    Members that are reached are not asked about again, so a tight group costs one pass.
    """
    rest, left, right = np.arange(n), [], []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            reached = rest[hit].tolist()
            left += [i] * len(reached)
            right += reached
            queue += reached
            rest = rest[~hit]
    return left, right


def deal_into_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root, n_blocks, block) from (id, root): groups of more than ``block`` members are dealt out."""
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    n = F.ceil(F.col("size") / block).cast("int")
    return members.join(sizes, "root").select(F.col("id").alias("node"), "root", n.alias("n_blocks"),
                                              F.pmod(F.xxhash64("id"), n).cast("int").alias("block"))


def deal_large(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Rows of the buckets ``keys``, sorted by ``keys``, _i, _j and ``member``: a run of these is what meets.

    A bucket of at most ``WHOLE`` rows is one run. The parts of a larger one meet two by two, each two in a
    run of its own, so all its pairs meet and no task holds it.
    """
    large, _ = written(rows.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias("_n"), F.count("*").alias("_size")).where(
        F.col("_size") > WHOLE).drop("_size"), "large")
    n, part = F.coalesce("_n", F.lit(1)), F.col("_part")
    parted = rows.join(large, keys, "left").withColumn("_part", F.pmod(F.xxhash64(member), n).cast("int"))
    others = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (n == 1) | (j != part))
    pairs = F.transform(others, lambda j: F.struct(F.least(part, j).alias("i"), F.greatest(part, j).alias("j")))
    dealt = parted.withColumn("_p", F.explode(pairs)).withColumns({"_i": F.col("_p.i"), "_j": F.col("_p.j")}).drop("_p", "_n", "_part")
    return dealt.repartition(*keys, "_i", "_j").sortWithinPartitions(*keys, "_i", "_j", member)


def compare_in_blocks(rows: DataFrame, linked: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """Compare all members of each group, every two blocks once.

    ``rows`` has node, root, n_blocks, block and what ``linked`` needs; ``linked(table)`` gives the
    symmetric boolean matrix of the links among the table's rows. Returns (a, b, n): rows with ``b``
    NULL hold the number of links ``n`` of node ``a`` in one run, others a spanning edge. A column
    ``weight`` tells for how many a member counts, otherwise each counts once.
    """
    pairs = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    keyed = rows.withColumn("_p", F.explode(pairs)).withColumns({"_i": F.col("_p.i"), "_j": F.col("_p.j")}).drop("_p", "n_blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), table in runs(batches, ["root", "_i", "_j"], least=2):
            node = table["node"].to_numpy()
            if (node[1:] == node[:-1]).any():  # repeated rows of a member
                table = table.filter(pa.array(np.append(True, node[1:] != node[:-1])))
                node = table["node"].to_numpy()
            block = table["block"].to_numpy()
            link = linked(table)
            np.fill_diagonal(link, False)
            if i != j:
                link &= block[:, None] != block[None, :]
            counts = link @ table["weight"].to_numpy() if "weight" in table.column_names else link.sum(1)
            left, right = forest(len(node), lambda x, rest: link[x, rest])
            has = np.flatnonzero(counts)
            if len(has):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([node[has], node[left]])), pa.array([None] * len(has) + node[right].tolist(), pa.int64()),
                    pa.array(np.concatenate([counts[has], np.zeros(len(left), np.int64)]))], ["a", "b", "n"])

    dealt = keyed.repartition("root", "_i", "_j").sortWithinPartitions("root", "_i", "_j", "node")
    return dealt.mapInArrow(compare, "a long, b long, n long")


def same_sets(sets: list[np.ndarray], threshold: float, columns: int = 1 << 14) -> np.ndarray:
    """Which of the sets of numbers have a Jaccard similarity of at least ``threshold``."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[at] > 1
    at, owner = at[shared], owner[shared]
    _, at = np.unique(at, return_inverse=True)
    common = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        a, b = np.searchsorted(at, [low, low + columns])
        held = np.zeros((len(sets), min(columns, int(at[-1]) + 1 - low)), np.float32)
        held[owner[a:b], at[a:b] - low] = 1
        common += held @ held.T
    whole = sizes[:, None] + sizes[None, :] - common
    return np.divide(common, whole, out=np.zeros_like(common), where=whole > 0) >= threshold
