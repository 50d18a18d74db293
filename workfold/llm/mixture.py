"""Mixing sources to target weights: a min-cost flow from membership patterns to source quotas.

A document may belong to several sources. Documents with the same set of sources (their pattern) are one
node of a flow network: its words may be taken up to ``most`` times, and each further time costs more than
the one before (convex), so words are repeated only where fresh ones do not reach. Patterns send words to
the quotas of their sources; the cheapest greatest flow says how many words of a pattern the mix takes.
Inside a pattern every document is taken the same number of whole times, and the rest goes to documents in
the order of a seeded hash, the last of which is cut to the word.

Only patterns and sources reach the flow, never documents, and each connected part of the network is solved
by a task of its own. The order inside a pattern is a running sum over ranges (``plans.running``), so one
source may hold most rows.

Defined results: NULL texts have no words; a NULL source is a source, the last one; documents of no source
(an empty or NULL list) are never taken; empty texts take 0; rows with equal id and text have equal lots,
each is a document of its own; NULL ids are kept; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections import deque
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workfold.llm.common import shipped, text_of
from workfold.llm.links import components
from workfold.plans.pin import pin
from workfold.plans.running import BEFORE, ordinal, running

WORD = r"[^\x20\x09-\x0D]+"


class Mixture(NamedTuple):
    """``documents``: id, members, size, taken; ``sources``: source, size, target; ``flows``: pattern to source."""

    documents: DataFrame
    sources: DataFrame
    flows: DataFrame


def source_key(source: Column) -> Column:
    """A source as a key that is never NULL."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source.cast("string")))


def source_of(key: Column) -> Column:
    return F.when(key != "", F.substring(key, 2, 1 << 30))


def water_targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, size, target): sources by code point, NULL last, share the sum of all sizes by weight.

    A target stops at ``most`` times its source's size and the excess is shared anew by weight among the
    others, until none is above. A round brings the driver three sums; the stopped sources only grow.
    """
    ranked = ordinal(sources.withColumn("_last", (F.col("key") == "").cast("int")), [], ["_last", "key"], "_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = pin(ranked.select("key", "size", weight.cast("double").alias("weight")), "sources")
    ceiling = F.col("size") * F.lit(float(most))
    level, stopped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > ceiling
        got = ranked.agg(F.sum("size").alias("all"), F.sum(F.when(full, ceiling)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("free"),
                         F.count(F.when(full, 1)).alias("stopped")).first()
        if got.stopped == stopped or not got.free:
            break
        stopped = got.stopped
        level = (got["all"] - (got.held or 0.0)) / got.free
    return ranked.select("key", "size", F.when(F.col("weight") * F.lit(level) > ceiling, ceiling).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def cheapest_flow(tokens: list[int], members: list[list[int]], quotas: list[int], costs: list[int]) -> dict[tuple[int, int], int]:
    """Words each pattern sends to each source: the greatest flow, at the least cost of repetition.

    Shortest paths in the residual network, one after the other. A path ends at a source with quota left
    and begins at a pattern that can give more; it may take words back from another pattern on its way.
    """
    given = [0] * len(tokens)
    left = list(quotas)
    sent: dict[tuple[int, int], int] = {}
    of_source: list[list[int]] = [[] for _ in quotas]
    for i, own in enumerate(members):
        for j in own:
            of_source[j].append(i)

    def times(i: int) -> int:
        return given[i] // tokens[i] if tokens[i] else len(costs)

    while True:
        # Least price of each source, by the pattern that gives; along a path words move between sources at no cost.
        price: dict[int, int] = {}
        back: dict[int, tuple[int, int | None]] = {}
        offers = sorted((costs[times(i)], i) for i in range(len(tokens)) if times(i) < len(costs))
        queue: deque[int] = deque()
        for cost, i in offers:  # cheapest first, so the first price of a source is its least
            for j in members[i]:
                if j not in price:
                    price[j], back[j] = cost, (i, None)
                    queue.append(j)
            while queue:
                j = queue.popleft()
                for k in of_source[j]:
                    if sent.get((k, j), 0) > 0:
                        for other in members[k]:
                            if other not in price:
                                price[other], back[other] = price[j], (k, j)
                                queue.append(other)
        ends = [(price[j], j) for j in price if left[j] > 0]
        if not ends:
            return {k: v for k, v in sent.items() if v}
        _, end = min(ends)
        path, j, amount = [], end, left[end]
        while True:
            i, via = back[j]
            path.append((i, via, j))
            if via is None:
                amount = min(amount, tokens[i] * (times(i) + 1) - given[i])
                break
            amount = min(amount, sent[(i, via)])
            j = via
        for i, via, j in path:
            sent[(i, j)] = sent.get((i, j), 0) + amount
            if via is None:
                given[i] += amount
            else:
                sent[(i, via)] -= amount
        left[end] -= amount


def _router(costs: list[int]):
    def route(part: pd.DataFrame) -> pd.DataFrame:
        quotas, patterns = part[part["quota"].notna()], part[part["quota"].isna()]
        number = {k[0]: n for n, k in enumerate(quotas["members"])}
        members = [[number[m] for m in own] for own in patterns["members"]]
        names, keys = list(number), [list(x) for x in patterns["members"]]
        sent = cheapest_flow([int(x) for x in patterns["tokens"]], members, [int(x) for x in quotas["quota"]], costs)
        rows = [(keys[i], names[j], n) for (i, j), n in sorted(sent.items())]
        return pd.DataFrame(rows, columns=["members", "source", "words"])

    return route


def mix_sources(docs: DataFrame, sources: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7,
                id_col: str = "doc_id", text_col: str = "text") -> Mixture:
    """Take words of the documents so that each source comes to its target.

    ``sources`` is the array of a document's sources (its column ``source`` alone by default). No document
    is taken more than ``most`` times; a quota is the whole number of words below its target.
    """
    spark = docs.sparkSession
    shipped(spark)
    listed = F.array(F.col("source")) if sources is None else F.coalesce(sources, F.array())
    text = text_of(text_col)
    rows = pin(docs.select(
        F.col(id_col).cast("long").alias("id"), F.array_sort(F.array_distinct(F.transform(listed, source_key))).alias("members"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)).alias("lot")), "mix")
    patterns = pin(rows.groupBy("members").agg(F.sum("size").alias("tokens")), "patterns")
    sizes = patterns.select(F.explode("members").alias("key"), "tokens").groupBy("key").agg(F.sum("tokens").alias("size"))
    targets = pin(water_targets(sizes, weights, most), "targets")

    # Sources that some pattern holds together are solved together.
    together = patterns.where(F.size("members") > 1).select(F.col("members")[0].alias("m"), F.explode(F.slice("members", 2, 1 << 30)).alias("o"))
    parts = components(together.select(F.xxhash64("m").alias("a"), F.xxhash64("o").alias("b"))).toDF("node", "root")

    def in_parts(df: DataFrame, key: Column) -> DataFrame:
        own = df.withColumn("node", F.xxhash64(key))
        return own.join(parts, "node", "left").withColumn("part", F.coalesce("root", "node"))

    whole = F.floor("target").cast("long")
    net = in_parts(targets, F.col("key")).select("part", F.array("key").alias("members"), F.lit(0).cast("long").alias("tokens"), whole.alias("quota")).unionByName(
        in_parts(patterns.where(F.size("members") > 0), F.col("members")[0]).select("part", "members", "tokens", F.lit(None).cast("long").alias("quota")))
    costs = [n * (n + 1) // 2 for n in range(most)]
    flows = pin(net.groupBy("part").applyInPandas(_router(costs), "members array<string>, source string, words long"), "flows")

    routed = flows.groupBy("members").agg(F.sum("words").alias("words"))
    shares = patterns.join(routed, "members", "left").select("members", "tokens", F.coalesce("words", F.lit(0)).alias("words"))
    times = F.when(F.col("tokens") > 0, F.expr("words div tokens")).otherwise(F.lit(0))
    shares = shares.select("members", times.alias("times"), (F.col("words") - times * F.col("tokens")).alias("rest"))
    lots = running(rows.select("*", F.sha2(F.to_json("members"), 256).alias("_pattern"), F.monotonically_increasing_id().alias("_tie")),
                   ["_pattern"], ["lot", "_tie"], {"_before": ("sum", F.col("size"), BEFORE)})
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("_before")))
    taken = lots.join(shares, "members").select("id", "members", "size", (F.col("times") * F.col("size") + more).cast("long").alias("taken"))
    return Mixture(taken, targets.select(source_of(F.col("key")).alias("source"), "key", "size", "target"),
                   flows.select("members", source_of(F.col("source")).alias("source"), "words"))
