"""A trie of conversations: a z-fast trie over turn signatures, built in batches and spread out to depths.

A conversation is a string of turns. Its prefixes have signatures: 128-bit hashes, each made of the one
before and the next turn, so equal signatures mean equal prefixes (up to chance 2^-128 a pair). The trie is
compacted: a node has an extent, the longest prefix all its members share, and the edge above it, the
depths (p, g] below its parent's extent. The dictionary holds each node under its handle, the prefix whose
length is the two-fattest number in (p, g], the one divisible by the highest power of two.

A batch of distinct conversations finds its exit nodes by fat binary search: in (l, r] it looks up the
prefix of two-fattest length, and goes on right of that node's extent if it is a prefix, else left of the
handle. That takes as many joins with the dictionary as the greatest depth has bits. One more join, by the
first signature of the edge, gives the exit node, and the signatures on its edge the depth where the
conversation leaves. Edges are cut at these depths; what is left of the conversations below is compacted
by counting which prefixes go on in two ways or end; then the next batch comes.

At last each conversation adds to the nodes above its own, which are few, since edges to leaves are left
out, and the edges are spread out to a row for each depth.

Defined results: NULL roles and texts are empty; turns are ordered by number (NULL first), then role and
text, repeated rows stay; rows without a conversation id belong to none; an empty table gives no rows;
other columns are ignored, whatever their names. Equal conversations are one string with a count. A
conversation is a chain of hashes, so its signatures (16 bytes a turn, without the text) pass one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from workfold.llm.common import shipped
from workfold.plans.pin import pin

WORD = r"[^\x20\x09-\x0D]+"
ROOT = bytes(16)
SHARES = (1, 3, 12)
"""Parts of the conversations in each batch: the trie grows by its own size a few times."""
CHUNK_IDS = 1 << 14
NODE = "ext binary, g int, p int, par binary, handle binary, name binary, path array<binary>, cum array<bigint>"


def numbered_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, digest, words) of every turn; digests stand for role and text, ``pos`` counts from 0."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = df.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")) - 1
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    return turns.select("conv", place.alias("pos"), digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and place become one row a conversation, with the signatures of its prefixes."""
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
    names = ["conv", "n", "sid", "sigs", "cum"]
    conv, sigs, cum, held, rows = None, [ROOT], [0], 0, []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for key, digest, words in zip(*(batch[c].to_pylist() for c in ("conv", "digest", "words"))):
            if key != conv:
                if conv is not None:
                    rows.append((conv, len(sigs) - 1, sigs[-1], sigs, cum))
                    held += len(sigs)
                if held > 100_000:
                    yield out()
                    held, rows = 0, []
                conv, sigs, cum = key, [ROOT], [0]
            if digest is not None:
                sigs.append(hashlib.blake2b(sigs[-1] + digest, digest_size=16).digest())
                cum.append(cum[-1] + words)
    if conv is not None:
        rows.append((conv, len(sigs) - 1, sigs[-1], sigs, cum))
        yield out()


def conversation_strings(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, n, sid, sigs, cum, weight) of each distinct conversation, ``conv`` its least id; and (sid, conv) of all.

    ``turns`` as ``numbered_turns`` gives them, in any numbering that keeps the order; a conversation without
    turns has a row with a NULL digest.
    """
    shipped(turns.sparkSession)
    dealt = turns.select("conv", "pos", "digest", "words").repartition("conv").sortWithinPartitions("conv", "pos")
    whole = pin(dealt.mapInArrow(_chained, "conv long, n int, sid binary, sigs array<binary>, cum array<bigint>"), "chains")
    copies = whole.groupBy("sid").agg(F.min("conv").alias("conv"), F.count("*").alias("weight"))
    return pin(whole.join(copies.select("conv", "weight"), "conv"), "strings"), whole.select("sid", "conv")


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that is divisible by the highest power of two."""
    top = F.length(F.bin(low.cast("long").bitwiseXOR(high.cast("long")))) - 1
    return high.cast("long").bitwiseAND(-F.call_function("shiftleft", F.lit(1).cast("long"), top)).cast("int")


def _sig(depth: Column) -> Column:
    return F.element_at("sigs", depth + 1)


def empty_trie(spark) -> DataFrame:
    return spark.createDataFrame([(ROOT, 0, -1, None, ROOT, ROOT, [ROOT], [0, 0])], NODE)


def locate(nodes: DataFrame, strings: DataFrame, deepest: int) -> DataFrame:
    """The strings with (e, hit, hit_g): the depth where each leaves the trie, and the edge on which it does.

    ``hit`` is NULL where a string leaves at a node and no edge goes its way.
    """
    probe = nodes.where("p >= 0").select(F.col("handle").alias("key"), F.col("ext").alias("k_ext"), F.col("g").alias("k_g"))
    found = strings.withColumns({"l": F.lit(0), "r": F.least("n", F.lit(deepest))})
    for _ in range(deepest.bit_length()):  # each round settles one more bit of the depth
        f = F.when(F.col("l") < F.col("r"), two_fattest(F.col("l"), F.col("r")))
        # A settled string asks for itself, so settled ones do not meet at one key.
        asked = found.withColumn("f", f).withColumn("key", F.coalesce(_sig(F.col("f")), F.col("sid")))
        inside = F.col("f").isNotNull() & F.col("k_g").isNotNull() & (F.col("k_g") <= F.col("n"))
        goes_on = F.when(inside, _sig(F.least("k_g", "n")) == F.col("k_ext")).otherwise(False)
        found = asked.join(probe, "key", "left").withColumns({
            "l": F.when(goes_on, F.col("k_g")).otherwise(F.col("l")),
            "r": F.when(F.col("f").isNotNull() & ~goes_on, F.col("f") - 1).when(goes_on, F.greatest("r", "k_g")).otherwise(F.col("r"))}).select(found.columns)
    edges = nodes.where("p >= 0").select(F.col("name").alias("key"), F.col("ext").alias("hit"), F.col("g").alias("hit_g"), "path")
    below = F.when(F.col("l") < F.col("n"), _sig(F.col("l") + 1))
    on_edge = found.withColumn("key", F.coalesce(below, F.unhex(F.md5(F.col("sid"))))).join(edges, "key", "left")
    # Signatures of prefixes never repeat, so those in common are the common beginning.
    shared = F.size(F.array_intersect("path", F.slice("sigs", F.col("l") + 2, F.col("n") - F.col("l"))))
    return on_edge.withColumn("e", F.when(F.col("hit").isNotNull(), F.col("l") + shared).otherwise(F.col("l"))).drop("key", "l", "r", "path")


def insert(nodes: DataFrame, strings: DataFrame) -> DataFrame:
    """The trie with one more batch of distinct strings (conv, n, sid, sigs, cum)."""
    deepest = nodes.agg(F.max("g")).first()[0]
    found = pin(locate(nodes, strings.select("conv", "n", "sid", "sigs", "cum"), deepest), "found")

    cuts = found.where("hit IS NOT NULL AND e < hit_g").groupBy("hit").agg(F.array_sort(F.collect_set("e")).alias("cuts")).withColumnRenamed("hit", "ext")
    held = nodes.join(cuts, "ext", "left")
    bounds = F.concat(F.array("p"), F.coalesce("cuts", F.array().cast("array<int>")), F.array("g"))
    pieces = F.transform(F.sequence(F.lit(1), F.size("_b") - 1), lambda i: F.struct(F.element_at("_b", i).alias("low"), F.element_at("_b", i + 1).alias("high")))
    cut = held.withColumn("_b", bounds).withColumn("_x", F.explode(pieces))
    low, high = F.col("_x.low"), F.col("_x.high")

    def at(depth: Column) -> Column:  # the signature at a depth on this edge
        return F.element_at("path", depth - F.col("p"))

    kept = cut.select(
        at(high).alias("ext"), high.alias("g"), low.alias("p"), F.when(low == F.col("p"), F.col("par")).otherwise(at(F.greatest(low, F.col("p") + 1))).alias("par"),
        F.when(F.col("p") < 0, F.col("handle")).otherwise(at(two_fattest(low, high))).alias("handle"), at(low + 1).alias("name"),
        F.slice("path", low - F.col("p") + 1, high - low).alias("path"), F.slice("cum", low - F.col("p") + 1, high - low + 1).alias("cum"))

    new = found.where("e < n")
    steps = new.select("conv", F.explode(F.sequence(F.col("e") + 1, F.col("n"))).alias("d"), "n", "sigs").select(
        "conv", "d", _sig(F.col("d")).alias("sig"), F.when(F.col("d") < F.col("n"), F.xxhash64(_sig(F.least("n", F.col("d") + 1)))).alias("child"))
    # A prefix is a node if it goes on in two ways, or if a string ends there. Its least string sets it up.
    forks = steps.groupBy("sig").agg(F.min("child").alias("a"), F.max("child").alias("b"), F.max(F.col("child").isNull()).alias("ends"), F.min("conv").alias("owner")).where("ends OR a <> b")
    marked = steps.select("conv", "d", "sig").join(forks.select("sig", "owner"), "sig").groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("d", (F.col("owner") == F.col("conv")).alias("own")))).alias("marks"))
    lows = F.concat(F.array("e"), F.transform("marks", lambda m: m.d))
    own = F.filter(F.transform("marks", lambda m, i: F.struct(F.element_at("_b", i + 1).alias("low"), m.d.alias("high"), m.own.alias("own"))), lambda m: m.own)
    fresh = new.join(marked, "conv").withColumn("_b", lows).withColumn("_x", F.explode(own))
    added = fresh.select(
        _sig(high).alias("ext"), high.alias("g"), low.alias("p"), _sig(low).alias("par"), _sig(two_fattest(low, high)).alias("handle"), _sig(low + 1).alias("name"),
        F.slice("sigs", low + 2, high - low).alias("path"), F.slice("cum", low + 1, high - low + 1).alias("cum"))
    return pin(kept.unionByName(added), "trie")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sid, conv) become (sid, conv, ids): a few thousand ids joined by commas, ``conv`` the first."""
    sid, ids = None, []
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string()))], ["sid", "conv", "ids"])

    for batch in batches:
        for key, conv in zip(batch["sid"].to_pylist(), batch["conv"].to_pylist()):
            if key != sid or len(ids) == CHUNK_IDS:
                if ids:
                    rows.append((sid, ids[0], ",".join(map(str, ids))))
                sid, ids = key, []
            ids.append(conv)
            if len(rows) >= 1000:
                yield out()
                rows = []
    if ids:
        rows.append((sid, ids[0], ",".join(map(str, ids))))
    if rows:
        yield out()


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (sid, conv, ids) become (sid, ends): the hash of all ids of a string, a chunk at a time."""
    sid, state = None, hashlib.sha256()
    done: list[tuple] = []
    for batch in batches:
        for key, ids in zip(batch["sid"].to_pylist(), batch["ids"].to_pylist()):
            if key != sid:
                if sid is not None:
                    done.append((sid, state.hexdigest()))
                sid, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.string()))], ["sid", "ends"])
            done = []
    if sid is not None:
        yield pa.RecordBatch.from_arrays([pa.array([sid], pa.binary()), pa.array([state.hexdigest()])], ["sid", "ends"])


def ends_hashes(strings: DataFrame, members: DataFrame) -> DataFrame:
    """(sid, ends): SHA-256 of the ascending ids of the conversations that are a string, joined by commas.

    The ids of many copies are sorted over ranges, so they are spread over tasks, and joined there in chunks;
    the hash itself is sequential and reads the chunks of a string one by one.
    """
    alone = strings.where("weight = 1").select("sid", F.sha2(F.col("conv").cast("string"), 256).alias("ends"))
    several = members.join(strings.where("weight > 1").select("sid"), "sid", "left_semi")
    chunks = several.repartitionByRange("sid", "conv").sortWithinPartitions("sid", "conv").mapInArrow(_joined_ids, "sid binary, conv long, ids string")
    hashed = chunks.repartition("sid").sortWithinPartitions("sid", "conv").mapInArrow(_hashed_ids, "sid binary, ends string")
    return alone.unionByName(hashed)


def prefix_nodes(strings: DataFrame, members: DataFrame, shares: tuple[int, ...] = SHARES) -> DataFrame:
    """All prefixes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``saved_tokens`` sums, over a node and those below, the words of its last turn times its members but one.
    """
    turn = F.pmod(F.xxhash64("conv"), F.lit(sum(shares)))
    nodes, low = empty_trie(strings.sparkSession), 0
    for share in shares:
        nodes = insert(nodes, strings.where((turn >= low) & (turn < low + share)))
        low += share

    kids = nodes.where("p >= 0").groupBy("par").agg(F.count("*").alias("kids")).withColumnRenamed("par", "ext")
    nodes = nodes.join(kids, "ext", "left").withColumn("kids", F.coalesce("kids", F.lit(0)))
    # Strings whose node is the root have nothing above.
    own = pin(strings.join(nodes.select(F.col("ext").alias("sid"), "p", (F.col("kids") == 0).cast("long").alias("leaf")), "sid"), "own")
    total = F.element_at("cum", -1)
    above = F.concat(F.when(F.col("p") >= 0, F.sequence(F.lit(0), F.col("p"))).otherwise(F.array().cast("array<int>")), F.array("n"))
    counted = own.withColumn("d", F.explode(above)).select(
        _sig(F.col("d")).alias("ext"), "weight", "conv", "leaf", (F.col("weight") * (total - F.element_at("cum", F.col("d") + 1))).alias("said")).groupBy("ext").agg(
        F.sum("weight").alias("n_convs"), F.min("conv").alias("first"), F.sum("leaf").alias("n_leaves"), F.sum("said").alias("said"))
    nodes = pin(nodes.join(counted, "ext"), "counted")

    # Each node is set down to the string with its least id; words of distinct prefixes are summed along those.
    tops = nodes.groupBy("first").agg(F.min("p").alias("top")).withColumnRenamed("first", "conv")
    once = own.join(tops, "conv").withColumn("d", F.explode(above)).select(
        _sig(F.col("d")).alias("ext"), (total - F.element_at("cum", F.greatest("top", "d") + 1)).alias("once")).groupBy("ext").agg(F.sum("once").alias("once"))
    parents = nodes.select(F.col("ext").alias("par"), F.col("first").alias("parent"))
    whole = nodes.join(once, "ext").join(parents, "par", "left").join(ends_hashes(strings, members).withColumnRenamed("sid", "ext"), "ext", "left")
    spread = whole.withColumn("d", F.explode(F.sequence(F.col("p") + 1, F.col("g"))))
    last = F.col("d") == F.col("g")
    here = (F.col("n_convs") - 1) * (F.element_at("cum", -1) - F.element_at("cum", F.col("d") - F.col("p")))
    return spread.select(
        F.col("first").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(F.col("d") == F.col("p") + 1, F.col("parent")).otherwise(F.col("first")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("said") - F.col("once") + here).alias("saved_tokens"), F.when(last & F.col("ends").isNotNull(), F.col("ends")).otherwise(F.sha2(F.lit(""), 256)).alias("ends_sha256"))
