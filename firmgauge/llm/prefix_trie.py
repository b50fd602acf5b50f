"""Prefix trie of conversations, from digests of fixed-length blocks of turns.

A node is a distinct sequence of first turns. Its key is the sum of one 128-bit hash per turn, made of
the turn's SHA-256 digest and its place; the four 32-bit lanes of the hash are added apart, in
longs. So the key of a prefix is a running sum and no conversation has to be read in one piece. Turns
are first put into blocks of ``BLOCK``. Conversations with the same key before a block and the
same block form one group. Where all that pass a key go on with one and the same block, its turns
are nodes with the members of the group. Only where several blocks follow one key are their turns
told apart, once for every distinct block and not for every conversation.

Sums over subtrees need no walk over the tree. The smallest member of a node owns it. What a
conversation owns is the end of its path; its weight and leaf count for the nodes it owns by a
running sum from the end, and for the nodes before them by one grouped sum.

Running sums are taken in range partitions and the totals of earlier partitions are added
(``running``), so a conversation with very many turns is spread over tasks. The ids of the members that end at
a node are made into pieces of text in range partitions; one digest then reads the pieces one by one.

Rows without ``conv_id`` belong to no conversation. Turns of equal number are ordered by their
digest, so equal rows are two equal turns. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from firmgauge.llm.common import stored

BLOCK = 8
LANES = ("k0", "k1", "k2", "k3")
#: Ids in a piece of text; it changes the plan only.
PIECE = 50_000


# --- helpers --------------------------------------------------------------------------------
def running(df: DataFrame, key: Sequence[str], order: Sequence[Column], sums: Sequence[str], label: str) -> DataFrame:
    """``df`` with each of ``sums`` replaced by its running sum over the rows of ``key`` in ``order``."""
    key = list(key)
    parts = stored(df.repartitionByRange(*key, *order).withColumn("_part", F.spark_partition_id()), label)
    inside = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part", *key).agg(*(F.sum(s).alias(s) for s in sums)).select(
        "_part", *key, *(F.sum(s).over(earlier).alias(f"_{s}") for s in sums))
    totals = totals.where(F.col(f"_{sums[0]}").isNotNull())  # only keys that go on in a further part
    summed = parts.withColumns({s: F.sum(s).over(inside) for s in sums}).join(totals, ["_part", *key], "left")
    kept = {s: F.col(s) + F.coalesce(f"_{s}", F.lit(0)) for s in sums}
    return summed.withColumns(kept).select(*df.columns)


def _lanes(said: str, pos: str) -> list[Column]:
    """Four 32-bit parts of the hash of a turn at its place."""
    halves = [F.xxhash64(F.lit(seed), said, pos) for seed in (11, 23)]
    return [part.alias(name) for name, part in zip(LANES, (
        p for h in halves for p in (h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32))))]


# --- conversations --------------------------------------------------------------------------
def numbered(conversations: DataFrame) -> DataFrame:
    """(conv, idx, said, chars): turns with their number from 0, as digests of role and text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.sha2(F.concat(F.char_length(role), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").alias("conv"), "turn", said.alias("said"), F.char_length(text).cast("long").alias("chars"), F.lit(1).alias("idx"))
    counted = running(turns, ["conv"], [F.col("turn").asc_nulls_first(), F.col("said")], ["idx"], "turns")
    return counted.select("conv", (F.col("idx") - 1).cast("int").alias("idx"), "said", "chars")


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): each conversation with the first turns of the first one of its hundred.

    Conversation c takes the first ``crc32(c) % most`` turns of conversation ``c - c % every`` in the
    place of as many of its own.
    """
    h = lambda c: (F.crc32(F.col(c).cast("string").cast("binary")) % most).cast("int")
    heads = turns.where((F.col("idx") < most) & (F.col("conv") % every == 0)).select(
        F.col("conv").alias("base"), "idx", "said", "chars")
    found = heads.groupBy("base").agg(F.count(F.lit(1)).cast("int").alias("n_base"))
    convs = turns.select("conv").distinct().withColumn("base", F.col("conv") - F.col("conv") % every).join(
        found, "base", "left").select("conv", "base", h("conv").alias("h"), F.coalesce("n_base", F.lit(0)).alias("n_base"))
    convs = stored(convs, "convs")
    taken = convs.join(heads, "base").where("idx < h").select("conv", F.col("idx").alias("pos"), "said", "chars")
    own = turns.where(F.col("idx") >= h("conv")).join(convs, "conv").select(
        "conv", (F.col("idx") - F.col("h") + F.least("h", "n_base")).alias("pos"), "said", "chars")
    return convs.select("conv"), taken.unionByName(own)


# --- nodes ----------------------------------------------------------------------------------
def blocks(turns: DataFrame, length: int = BLOCK) -> DataFrame:
    """(conv, b, n_turns, k0.., turns): blocks of turns; ``k`` is the key of the prefix with the block.

    Each of ``turns`` is a struct of its place from 1 (``depth``), the key of the prefix that ends with
    it, its own lanes ``l0..`` and its code points.
    """
    hashed = turns.select("conv", "pos", "chars", *_lanes("said", "pos"))
    grouped = hashed.groupBy("conv", F.floor(F.col("pos") / length).cast("int").alias("b")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("pos") + 1).alias("depth"), "chars", *LANES))).alias("items"),
        *(F.sum(k).alias(f"own_{k}") for k in LANES), *(F.sum(k).alias(k) for k in LANES))
    keyed = running(grouped, ["conv"], [F.col("b")], LANES, "blocks")
    before = {k: F.col(k) - F.col(f"own_{k}") for k in LANES}

    def upto(i: Column, k: str) -> Column:
        return F.aggregate(F.slice("items", F.lit(1), i + 1), F.lit(0).cast("long"), lambda total, y: total + y[k])

    def item(x: Column, i: Column) -> Column:
        keys = [(before[k] + upto(i, k)).alias(k) for k in LANES]
        return F.struct(x["depth"].alias("depth"), x["chars"].alias("chars"), *keys, *(x[k].alias(f"l{k[1:]}") for k in LANES))

    return keyed.select("conv", "b", F.size("items").alias("n_turns"), *LANES, *(before[k].alias(f"p{k[1:]}") for k in LANES),
                        F.transform("items", item).alias("turns"))


def nodes_of(blocks: DataFrame) -> DataFrame:
    """(depth, k0.., l0.., chars, n_convs, conv_id): the nodes below the root."""
    start = [f"p{k[1:]}" for k in LANES]
    groups = stored(blocks.groupBy("b", *start, *LANES, "n_turns").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.first("turns").alias("turns")), "groups")
    follow = groups.groupBy("b", *start).agg(F.count(F.lit(1)).alias("ways")).where("ways > 1").select("b", *start)
    told = lambda df: df.select(F.explode("turns").alias("t"), "n_convs", "conv_id").select(
        "t.depth", *(f"t.{k}" for k in LANES), *(f"t.l{k[1:]}" for k in LANES), "t.chars", "n_convs", "conv_id")
    alone = told(groups.join(follow, ["b", *start], "left_anti"))
    apart = told(groups.join(follow, ["b", *start], "left_semi")).groupBy("depth", *LANES).agg(
        *(F.first(f"l{k[1:]}").alias(f"l{k[1:]}") for k in LANES), F.first("chars").alias("chars"),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return alone.unionByName(apart)


# --- members that end at a node ---------------------------------------------------------------
def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv) rows as (key, first, ids): ids of one node joined by commas."""
    for batch in batches:
        lanes = [batch.column(i).to_numpy() for i in range(len(LANES))]
        conv = batch.column(len(LANES)).to_numpy()
        new = np.zeros(len(conv), bool)
        for lane in lanes:
            new[1:] |= lane[1:] != lane[:-1]
        starts = np.flatnonzero(new | (np.arange(len(conv)) % PIECE == 0))
        ends = [*starts[1:], len(conv)]
        ids = [",".join(map(str, conv[s:e].tolist())) for s, e in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays([*(pa.array(lane[starts]) for lane in lanes), pa.array(conv[starts]), pa.array(ids, pa.string())],
                                         names=[*LANES, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as (key, ends_sha256); a digest goes on over batches."""
    names = [*LANES, "ends_sha256"]
    make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*(r[0] for r in rows))] + [
        pa.array([r[1] for r in rows], pa.string())], names=names)
    last, digest = None, None
    for batch in batches:
        done = []
        for *key, first, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key != last:
                if last is not None:
                    done.append((last, digest.hexdigest()))
                last, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if done:
            yield make(done)
    if last is not None:
        yield make([(last, digest.hexdigest())])


def ends(convs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(k0.., ends_sha256): per node at which conversations end, the digest of their ids."""
    last = blocks.groupBy("conv").agg(F.max(F.struct("b", *LANES)).alias("end"))
    at = convs.join(last, "conv", "left").select(*(F.coalesce(f"end.{k}", F.lit(0)).alias(k) for k in LANES), "conv")
    kind = convs.schema["conv"].dataType.simpleString()
    keys = ", ".join(f"{k} long" for k in LANES)
    pieces = at.repartitionByRange(*LANES, "conv").sortWithinPartitions(*LANES, "conv").mapInArrow(
        _pieces, f"{keys}, first {kind}, ids string")
    return pieces.repartition(*LANES).sortWithinPartitions(*LANES, "first").mapInArrow(_digests, f"{keys}, ends_sha256 string")


# --- the trie -------------------------------------------------------------------------------
def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, with sums over its subtree.

    ``conv_id`` is the smallest member, ``parent_conv_id`` that of the parent, ``saved_tokens`` the sum
    over the subtree of (members - 1) times the code points of the last text, ``ends_sha256`` the
    digest of the ids of the members that end there.
    """
    turns = stored(numbered(conversations), "numbered")
    convs, all_turns = rebuilt(turns)
    path = stored(blocks(all_turns), "path")
    below = nodes_of(path)
    lanes = [f"l{k[1:]}" for k in LANES]
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0").select(
        F.lit(0).alias("depth"), *(F.lit(0).cast("long").alias(k) for k in [*LANES, *lanes]), F.lit(0).cast("long").alias("chars"), "n_convs", "conv_id")
    nodes = stored(root.unionByName(below), "nodes")

    up = [(F.col(k) - F.col(f"l{k[1:]}")).alias(k) for k in LANES]
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *up).agg(F.count(F.lit(1)).alias("n_children"))
    weight = (F.col("n_convs") - 1) * F.col("chars")
    known = stored(nodes.join(children, ["depth", *LANES], "left").select(
        *nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), weight.alias("weight")), "known")

    owners = stored(known.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("depth").alias("since"), F.sum("weight").alias("owned"),
        F.max(F.struct("depth", (F.col("n_children") == 0).cast("long").alias("leaf"))).alias("last")).select(
        "conv", "since", "owned", F.col("last.leaf").alias("leaf")), "owners")
    # What conversations own adds to all nodes of their paths before it ...
    passed = path.join(owners, "conv").where(F.col("turns")[0]["depth"] < F.col("since")).select(
        "since", "owned", "leaf", F.explode("turns").alias("t")).where("t.depth < since").groupBy(
        "t.depth", *(F.col(f"t.{k}").alias(k) for k in LANES)).agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("leaves"))
    whole = owners.where("since > 0").agg(F.lit(0).alias("depth"), *(F.lit(0).cast("long").alias(k) for k in LANES),
                                          F.sum("owned").alias("owned"), F.sum("leaf").alias("leaves"))
    # ... and to the nodes they own from the end.
    tail = running(known.where("n_convs > 1").select("conv_id", "depth", *LANES, "weight"), ["conv_id"], [F.col("depth").desc()], ["weight"], "tails")
    tail = tail.select("depth", *LANES, F.col("weight").alias("own_saved"))
    summed = known.join(tail, ["depth", *LANES], "left").join(passed.unionByName(whole), ["depth", *LANES], "left").join(
        owners.select(F.col("conv").alias("conv_id"), F.col("leaf")), "conv_id")
    zero = F.lit(0)
    summed = summed.join(ends(convs, path), list(LANES), "left")
    above = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(k).alias(f"u{k[1:]}") for k in LANES), F.col("conv_id").alias("parent_conv_id"))
    keyed = summed.withColumns({f"u{k[1:]}": F.col(k) - F.col(f"l{k[1:]}") for k in LANES}).join(
        above, ["depth", *(f"u{k[1:]}" for k in LANES)], "left")
    return keyed.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        (F.col("leaf") + F.coalesce("leaves", zero)).alias("n_leaves"),
        (F.coalesce("own_saved", zero) + F.coalesce("owned", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
