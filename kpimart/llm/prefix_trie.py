"""Prefix trie of conversations by fixed-length block hashing.

Conversations are cut into blocks of ``BLOCK`` turns. A block's digest covers
its turns at their places, and the digests of successive blocks add up to the
digest of a prefix, so that grouping by (prefix before, block digest) finds
the trie at block boundaries, several turns a step. Only a prefix that goes on
with more than one block has its blocks refined turn by turn; below the other
prefixes the inner nodes are a chain with the members of the block.

A digest is two 64-bit hashes of every turn at its place, combined by
exclusive or: prefixes combine in any order, as a windowed or grouped
aggregate, and no task has to follow a conversation from its start. Turns are
numbered, and prefixes summed, in stretches of bounded length, so that a very
long conversation is dealt over many tasks. Texts are hashed where they are
read and never shuffled, but for turns that tie.

Subtree sums double their reach in each round (1, 2, 4, ... turns below), so
a trie of depth d takes log2(d) rounds. The ids of the conversations that end
at a node are packed in parallel, in order, and stream through one SHA-256: a
digest of one string cannot be parted, but its task holds one pack at a time.

Edge cases: turns without a conv_id belong to no conversation; null roles and
texts are empty; turns of one number (null is one) are ordered by role, then
text, and repeated ones follow each other; an empty table gives an empty
result; columns that the operator does not name are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kpimart.llm.tasks import written

#: Turns of a block; blocks of a stretch; conversation ids of a pack.
BLOCK = 4
STRETCH = 1024
PACK = 1024
#: Turns taken over from the first conversation of a hundred: fewer than this.
HEAD = 6


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role``, two hashes of role and text, and ``size`` (code
    points of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit("turn"), text, role).alias("h2"),
        F.char_length(text).cast("long").alias("size"),
    )


def _with_tie_order(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``among``: the place by text among turns of one number and role. Texts
    are read again only for those that differ there."""
    tied = turns.groupBy("conv_id", "turn", "role").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"))
    tied = written(tied.filter("lo <> hi").select("conv_id", "turn", "role"), "trie-ties")
    if tied.isEmpty():
        return turns.withColumn("among", F.lit(0))
    texts = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    texts = texts.withColumn("h1", F.xxhash64("role", "text"))

    def same(a: DataFrame, b: DataFrame, *more: str) -> Column:
        on = a["turn"].eqNullSafe(b["turn"])
        for c in ("conv_id", "role", *more):
            on = on & (a[c] == b[c])
        return on

    within = Window.partitionBy("conv_id", "turn", "role").orderBy("text")
    placed = (
        texts.join(tied, same(texts, tied), "left_semi")
        .distinct()
        .withColumn("among", F.row_number().over(within))
        .select("conv_id", "turn", "role", "h1", "among")
    )
    placed = written(placed, "trie-tie-order")
    return turns.join(placed, same(turns, placed, "h1"), "left").select(
        *(turns[c] for c in turns.columns), F.coalesce("among", F.lit(0)).alias("among")
    )


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place`` (from 0, by turn), ``h1, h2, size`` of every turn.

    The turns are dealt by ranges of (conversation, turn), so that one long
    conversation spreads over tasks; places are ranks within a range plus the
    turns in earlier ranges."""
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("among"), F.asc("h1"), F.asc("h2"), F.asc("salt")]
    turns = _with_tie_order(hashed_turns(conversations), conversations)
    # equal turns may part: any order of theirs is the same
    salted = turns.withColumn("salt", F.monotonically_increasing_id())
    ranged = salted.repartitionByRange(F.asc("conv_id"), *order).withColumn("range", F.spark_partition_id())
    ranged = written(ranged, "trie-turns")
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("conv_id", "range")
        .agg(F.count(F.lit(1)).alias("turns"))
        .select("conv_id", "range", F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("first"))
    )
    rank = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order))
    return ranged.join(starts, ["conv_id", "range"]).select(
        "conv_id", (F.col("first") + rank - 1).alias("place"), "h1", "h2", "size"
    )


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over: crc32 of its decimal id mod 6."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEAD).cast("int")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conversations, turns)``: every conversation's first turns are those
    of the first conversation of its hundred; its own follow after as many."""
    turn = F.struct("place", "h1", "h2", "size")
    heads = (
        turns.filter((F.col("place") < HEAD - 1) & (F.col("conv_id") % 100 == 0))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(turn)).alias("head"))
    )
    convs = turns.groupBy("conv_id").count().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    empty = F.array().cast(heads.schema["head"].dataType)
    head = F.slice(F.coalesce("head", empty), F.lit(1), head_turns(F.col("conv_id")))
    convs = written(convs.join(heads, "base", "left").select("conv_id", head.alias("head")), "trie-heads")
    taken = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    own = (
        turns.filter(F.col("place") >= head_turns(F.col("conv_id")))
        .join(convs.select("conv_id", F.size("head").alias("kept")), "conv_id")
        .select("conv_id", (F.col("place") - head_turns(F.col("conv_id")) + F.col("kept")).alias("place"), "h1", "h2", "size")
    )
    return convs.select("conv_id"), taken.unionByName(own)


def hashed_blocks(turns: DataFrame, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """``conv_id, block``, the prefix digest before it ``(p1, p2)``, its own
    ``(x1, x2)`` and its ``turns`` (at most ``block``), a row for each block."""
    salted = turns.select(
        "conv_id",
        "place",
        F.expr(f"place div {block}").alias("block"),
        F.xxhash64("h1", "h2", "place").alias("s1"),
        F.xxhash64("place", "h2", "h1").alias("s2"),
        "size",
    )
    blocks = salted.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("place", "s1", "s2", "size"))).alias("turns"),
        F.bit_xor("s1").alias("x1"),
        F.bit_xor("s2").alias("x2"),
    )
    blocks = written(blocks.withColumn("stretch", F.expr(f"block div {stretch}")), "trie-blocks")

    def before(column: str, keys: list[str], order: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.bit_xor(column).over(w), F.lit(0).cast("long"))

    stretches = (
        blocks.groupBy("conv_id", "stretch")
        .agg(F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"))
        .select("conv_id", "stretch", before("y1", ["conv_id"], "stretch").alias("y1"), before("y2", ["conv_id"], "stretch").alias("y2"))
    )
    within = ["conv_id", "stretch"]
    summed = blocks.join(stretches, within).select(
        "conv_id",
        "block",
        F.col("y1").bitwiseXOR(before("x1", within, "block")).alias("p1"),
        F.col("y2").bitwiseXOR(before("x2", within, "block")).alias("p2"),
        "x1",
        "x2",
        "turns",
    )
    return written(summed, "trie-prefixes")


def _turn_prefixes(p1: str, p2: str) -> Column:
    """Of a block, for each of its turns: the prefix digests up to it and up to
    the turn before, its depth and its size."""

    def upto(n: str, start: str, s: str) -> str:
        return f"aggregate(slice(turns, 1, {n}), {start}, (a, t) -> a ^ t.{s})"

    return F.expr(
        "transform(sequence(1, size(turns)), j -> struct("
        f"{upto('j', p1, 's1')} as d1, {upto('j', p2, 's2')} as d2, "
        f"{upto('j - 1', p1, 's1')} as u1, {upto('j - 1', p2, 's2')} as u2, "
        "turns[j - 1].place + 1 as depth, turns[j - 1].size as size))"
    )


def trie_nodes(convs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``d1, d2`` (digest), ``u1, u2`` (the parent's), ``depth, size`` (of the
    last turn), ``conv_id`` (smallest member), ``n_convs`` of every node."""
    key = ["p1", "p2", "block", "x1", "x2"]
    groups = blocks.groupBy(*key).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"))
    groups = written(groups, "trie-groups")
    alone = (
        groups.groupBy("p1", "p2", "block")
        .agg(F.count(F.lit(1)).alias("kids"), F.min("x1").alias("x1"), F.min("x2").alias("x2"))
        .filter("kids = 1")
        .select(*key, F.lit(True).alias("alone"))
    )
    # the turns of a group are those of its smallest member
    turns = blocks.select("conv_id", "block", "turns")
    parted = (
        groups.join(alone, key, "left")
        .join(turns, ["conv_id", "block"])
        .select("conv_id", "n_convs", F.coalesce("alone", F.lit(False)).alias("alone"), F.explode(_turn_prefixes("p1", "p2")).alias("t"))
        .select("conv_id", "n_convs", "alone", "t.*")
    )
    parted = written(parted, "trie-turn-nodes")
    digest = ["d1", "d2", "depth"]
    chains = parted.filter("alone").drop("alone")
    refined = (
        parted.filter("not alone")
        .groupBy(*digest)
        .agg(*(F.min(c).alias(c) for c in ("u1", "u2", "size", "conv_id")), F.sum("n_convs").alias("n_convs"))
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(
        "conv_id", "n_convs", zero.alias("d1"), zero.alias("d2"), zero.alias("depth"), none.alias("u1"), none.alias("u2"), zero.alias("size")
    )
    return written(chains.unionByName(refined).unionByName(root), "trie-nodes")


def _subtree_sums(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """``d1, d2, n_children, n_leaves, saved_tokens`` of every node.

    After a round of reach r a node holds the sums over its descendants less
    than r turns below; the next adds what the nodes r turns below hold. The
    node that far above another is a prefix of the other's smallest member."""
    children = nodes.filter("depth > 0").groupBy("u1", "u2").agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select(F.col("u1").alias("d1"), F.col("u2").alias("d2"), "n_children")
    state = nodes.join(children, ["d1", "d2"], "left").select(
        "d1",
        "d2",
        "u1",
        "u2",
        "conv_id",
        "depth",
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
    )
    state = written(state, "trie-sums")
    deepest = state.agg(F.max("depth")).first()[0] or 0
    prefixes = None
    reach = 1
    while reach <= deepest:
        below = state.filter(F.col("depth") >= reach)
        if reach == 1:
            below = below.select(F.col("u1").alias("d1"), F.col("u2").alias("d2"), "n_leaves", "saved_tokens")
        else:
            if prefixes is None:
                zero = F.lit(0).cast("long")
                owners = nodes.filter("depth > 1").select("conv_id").distinct()
                inner = blocks.join(owners, "conv_id", "left_semi").select("conv_id", F.explode(_turn_prefixes("p1", "p2")).alias("t"))
                roots = owners.select("conv_id", zero.alias("depth"), zero.alias("d1"), zero.alias("d2"))
                prefixes = written(inner.select("conv_id", "t.depth", "t.d1", "t.d2").unionByName(roots), "trie-paths")
            below = below.select("conv_id", (F.col("depth") - reach).alias("depth"), "n_leaves", "saved_tokens").join(
                prefixes, ["conv_id", "depth"]
            )
        more = below.groupBy("d1", "d2").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        state = written(
            state.join(more, ["d1", "d2"], "left").select(
                *[c for c in state.columns if c not in ("n_leaves", "saved_tokens")],
                (F.col("n_leaves") + F.coalesce("leaves", F.lit(0))).alias("n_leaves"),
                (F.col("saved_tokens") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
            ),
            "trie-sums",
        )
        reach *= 2
    return state.select("d1", "d2", "n_children", "n_leaves", "saved_tokens")


def _pack(batches):
    """Sorted (node, conversation) rows as packs of comma-joined ids."""
    for batch in batches:
        d1, d2, ids = (c.to_numpy() for c in batch.columns)
        if not len(ids):
            continue
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
        start = np.flatnonzero(new)
        inner = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
        cut = np.flatnonzero(inner % PACK == 0)
        text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cut, np.append(cut[1:], len(ids)), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(d1[cut]), pa.array(d2[cut]), pa.array(ids[cut]), pa.array(text, pa.string())], ["d1", "d2", "first", "ids"]
        )


def _digest(batches):
    """Sorted packs as one SHA-256 for each node."""
    key, digest = None, None
    for batch in batches:
        out = []
        for d1, d2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (d1, d2) != key:
                if digest is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (d1, d2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield _digest_rows(out)
    yield _digest_rows([] if digest is None else [(*key, digest.hexdigest())])


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["d1", "d2", "ends_sha256"])


def end_digests(convs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``d1, d2, ends_sha256``: of the ids of the conversations that end at a
    node, ascending and comma-joined."""
    zero = F.lit(0).cast("long")
    ends = blocks.groupBy("conv_id").agg(F.bit_xor("x1").alias("d1"), F.bit_xor("x2").alias("d2"))
    ends = convs.join(ends, "conv_id", "left").select(F.coalesce("d1", zero).alias("d1"), F.coalesce("d2", zero).alias("d2"), "conv_id")
    ranged = ends.repartitionByRange("d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id")
    packs = ranged.mapInArrow(_pack, "d1 long, d2 long, first long, ids string")
    streamed = packs.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first")
    return streamed.mapInArrow(_digest, "d1 long, d2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """Every node of the trie of the rebuilt conversations: ``conv_id`` (the
    smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    turns = written(ordered_turns(conversations), "trie-ordered")
    convs, rebuilt = rebuilt_turns(turns)
    blocks = hashed_blocks(rebuilt, block, stretch)
    nodes = trie_nodes(convs, blocks)
    sums = _subtree_sums(nodes, blocks)
    ends = written(end_digests(convs, blocks), "trie-ends")
    nothing = hashlib.sha256(b"").hexdigest()
    digest = ["d1", "d2"]
    told = nodes.join(sums, digest).join(ends, digest, "left")
    parents = nodes.select(F.col("d1").alias("u1"), F.col("d2").alias("u2"), F.col("conv_id").alias("parent_conv_id"))
    return told.join(parents, ["u1", "u2"], "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
