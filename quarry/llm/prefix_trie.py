"""Prefix trie of turn sequences, built by van Emde Boas recursion on depth.

The sequences of all conversations are cut at half of the (power of two)
height; each cut prefix gets a name, and the upper trie and the lower forests
(one below each name) are cut at their halves in turn, all tries of one height
in one job.  After log2(height) rounds every prefix of every sequence has a
name, that is a node.  Totals of subtrees go the other way: in the round of
height 2h every root of a lower forest (height h) grafts what lies below it in
its forest on to all nodes above it in its upper trie.  A root reaches these
through its smallest member's path, h rows, so the rounds together handle
(turns x log2(height)) rows and no node meets all its descendants.

Spread: rows are single turns and nodes, never whole conversations.  Turns are
numbered by one range shuffle (``positions``), so a conversation may hold any
share of the rows; nodes with very many members or children only meet
aggregates that combine before the shuffle.  Names are 128-bit digests.  The
conversations that end at one node are listed in order by a range shuffle that
splits them over tasks, joined to pieces of text there, and the pieces of a
node, some 8,000 conversations each, stream through its hash in order, since
a hash is a chain.

Defined results: null role or text is empty; rows of equal conv_id and turn
are ordered by their digests; rows without conv_id are left out; extra columns
are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, map_batches, positions

#: Conversations in a piece of a node's list.
PIECE = 8192


def _name(*parts: str) -> Column:
    return F.unhex(F.md5(F.concat(*[F.col(p) for p in parts])))


#: The name of the empty prefix.
ROOT = hashlib.md5(b"").digest()


def turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, pos, turn_name, chars, n_own): every turn in its place."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(text[0]).cast("string"), F.lit(":"), *text).cast("binary"))).alias("turn_name"),
        F.char_length(text[1]).cast("long").alias("chars"))
    placed = positions(scratch.save(rows, "named"), "conv", [F.asc_nulls_first("turn"), F.asc("turn_name")], scratch, "ordered")
    return scratch.save(placed.select("conv", "pos", "turn_name", "chars", F.col("total").alias("n_own")), "turns")


def rebuild(own: DataFrame, scratch: Scratch, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """((conv, pos, turn_name, chars) of the rebuilt conversations, (conv, n)):
    the first h turns of conversation c - c % block, then c's own turns after
    its first h, where h is the CRC-32 of c modulo ``most``."""
    def shared(c: str) -> Column:
        return F.crc32(F.col(c).cast("string").cast("binary")) % most
    convs = own.where("pos = 0").select("conv", "n_own", shared("conv").alias("h"), (F.col("conv") - F.col("conv") % block).alias("base"))
    heads = own.where(F.col("pos") < most - 1).select(F.col("conv").alias("base"), "pos", "turn_name", "chars", F.col("n_own").alias("n_base"))
    begun = convs.join(heads.where("pos = 0").select("base", "n_base"), "base", "left").select(
        "conv", "n_own", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("n_begun"))
    begun = scratch.save(begun, "begun")
    lengths = begun.select("conv", (F.col("n_begun") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n"))
    # a base has at most ``block`` conversations and gives each at most most - 1 turns
    first = begun.join(heads, "base").where("pos < h").select("conv", "pos", "turn_name", "chars")
    rest = own.where(F.col("pos") >= shared("conv")).join(begun.select("conv", "h", "n_begun"), "conv").select(
        "conv", (F.col("pos") - F.col("h") + F.col("n_begun")).alias("pos"), "turn_name", "chars")
    return scratch.save(first.union(rest), "rebuilt"), scratch.save(lengths, "lengths")


def prefixes(sequence: DataFrame, lengths: DataFrame, rounds: int, scratch: Scratch) -> DataFrame:
    """(conv, depth, node) of every prefix of every sequence, the empty one too."""
    # blocks of 2**j turns, each named by its halves: what a cut prefix adds to its forest's name
    blocks = [sequence.select("conv", F.col("pos").alias("k"), F.col("turn_name").alias("block"))]
    for j in range(1, rounds):
        half = blocks[-1]
        both = half.groupBy("conv", F.floor(F.col("k") / 2).alias("k")).agg(
            F.max(F.when(F.col("k") % 2 == 0, F.col("block"))).alias("left"), F.max(F.when(F.col("k") % 2 == 1, F.col("block"))).alias("right"))
        blocks.append(scratch.save(both.where("left is not null and right is not null").select("conv", "k", _name("left", "right").alias("block")), f"blocks{j}"))
    # cuts, from the whole height down: a trie that starts at ``depth`` is cut h = 2**j below
    named = [scratch.save(lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("node")), "roots")]
    for j in reversed(range(rounds)):
        h = 1 << j
        starts = named[0]
        for x in named[1:]:
            starts = starts.union(x)
        cut = starts.withColumn("k", (F.col("depth") / h).cast("long")).join(blocks[j], ["conv", "k"]).select(
            "conv", (F.col("depth") + h).alias("depth"), _name("node", "block").alias("node"))
        named.append(scratch.save(cut, f"cut{j}"))
    out = named[0]
    for x in named[1:]:
        out = out.union(x)
    return out


def _ends(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(depth, node, ends_sha256) of the nodes where conversations (depth, node, conv) end."""
    spark = members.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = ["depth", "node", "conv"]

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []
        for b in it:
            for depth, node, conv in zip(*(b.column(c).to_pylist() for c in by)):
                if (depth, node) != key or len(ids) == PIECE:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = (depth, node), []
                ids.append(conv)
            if out:
                yield _batch(out, [pa.int64(), pa.binary(), pa.int64(), pa.string()], ["depth", "node", "first", "ids"])
                out = []
        if ids:
            yield _batch([(*key, ids[0], ",".join(map(str, ids)))], [pa.int64(), pa.binary(), pa.int64(), pa.string()], ["depth", "node", "first", "ids"])

    def hashes(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in it:
            out = []
            for depth, node, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "node", "ids"))):
                if (depth, node) != key:
                    if key:
                        out.append((*key, h.hexdigest()))
                    key, h = (depth, node), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield _batch(out, [pa.int64(), pa.binary(), pa.string()], ["depth", "node", "ends"])
        if key:
            yield _batch([(*key, h.hexdigest())], [pa.int64(), pa.binary(), pa.string()], ["depth", "node", "ends"])
    ordered = scratch.save(members.select(*by), "ends").repartitionByRange(n, *by).sortWithinPartitions(*by)
    joined = scratch.save(map_batches(ordered, pieces, "depth long, node binary, first long, ids string"), "end-pieces")
    chained = joined.repartition(n, "depth", "node").sortWithinPartitions("depth", "node", "first")
    return map_batches(chained.select("depth", "node", "ids"), hashes, "depth long, node binary, ends string")


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def build(sequence: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of the trie over sequences (conv, pos, turn_name, chars) of n
    turns (``lengths``: conv, n): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    deepest = lengths.agg(F.max("n")).first()[0] or 0
    rounds = int(deepest).bit_length()
    paths = prefixes(sequence, lengths, rounds, scratch)
    # a member's node, the node above and the last turn's size
    last = sequence.select("conv", (F.col("pos") + 1).alias("depth"), "chars")
    steps = paths.join(lengths, "conv").join(last, ["conv", "depth"], "left")
    above = paths.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"))
    steps = scratch.save(steps.join(above, ["conv", "depth"], "left"), "paths")
    nodes = steps.groupBy("depth", "node").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("n").alias("reach"), F.max("chars").alias("chars"), F.max("parent").alias("parent"))
    nodes = scratch.save(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0)))
                         .withColumn("leaf", (F.col("reach") == F.col("depth")).cast("long")), "nodes")

    # what each node gathers: its own, then grafts of every round
    gathered = nodes.select("depth", "node", F.col("leaf").alias("leaves"), "saved")
    for j in range(rounds):
        h = 1 << j
        # roots of lower forests of height h: all below them within the forest is gathered
        roots = nodes.where(F.col("depth") % (2 * h) == h).select("depth", "node", "conv")
        below = gathered.where(F.col("depth") % (2 * h) == h).groupBy("depth", "node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        below = below.join(roots, ["depth", "node"]).select("conv", F.floor(F.col("depth") / (2 * h)).alias("trie"), "leaves", "saved")
        upper = steps.where(F.col("depth") % (2 * h) < h).select("conv", F.floor(F.col("depth") / (2 * h)).alias("trie"), "depth", "node")
        grafts = below.join(upper, ["conv", "trie"]).groupBy("depth", "node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        gathered = gathered.union(scratch.save(grafts, f"grafts{j}"))
    totals = gathered.groupBy("depth", "node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    ends = _ends(steps.where("depth = n").select("depth", "node", "conv"), scratch)
    # the node above by its smallest member: a hot parent is a skewed side of an inner join, which Spark splits
    named = nodes.select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    first = nodes.where("depth = 0").agg(F.min("conv")).first()[0]
    low = nodes.where("depth > 1").select("depth", "node", "parent").join(named, ["depth", "parent"]).select("depth", "node", "parent_conv_id")
    top = nodes.where("depth = 1").select("depth", "node", F.lit(first).cast("long").alias("parent_conv_id"))
    facts = (totals.join(children, ["depth", "node"], "left").join(ends, ["depth", "node"], "left").join(low.union(top), ["depth", "node"], "left"))
    return nodes.select("depth", "node", "conv", "n_convs").join(facts, ["depth", "node"]).select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
