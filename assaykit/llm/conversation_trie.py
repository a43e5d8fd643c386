"""The trie of conversation prefixes: which conversations begin alike, and what
is saved if a shared beginning is kept once.

Turns are numbered in their order (:func:`numbered`), conversations are rebuilt
on the opening of their family's first one (:func:`rebuilt`), each prefix is
named by the XOR of hashes of its (place, turn) pairs (:func:`prefixes`), and
nodes are the distinct names. Sums over subtrees come from parallel tree
contraction (:mod:`assaykit.llm.tree_sums`).

A conversation, a turn or a node may hold a third of all rows: turns are ranked
by ranges of (conversation, turn) with counts carried over, prefixes by blocks
of ``BLOCK`` places with XORs carried over, and nodes are counted in each task
first. The ids that end at a node are joined to text in pieces of ``PIECE`` ids
by ranges; only the SHA-256 of the pieces, which is sequential by its nature,
runs in one task a node, piece after piece and without holding the text.

Defined cases: a null role or text counts as empty, a null turn comes first,
equal turns are ordered by the digest of (role, text), repeated rows are turns
of their own; rows without conv_id belong to no conversation and are left out;
a family is 20 consecutive ids, below 0 as well (-20 to -1 is one);
an empty table has no members and therefore no nodes; other columns are not
read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import whole, words
from assaykit.llm.tree_sums import subtree_sums
from assaykit.session import materialize

FAMILY, OPENINGS = 20, 4
BLOCK, PIECE = 1024, 1000
_NOTHING = hashlib.sha256(b"").hexdigest()


def opening(conv: Column) -> Column:
    """How many turns a conversation takes from its family's first one."""
    return (F.crc32(conv.cast("string").cast("binary")) % OPENINGS).cast("int")


def turns(conversations: DataFrame) -> DataFrame:
    """(c, turn, digest, words) of every turn that belongs to a conversation."""
    role = whole(F.col("role"))
    text = whole(F.col("text"))
    # The length of the role keeps ('a', 'bc') and ('ab', 'c') apart.
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn"), F.sha2(content, 256).alias("digest"), F.size(words(F.col("text"))).cast("long").alias("words"))


def numbered(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with ``place`` from 1 and what is known of their conversation,
    and the conversations: (c, n, h, base, taken, length)."""
    cut = materialize(told.repartitionByRange("c", "turn", "digest").withColumn("pid", F.spark_partition_id()), "trie_turns")
    runs = cut.groupBy("pid", "c").agg(F.count(F.lit(1)).alias("n"))
    # A window holds one row for each range that a conversation lies in.
    before = Window.partitionBy("c").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "trie_runs")
    convs = runs.groupBy("c").agg(F.sum("n").alias("n")).select("c", "n", opening(F.col("c")).alias("h"), (F.col("c") - F.pmod("c", F.lit(FAMILY))).alias("base"))
    first = convs.select(F.col("c").alias("base"), F.col("n").alias("base_n"))
    taken = F.least(F.col("h").cast("long"), F.coalesce("base_n", F.lit(0)))
    convs = materialize(convs.join(first, "base", "left").select(
        "c", "n", "h", "base", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "trie_conversations")
    known = runs.select("pid", "c", "before").join(convs, "c")
    rank = F.row_number().over(Window.partitionBy("pid", "c").orderBy("turn", "digest"))
    return cut.join(known, ["pid", "c"]).withColumn("place", F.col("before") + rank).drop("pid", "before", "turn"), convs


def rebuilt(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, (c, place, digest, words,
    length), and the conversations."""
    placed, convs = numbered(told)
    placed = materialize(placed, "trie_placed")
    own = placed.where("place > h").select("c", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "digest", "words", "length")
    # At most three turns of a base meet the conversations of its family.
    openings = placed.where((F.col("c") == F.col("base")) & (F.col("place") < OPENINGS)).select("base", "place", "digest", "words")
    begun = convs.select("c", "base", "h", "length").join(openings, "base").where("place <= h").select("c", "place", "digest", "words", "length")
    return own.unionByName(begun), convs


def _name(a: Column, b: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def _root() -> Column:
    return _name(F.lit(0).cast("long"), F.lit(0).cast("long"))


def prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` with the names ``id`` of the prefix that ends at each turn and
    ``parent`` of the one before. The name is the XOR of two 64-bit hashes of
    each (place, digest), so it can be summed up by blocks."""
    block = F.expr(f"(place - 1) div {BLOCK}")
    a, b = F.xxhash64("place", "digest"), F.xxhash64("digest", "place", F.lit("b"))
    hashed = materialize(rows.select("c", "place", "words", "length", block.alias("block"), a.alias("a"), b.alias("b")), "trie_hashed")
    sums = hashed.where(F.col("length") > BLOCK).groupBy("c", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("c", "block", F.bit_xor("a").over(before).alias("over_a"), F.bit_xor("b").over(before).alias("over_b")).where("block > 0")
    so_far = Window.partitionBy("c", "block").orderBy("place")
    named = hashed.select("*", F.bit_xor("a").over(so_far).alias("xa"), F.bit_xor("b").over(so_far).alias("xb")).join(carried, ["c", "block"], "left")
    xa, xb = (F.col(f"x{k}").bitwiseXOR(F.coalesce(f"over_{k}", F.lit(0))) for k in "ab")
    return named.select("c", "place", "words", "length", _name(xa, xb).alias("id"), _name(xa.bitwiseXOR(F.col("a")), xb.bitwiseXOR(F.col("b"))).alias("parent"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) from (id, c): the digest of the ids that end at each
    node, ascending and joined by commas."""
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, c = b["id"].to_numpy(), b["c"].to_numpy()
            at = np.arange(len(b))
            start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(b) else at
            own = np.repeat(start, np.diff(np.r_[start, len(b)]))
            cuts = np.flatnonzero((at - own) % PIECE == 0)
            yield pd.DataFrame({"id": ids[cuts], "least": c[cuts], "piece": [",".join(map(str, x.tolist())) for x in np.split(c, cuts[1:])] if len(b) else []})

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            done = []
            for key, piece in zip(b["id"], b["piece"]):
                if key == now:
                    state.update(b"," + piece.encode())
                    continue
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(piece.encode())
            yield pd.DataFrame(done, columns=["id", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(now, state.hexdigest())], columns=["id", "ends_sha256"])

    ranged = ends.repartitionByRange("id", "c").sortWithinPartitions("id", "c").mapInPandas(pieces, "id binary, least long, piece string")
    return ranged.repartition("id").sortWithinPartitions("id", "least").mapInPandas(digests, "id binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: id, parent, conv_id (smallest member), depth, n_convs,
    n_children, parent_conv_id, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(materialize(turns(conversations), "trie_contents"))
    named = materialize(prefixes(rows), "trie_prefixes")
    top = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id")).where("n_convs > 0").select(
        _root().alias("id"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("words"))
    below = named.groupBy("id").agg(F.min("parent").alias("parent"), F.min("c").alias("conv_id"), F.min("place").cast("long").alias("depth"),
                                    F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    nodes = below.unionByName(top)
    nodes = materialize(nodes, "trie_nodes")
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = materialize(nodes.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie_counted")
    sums = subtree_sums(nodes.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")),
                        ["n_leaves", "saved_tokens"])
    ends = named.where("place = length").select("id", "c").unionByName(convs.where("length = 0").select(_root().alias("id"), "c"))
    # The root is the parent of many nodes and one row: broadcast, and out of the join of the others.
    above = nodes.where("depth > 0 and n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(above, "parent")
    high = nodes.where("depth = 1").join(F.broadcast(nodes.where("depth = 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))), "parent")
    linked = deep.unionByName(high).unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    return linked.join(sums, "id").join(end_digests(materialize(ends, "trie_ends")), "id", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING)))


def report(conversations: DataFrame) -> DataFrame:
    """The nodes without their inner names."""
    return trie(conversations).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
