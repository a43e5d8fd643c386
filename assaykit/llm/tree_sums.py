"""Sums over all subtrees of a forest by parallel tree contraction.

Rounds alternate two steps on the nodes that are left:

* compress: a node with exactly one child is spliced out. Every maximal chain
  of such nodes is ranked by pointer jumping (each link doubles in a join
  round), so all of its nodes know the sum down to the chain's end; the end
  then hangs under the parent of the chain's top and carries the chain's sum on
  its edge.
* rake: all leaves go; their sums are added up by parent.

After a compress every inner node has two children or more, so a rake takes at
least half of the nodes: O(log n) rounds whatever the shape of the tree. Raked
nodes have their totals at once; the chains are re-expanded in reverse order of
the rounds, each node adding its sum to the total of its chain's end.

Joins are between columns that are unique on both sides, and sums by parent are
taken in each task first, so a node with a third of all nodes as children is no
hot key; the one exception is the re-expansion of a long chain, whose nodes all
look up its end: both sides are written tables, so a skewed join is split at
run time. Each step is written to the shared folder; a lost executor costs the
step at hand.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.session import materialize


def _edge(w: str) -> str:
    return f"edge_{w}"


def _compress(left: DataFrame, weights: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The nodes left without chains, and the chains: (id, next, weights), where
    ``next`` is the chain's end and the weights are the sums from the node down
    to the end's subtree, not included."""
    kids = left.where("parent is not null").groupBy("parent").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("next"), *[F.sum(_edge(w)).alias(f"down_{w}") for w in weights])
    only = kids.where("n = 1").drop("n").withColumnRenamed("parent", "id")
    links = materialize(left.where("parent is not null").join(only, "id").select(
        "id", "parent", "next", *[(F.col(w) + F.col(f"down_{w}")).alias(w) for w in weights], *[_edge(w) for w in weights]), "tree_links")
    if links.isEmpty():
        return left, None
    inner = links.select(F.col("next").alias("id"))
    tops = links.join(inner, "id", "left_anti").select("id", F.col("parent").alias("above"), *[_edge(w) for w in weights])
    starts = links.select(F.col("id").alias("next"), F.lit(True).alias("open"))
    chain = materialize(links.join(starts, "next", "left").select("id", "next", F.coalesce("open", F.lit(False)).alias("open"), *weights), "tree_chain")
    while not chain.where("open").isEmpty():
        # Open links jump over the next one; no two of them have the same next.
        step = chain.select(F.col("id").alias("next"), F.col("next").alias("far"), F.col("open").alias("more"), *[F.col(w).alias(f"far_{w}") for w in weights])
        jumped = chain.where("open").join(step, "next").select(
            "id", F.col("far").alias("next"), F.col("more").alias("open"), *[(F.col(w) + F.col(f"far_{w}")).alias(w) for w in weights])
        chain = materialize(chain.where("not open").unionByName(jumped), "tree_chain")
    moved = tops.join(chain.drop("open"), "id").select(F.col("next").alias("id"), "above", *[(F.col(_edge(w)) + F.col(w)).alias(f"up_{w}") for w in weights])
    rest = left.join(links.select("id"), "id", "left_anti").join(moved, "id", "left").select(
        "id", F.coalesce("above", "parent").alias("parent"), *weights, *[F.coalesce(F.col(f"up_{w}"), F.col(_edge(w))).alias(_edge(w)) for w in weights])
    return materialize(rest, "tree_rest"), chain.drop("open")


def _rake(left: DataFrame, weights: list[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes left without leaves, and the leaves that went: (id, weights)."""
    parents = left.where("parent is not null").select(F.col("parent").alias("id"), F.lit(True).alias("inner")).distinct()
    told = materialize(left.join(parents, "id", "left"), "tree_told")
    leaves, inner = told.where("inner is null"), told.where("inner").drop("inner")
    gains = leaves.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(*[F.sum(F.col(w) + F.col(_edge(w))).alias(f"more_{w}") for w in weights])
    grown = inner.join(gains, "id", "left").select(
        "id", "parent", *[(F.col(w) + F.coalesce(F.col(f"more_{w}"), F.lit(0))).alias(w) for w in weights], *[_edge(w) for w in weights])
    return materialize(grown, "tree_grown"), leaves.select("id", *weights)


def subtree_sums(nodes: DataFrame, weights: list[str]) -> DataFrame:
    """(id, weights): for each node the sums of the weights (long, not null)
    over its subtree, itself included.

    ``nodes`` has a unique ``id``, ``parent`` (null at a root, otherwise the id
    of a node) and the weights; it may hold several trees, and may be empty."""
    left = materialize(nodes.select("id", "parent", *[F.col(w).cast("long").alias(w) for w in weights], *[F.lit(0).cast("long").alias(_edge(w)) for w in weights]), "tree_rest")
    known, chains = [], []
    while not left.isEmpty():
        left, chain = _compress(left, weights)
        if chain is not None:
            chains.append(chain)
        left, leaves = _rake(left, weights)
        known.append(leaves)
    if not known:
        return nodes.select("id", *[F.col(w).cast("long").alias(w) for w in weights])
    totals = materialize(reduce(DataFrame.unionByName, known), "tree_totals")
    for chain in reversed(chains):
        ends = totals.select(F.col("id").alias("next"), *[F.col(w).alias(f"end_{w}") for w in weights])
        grown = chain.join(ends, "next").select("id", *[(F.col(w) + F.col(f"end_{w}")).alias(w) for w in weights])
        totals = materialize(totals.unionByName(grown), "tree_totals")
    return totals
