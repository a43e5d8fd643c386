"""SimHash near-dedup with pivot distance tables.

A fingerprint has 64 bits; bit i is set if over half of the document's shingle
hashes (XXH64, seed 42) have it. Two fingerprints link if at most ``max_bits``
bits differ; linked documents, directly or through others, are one component.

Finding links. For every distinct fingerprint, its Hamming distances to fixed
reference fingerprints are computed once: the zero fingerprint, one for each
run of ``RUN`` bits (that run set), and ``RANDOM`` pseudo-random ones.
1. d(f, zero) - d(f, run j) tells how many bits run j of f has. Two linked
   fingerprints differ there for at most ``max_bits`` runs, so if the runs are
   dealt into max_bits + ``SPARE`` groups, they agree on SPARE whole groups.
   Each choice of that many groups is a bucket key: no link is missed.
2. Within a bucket, pairs whose largest coordinate difference over the whole
   table exceeds ``max_bits`` are discarded (triangle inequality).
3. Survivors are verified on their bits; a bucket gives the links of a spanning
   forest, not all pairs.
A bucket of more than ``BUCKET`` distinct fingerprints is dealt anew: each of
its members goes to the fingerprints within ceil(max_bits / 2) bits of it, and
two linked ones meet at one between them, so no such group exceeds 65 members
for max_bits <= 2. Those groups pass steps 2 and 3 as well. Work and memory of
a task are bounded whatever the number of copies, and no bucket is cut.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and links like any other; fewer words than a shingle give one
shingle, the whole sequence; equal texts share a fingerprint; a null doc_id is
never smallest (a component of null ids only has a null id); repeated rows are
kept as rows; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import whole
from assaykit.llm.components import components
from assaykit.session import materialize

SHINGLE, MAX_BITS, SEED = 3, 2, 42
RUN, RANDOM, SPARE, BUCKET = 2, 16, 2, 64
_PIECE = 1 << 16


def fingerprint_of(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = text.encode().lower().split()  # bytes: only A-Z change and only the six ASCII separators part
    if not words:
        return 0
    k, line = min(shingle, len(words)), b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
    digest = xxhash.xxh64_intdigest
    n, counts = len(words) - k + 1, np.zeros(64, np.int64)
    for at in range(0, n, _PIECE):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at:min(n, at + _PIECE)], ends[at + k - 1:])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint_of(t, shingle)).astype("int64")

    return of(whole(text))


def references() -> np.ndarray:
    """The reference fingerprints: zero, one for each run of bits, random ones."""
    runs = [((1 << RUN) - 1) << at for at in range(0, 64, RUN)]
    return np.array([0, *runs, *np.random.default_rng(SEED).integers(0, 1 << 63, RANDOM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)], np.uint64)


def distance_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each reference."""
    return np.bitwise_count(prints[:, None] ^ references()[None, :]).astype(np.int8)


def linked(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the fingerprints of one bucket."""
    table = distance_table(prints)
    parent, out = list(range(len(prints))), []

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(prints) - 1):
        apart = np.abs(table[i + 1:] - table[i]).max(axis=1)
        near = i + 1 + np.flatnonzero(apart <= max_bits)
        near = near[np.bitwise_count(prints[near] ^ prints[i]) <= max_bits]
        for j in near.tolist():
            if (a := top(i)) != (b := top(j)):
                parent[max(a, b)] = min(a, b)
                out.append((int(prints[j].view(np.int64)), int(prints[i].view(np.int64))))
    return out


def _links(buckets: DataFrame, max_bits: int) -> DataFrame:
    """``buckets`` has ``members``, an array of distinct fingerprints."""
    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def of(members: pd.Series) -> pd.Series:
        return members.map(lambda m: [{"a": a, "b": b} for a, b in linked(np.sort(np.asarray(m, np.int64)).view(np.uint64), max_bits)])

    return buckets.select(F.explode(of("members")).alias("l")).select("l.a", "l.b")


def bucket_keys(f: Column, max_bits: int) -> Column:
    """Array of the bucket keys of a fingerprint: for each choice of groups,
    its number and the counts of bits in the runs of those groups, which are
    half of 2 * RUN + d(f, zero) - d(f, run) each."""
    zero = F.bit_count(f)
    groups = max_bits + SPARE
    refs = references()[1:1 + 64 // RUN].view(np.int64).tolist()
    counts = [(F.lit(RUN) + zero - F.bit_count(f.bitwiseXOR(F.lit(r)))).cast("long") for r in refs]
    parts = [counts[len(refs) * g // groups:len(refs) * (g + 1) // groups] for g in range(groups)]
    return F.array(*[F.xxhash64(F.lit(i), *[c for g in chosen for c in parts[g]]) for i, chosen in enumerate(combinations(range(groups), SPARE))])


def between(f: Column, reach: int) -> Column:
    """Array of all values within ``reach`` bits of a fingerprint."""
    flips = [0]
    for r in range(1, reach + 1):
        flips += [sum(1 << b for b in bits) for bits in combinations(range(64), r)]
    signed = np.array(flips, np.uint64).view(np.int64).tolist()
    return F.transform(F.array(*[F.lit(x) for x in signed]), lambda x: x.bitwiseXOR(f))


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links that connect all fingerprints (column f, distinct) with at most
    ``max_bits`` differing bits."""
    keyed = materialize(prints.select("f", F.explode(bucket_keys(F.col("f"), max_bits)).alias("key")), "buckets")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.join(sizes, "key")
    small = shared.where(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list("f").alias("members"))
    large = shared.where(F.col("n") > BUCKET).select("f").distinct()
    met = large.select("f", F.explode(between(F.col("f"), (max_bits + 1) // 2)).alias("key"))
    met = met.groupBy("key").agg(F.collect_list("f").alias("members")).where(F.size("members") > 1)
    return _links(small.select("members"), max_bits).union(_links(met.select("members"), max_bits))


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, x (hash of the text), f (fingerprint,
    signed), component_id and ``kept``, the (doc_id, x) that stays."""
    t = F.col(f"`{text}`")
    base = materialize(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(t).alias("x"), fingerprint(t, shingle).alias("f")), "fingerprints")
    lowest = F.min_by(F.struct("doc_id", "x"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("x")))
    prints = base.groupBy("f").agg(lowest.alias("low"))
    roots = components(links(prints.select("f"), max_bits))
    rooted = prints.join(roots, F.col("f") == F.col("node"), "left").select("f", "low", F.coalesce("root", "f").alias("root"))
    kept = rooted.groupBy("root").agg(F.min_by("low", F.struct(F.col("low.doc_id").isNull(), F.col("low.doc_id"), F.col("low.x"))).alias("kept"))
    named = rooted.join(kept, "root").select("f", "kept")
    return base.join(named, "f").select("doc_id", "x", "f", F.col("kept.doc_id").alias("component_id"), "kept")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    return assign(docs).select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The documents that stay, one of each component: the one with the
    smallest doc_id; columns of ``docs``."""
    kept = assign(docs, text, doc_id, shingle, max_bits).select("kept.*").distinct().select(F.col("doc_id").alias("_d"), F.col("x").alias("_x"))
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("d"), F.xxhash64(F.col(f"`{text}`")).alias("x"))
    stay = marked.join(kept, F.col("d").eqNullSafe(F.col("_d")) & (F.col("x") == F.col("_x")), "left_semi").dropDuplicates(["d", "x"])
    return stay.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
