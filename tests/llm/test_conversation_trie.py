"""The prefix trie against tries built in plain Python, and subtree sums against recursion."""
import hashlib
import random
import zlib

import pytest

from assaykit.llm import conversation_trie as t
from assaykit.llm.tree_sums import subtree_sums
from assaykit.session import materialize
from tests.llm.helpers import SF, words

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """rows: (conv_id, turn, role, text). Nodes as tuples in the order of the contract."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for key in members:
        if key:
            kids.setdefault(key[:-1], []).append(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in kids.get(key, [])) or 1
        saved[key] = sum(saved[k] for k in kids.get(key, [])) + ((len(members[key]) - 1) * len(words(key[-1][1])) if key else 0)
    return sorted((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(kids.get(key, [])), leaves[key], saved[key],
                   hashlib.sha256(",".join(str(c) for c in sorted(m) if len(made[c]) == len(key)).encode()).hexdigest()) for key, m in members.items())


def check(spark, df):
    got = sorted(tuple(r) for r in t.report(df).collect())
    assert got == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    return got


def test_given_table(spark):
    got = check(spark, spark.read.parquet(f"{SF}/conversations.parquet"))
    assert any(r[4] > 1 for r in got) and any(r[6] for r in got)


def test_odd_rows(spark):
    """Nulls anywhere, repeated rows, ties in turn, long chains, many copies, one-turn conversations, negative ids, absent bases."""
    long = [(c, i, "user", f"turn {i} of a chain") for c in (40, 41, 43) for i in range(30)]
    rows = long + [(0, 0, None, "a b"), (0, None, "user", None), (0, 1, "user", "x"), (1, 0, "r", "a  b c"), (1, 0, "r", "a  b c"), (1, 0, "", ""), (2, 5, "user", "x"),
                   (None, 1, "user", "lost"), (None, None, None, None), (65, 0, "u", "only"), (66, 0, "u", "only"), (67, 0, "u", "only"), (-3, 0, "u", "minus"), (-3, 1, "u", "minus"), (-20, 0, "u", "m"), (-20, 1, "u", "n"), (-20, 2, "u", "o")]
    rows += [(1000 + c, i, "user", f"copy {i}") for c in range(45) for i in range(5)] + [(200, 0, "ab", "c"), (220, 0, "a", "bc")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", c int, id int")
    got = check(spark, df)
    assert max(r[1] for r in got) == 30


def test_empty_and_turnless(spark):
    assert t.report(spark.createDataFrame([], SCHEMA)).count() == 0
    # An opening longer than the conversation, of a family without a first one: no turn is left.
    lone = next(c for c in range(1001, 1020) if zlib.crc32(str(c).encode()) % 4)
    assert check(spark, spark.createDataFrame([(lone, 0, "user", "gone")], SCHEMA)) == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_blocks_and_pieces(spark, monkeypatch):
    """Carried numbers, names and digests, with borders inside of conversations."""
    monkeypatch.setattr(t, "BLOCK", 3)
    monkeypatch.setattr(t, "PIECE", 2)
    rows = [(c, i, "u", f"t{i if i < 6 + c % 3 else -i}") for c in range(100, 130) for i in range(14)]
    check(spark, spark.createDataFrame(rows, SCHEMA).repartition(7))


@pytest.mark.parametrize("shape", ["chain", "star", "random", "comb", "forest"])
def test_subtree_sums(spark, shape):
    rnd = random.Random(shape)
    n = 120
    parent = {"chain": lambda i: i - 1, "star": lambda i: 0, "random": lambda i: rnd.randrange(i), "comb": lambda i: i - 1 if i % 2 else max(0, i - 2),
              "forest": lambda i: None if i % 40 == 0 else i - 1 - rnd.randrange(min(3, i % 40))}[shape]
    rows = [(i, parent(i) if i else None, rnd.randrange(100), 1) for i in range(n)]
    want = {i: [a, b] for i, _, a, b in rows}
    for i, p, _, _ in reversed(rows):
        if p is not None:
            want[p][0] += want[i][0]
            want[p][1] += want[i][1]
    got = subtree_sums(materialize(spark.createDataFrame(rows, "id long, parent long, a long, b long"), "test_tree"), ["a", "b"])
    assert {r.id: [r.a, r.b] for r in got.collect()} == want and got.count() == n
