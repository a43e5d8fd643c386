"""BPE encoding and decoding by forced boundaries.

A text is normalised and cut into words as the tokenizer file says. Two bytes
that never stand side by side inside any token of the vocabulary can never be
merged, so every such pair is a certain cut: a word falls into fragments, each
is encoded alone, and the ids are put one after another. Fragments and words
recur, so each task keeps a bounded table of those it has encoded.

The vocabulary file is read on the driver (a path it can open) and sent to the
tasks once; it has a fixed size. Rows are independent: no shuffle.

Supported files: "tokenizers" JSON with a BPE model that marks word ends with a
suffix, the normalisers NFC, white space to one space and Lowercase, a Split
pattern whose matches are kept, byte-level symbols and no decoder. Others raise
an error.

Defined cases: a null text counts as empty; an empty text, or one of white
space only, has no ids and decodes to the empty string; the strings of special
tokens in a text are these tokens, as the library has it by default; very long
words are merged with a heap in O(n log n), all others by the thousand in array operations; an empty table gives an empty
result; other columns come through unchanged.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import whole

#: From so many words or runs on, about 300 bytes each, the tables are emptied.
REMEMBERED = 250_000
#: Characters of text that are encoded together.
PIECE = 2_000_000
#: From so many symbols on, a fragment is merged with a heap.
LONG = 48
#: White space as Unicode has it, which is what the tokenizer's ``\\s`` means.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is printable and
    not a space, else the next free one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = (b for b in range(256) if b not in set(plain))
    other = {b: chr(256 + k) for k, b in enumerate(rest)}
    return [other.get(b, chr(b)) for b in range(256)]


class Encoder:
    def __init__(self, file: bytes):
        told = json.loads(file)
        model = told["model"]
        kinds = [n["type"] for n in told["normalizer"]["normalizers"]]
        split = told["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or told["decoder"] is not None or not split["invert"] or not model["end_of_word_suffix"]:
            raise ValueError("a tokenizer of this kind is not supported")
        end, ids = model["end_of_word_suffix"], model["vocab"]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.names = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.words = regex.compile(split["pattern"]["Regex"].replace("\\s", SPACES)).findall
        self.white = regex.compile(f"[{SPACES}]+")
        self.controls = regex.compile("[\\x1c-\\x1f]").search
        self.at_special = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")") if self.special else None
        self.known: dict[str, tuple[bytes, str]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}
        symbols = byte_symbols()
        self.inner = np.array([ids[c] for c in symbols], np.int64)
        self.last = np.array([ids[c + end] for c in symbols], np.int64)
        # Merges by pair of ids; the rank is the place in the file.
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[x] << 32 | ids[y] for x, y in pairs], np.int64)
        self.none = len(pairs)
        self.made = np.array([ids[x + y] for x, y in pairs], np.int64)
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        self.by_pair = dict(zip(keys.tolist(), range(self.none)))
        # Which byte may follow which inside some token.
        byte = {c: b for b, c in enumerate(symbols)}
        self.joins = np.zeros((256, 256), bool)
        for token in ids:
            own = [byte[c] for c in token.removesuffix(end)]
            self.joins[own[:-1], own[1:]] = True

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; ``none`` if it never merges or an id is below 0."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], self.none)

    def merge_rows(self, rows: np.ndarray) -> np.ndarray:
        """Merge each row of ids (padded with -1) until none is left: every turn
        joins, in each row, the pair of lowest rank, the leftmost among equals."""
        done, live = rows.copy(), np.arange(len(rows))
        ranks = self.ranks(rows[:, :-1], rows[:, 1:])
        place = np.arange(rows.shape[1])
        while True:
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(live)), at]
            go = low < self.none
            done[live[~go]] = rows[~go]
            live, rows, ranks, at, low = live[go], rows[go], ranks[go], at[go], low[go]
            if not len(live):
                return done
            k = np.arange(len(live))
            rows[k, at] = self.made[low]
            # Everything behind the pair moves up by one.
            rows = np.take_along_axis(np.pad(rows, ((0, 0), (0, 1)), constant_values=-1), place + (place > at[:, None]), 1)
            ranks = np.take_along_axis(np.pad(ranks, ((0, 0), (0, 1)), constant_values=self.none), place[:-1] + (place[:-1] > at[:, None]), 1)
            ranks[k, np.minimum(at, ranks.shape[1] - 1)] = self.ranks(rows[k, np.minimum(at, ranks.shape[1] - 1)], rows[k, np.minimum(at, ranks.shape[1] - 1) + 1])
            before = np.maximum(at - 1, 0)
            ranks[k, before] = self.ranks(rows[k, before], rows[k, before + 1])

    def merge_long(self, now: list[int]) -> list[int]:
        """The same for one long fragment, with a heap."""
        n, now = len(now), list(now)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i, j: self.by_pair.get(now[i] << 32 | now[j])
        heap = [(r, i) for i in range(n - 1) if (r := rank(i, i + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if now[i] < 0 or j >= n or rank(i, j) != r:
                continue  # one of the two has been merged since
            now[i], now[j], after[i] = int(self.made[r]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := rank(i, after[i])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank(before[i], i)) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [x for x in now if x >= 0]

    def learn(self, words: list[str]) -> None:
        """Encode words, all at once: cut them into fragments at the forced
        boundaries, merge the fragments alone, and put the ids together."""
        data = [w.encode() for w in words]
        flat = np.frombuffer(b"".join(data), np.uint8)
        ends = np.cumsum([len(d) for d in data])
        ids = self.inner[flat]
        ids[ends - 1] = self.last[flat[ends - 1]]
        cut = np.ones(len(flat) + 1, bool)
        cut[1:-1] = ~self.joins[flat[:-1], flat[1:]]
        cut[ends] = True
        starts = np.flatnonzero(cut)
        starts, sizes = starts[:-1], np.diff(starts)
        kept = np.full(len(flat), -1, np.int64)  # a fragment's ids, from its first place on
        kept[starts[sizes == 1]] = ids[starts[sizes == 1]]
        for low, high in ((1, 4), (4, 8), (8, 16), (16, LONG)):
            of = starts[(sizes > low) & (sizes <= high)]
            n = sizes[(sizes > low) & (sizes <= high)]
            if len(of):
                inside = np.arange(high) < n[:, None]
                place = np.minimum(of[:, None] + np.arange(high), len(flat) - 1)
                merged = self.merge_rows(np.where(inside, ids[place], -1))
                kept[place[inside]] = merged[inside]
        for at, n in zip(starts[sizes > LONG].tolist(), sizes[sizes > LONG].tolist()):
            got = self.merge_long(ids[at:at + n].tolist())
            kept[at:at + len(got)] = got
        told = kept[kept >= 0]
        upto = np.concatenate([[0], np.cumsum(kept >= 0)])[ends].tolist()
        packed, names = told.astype("<u4").tobytes(), [self.names[i] for i in told.tolist()]
        a = 0
        for w, b in zip(words, upto):
            self.known[w] = packed[4 * a:4 * b], " ".join(names[a:b])
            a = b

    def prepare(self, texts: list[str]) -> list[list[str]]:
        """Make sure that all that ``texts`` holds is known; returns each text's
        runs without white space (special tokens are runs of their own)."""
        if len(self.known) > REMEMBERED or len(self.chunks) > REMEMBERED:
            self.known.clear()
            self.chunks.clear()
        runs = [self.runs(t) for t in texts]
        new = {c for r in runs for c in r if c not in self.chunks}
        # Normalising never reaches over white space, so a run stands alone. Each character is
        # lower-cased alone, so a capital sigma never becomes a final one.
        words = {c: self.words(unicodedata.normalize("NFC", c).replace("Σ", "σ").lower()) for c in new}
        if missing := list({w for ws in words.values() for w in ws if w not in self.known}):
            self.learn(missing)
        known = self.known
        for c, ws in words.items():
            if len(ws) == 1:
                self.chunks[c] = known[ws[0]]
            else:
                self.chunks[c] = b"".join([known[w][0] for w in ws]), " ".join([known[w][1] for w in ws])
        for t, i in self.special.items():
            self.chunks[t] = np.array([i], "<u4").tobytes(), t
        return runs

    def runs(self, text: str) -> list[str]:
        if self.controls(text):  # str.split parts at four control characters that are no white space to the tokenizer
            split = lambda s: [x for x in self.white.split(s) if x]
        else:
            split = str.split
        if self.at_special and self.at_special.search(text):
            return [x for k, s in enumerate(self.at_special.split(text)) for x in ([s] if k % 2 else split(s))]
        return split(text)

    def batches(self, texts: Iterable[str]) -> Iterator[list[list[tuple[bytes, str]]]]:
        """The (ids, tokens) of the runs of each text, a few MB of text at a time."""
        some: list[str] = []
        size = 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size > PIECE:
                yield self.parts(some)
                some, size = [], 0
        if some:
            yield self.parts(some)

    def parts(self, texts: list[str]) -> list[list[tuple[bytes, str]]]:
        runs, chunks = self.prepare(texts), self.chunks
        return [[chunks[c] for c in r] for r in runs]

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        return [b"".join([p[0] for p in parts]) for some in self.batches(texts) for parts in some]

    def decode(self, ids: bytes) -> str:
        return " ".join([self.names[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def digests(self, texts: Iterable[str]) -> list[tuple[int, str, str]]:
        """Number of ids, digest of the ids and of the text they decode to."""
        out = []
        for some in self.batches(texts):
            for parts in some:
                ids = b"".join([p[0] for p in parts])
                decoded = " ".join([p[1] for p in parts if p[0]])
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out


def _file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the column ``ids``: the token ids as little-endian unsigned 32-bit
    numbers in one binary value."""
    file = docs.sparkSession.sparkContext.broadcast(_file(path))

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(file.value)
        for texts in batches:
            yield pd.Series(encoder.encode(texts), dtype=object)

    return docs.withColumn(ids, of(whole(F.col(f"`{text}`"))))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the column ``text``: the tokens of ``ids``, as the library decodes
    them without a decoder: joined by one space. Null ids count as none."""
    file = rows.sparkSession.sparkContext.broadcast(_file(path))

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(file.value)
        for each in batches:
            yield each.map(lambda b: encoder.decode(bytes(b)))

    return rows.withColumn(text, of(F.coalesce(F.col(f"`{ids}`"), F.lit(b""))))


def report(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, and digests of its ids and of
    the text they decode to. Ids and decoded text stay inside the task."""
    file = docs.sparkSession.sparkContext.broadcast(_file(path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(file.value)
        for texts in batches:
            yield pd.DataFrame(encoder.digests(texts), columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", of(whole(F.col(f"`{text}`"))).alias("r")).select("doc_id", "r.*")
