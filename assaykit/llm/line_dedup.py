"""Line dedup by winnowing: of every run of lines that an earlier document, or
an earlier place of the same one, also has, the later copy is deleted.
DataFrame functions only.

A run is consecutive lines with ``MIN_RUN_WORDS`` words or more in total, or a
single line with ``MIN_LINE_WORDS`` or more; two lines are equal if their words
are. Lines without words are passed over: they
neither match nor part a run, and go if they lie inside a deleted run.

Method. From each line, the shortest windows of that many words are taken
forwards and backwards, and the line alone if it has words enough. The least line hash of a window is its fingerprint, so
two copies of a run select the same fingerprints. Fingerprints found at one
place only are dropped; the windows of the others are joined by fingerprint and
window content with the place where that content is first. Forward and
backward windows together reach both ends of every repeated run, so the match
is extended to its full length both ways, and every window but the first goes.
Nothing is paired within a group: each window meets the first place alone. A
line that a third of all documents have is a hot key of both joins; the small
sides are written tables, so Spark splits the large side at run time.

Order is by doc_id (nulls first), then text hash. Defined cases: a null text
stays null; an empty text stays empty; a document that is all repeated becomes
an empty text, it is not dropped; rows with equal doc_id and equal text are one
document and both get its result; an empty table gives an empty result; other
columns come through unchanged, whatever their names, but for ``n_chars``,
which is counted anew where the documents have it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import running, whole
from assaykit.session import materialize

MIN_RUN_WORDS, MIN_LINE_WORDS = 30, 8

_WINDOW = "array<struct<fp:bigint,at:int,key:bigint,first:int,last:int>>"


def _lines(text: Column) -> Column:
    flat = text
    for c in "\t\x0b\x0c\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    each = F.transform(F.split(flat, "\n", -1), lambda x: F.array_remove(F.split(x, " ", -1), ""))
    told = F.transform(each, lambda w, i: F.struct(i.alias("i"), F.size(w).alias("n"), F.xxhash64(w).alias("h")))
    return F.filter(told, lambda x: x["n"] > 0)


def _search(sums: Column, low: Column, high: Column, target: Column) -> Column:
    """The least m from low to high with sums[m] >= target."""
    middle = lambda a: F.shiftright(a["lo"] + a["hi"], 1)
    pair = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    return F.aggregate(
        F.sequence(F.lit(0), F.ceil(F.log2(F.size(sums).cast("double"))).cast("int")), pair(low, high),
        lambda a, _: F.when(a["lo"] >= a["hi"], a).when(F.get(sums, middle(a)) >= target, pair(a["lo"], middle(a))).otherwise(pair(middle(a) + 1, a["hi"])),
        lambda a: a["lo"])


def windows(docs: DataFrame, text: str, min_words: int) -> DataFrame:
    """One row per document and window: d, x (the document), fp, at (the line
    that is the fingerprint), key (content), first, last (lines)."""
    df = docs.select("d", "x", _lines(whole(F.col(text))).alias("lines"))
    df = df.withColumn("total", F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    df = df.withColumn("before", running(F.col("lines"), "bigint", lambda pos, x: pos, lambda x: x["n"]))
    df = df.select("d", "x", "lines", F.concat("before", F.array("total")).alias("sums"))
    sums, lines, k = F.col("sums"), F.col("lines"), F.size("lines")
    ahead = F.filter(F.transform(lines, lambda _, j: F.struct(j.alias("a"), (_search(sums, j + 1, k + 1, F.get(sums, j) + min_words) - 1).alias("b"))), lambda w: w["b"] < k)
    back = F.filter(F.transform(lines, lambda _, j: F.struct((_search(sums, F.lit(0), j + 1, F.get(sums, j + 1) - min_words + 1) - 1).alias("a"), j.alias("b"))), lambda w: w["a"] >= 0)
    alone = F.filter(F.transform(lines, lambda x, j: F.when(x["n"] >= min(MIN_LINE_WORDS, min_words), F.struct(j.alias("a"), j.alias("b")))), lambda w: w.isNotNull())
    df = df.withColumn("w", F.array_distinct(F.concat(ahead, back, alone)))
    line = lambda i: F.get(lines, i)

    def told(w: Column) -> Column:
        span = F.sequence(w["a"], w["b"])
        least = F.array_min(F.transform(span, lambda i: F.struct(line(i)["h"].alias("h"), line(i)["i"].alias("i"))))
        key = F.aggregate(span, F.lit(0).cast("long"), lambda a, i: F.xxhash64(a, line(i)["h"]))
        return F.struct(least["h"].alias("fp"), least["i"].alias("at"), key.alias("key"), line(w["a"])["i"].alias("first"), line(w["b"])["i"].alias("last"))

    # explode_outer: Spark copies what feeds a plain explode into a filter below it, and would compute it twice.
    return df.select("d", "x", F.explode_outer(F.transform("w", told).cast(_WINDOW)).alias("w")).where("w is not null").select("d", "x", "w.*")


def repeated(docs: DataFrame, text: str, min_words: int) -> DataFrame:
    """One row per document that has later copies: d, x and ``runs``, its
    windows (first, last) to delete."""
    found = materialize(windows(docs, text, min_words), "windows")
    spot = F.xxhash64("d", "x", "at")
    often = materialize(found.groupBy("fp").agg(F.min(spot).alias("low"), F.max(spot).alias("high")).where("low <> high").select("fp"), "often")
    # Written, so that the next grouping deals by fingerprint and content after its own partial sums.
    some = materialize(found.join(often, "fp", "left_semi"), "repeated")
    place = F.struct("d", "x", "first")
    origin = some.groupBy("fp", "key").agg(F.min(place).alias("origin"), F.max(place).alias("end")).where(~F.col("origin").eqNullSafe(F.col("end"))).select("fp", "key", "origin")
    origin = materialize(origin, "origin")
    later = some.join(origin, ["fp", "key"]).where(~place.eqNullSafe(F.col("origin")))
    return later.groupBy("d", "x").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_RUN_WORDS) -> DataFrame:
    """The documents with repeated runs deleted: the columns of ``docs`` as
    ``row`` and ``n_lines``, ``n_deleted``, ``new_text``."""
    t = F.col(f"`{text}`")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("d"), t.alias("t"), F.xxhash64(t).alias("x"))
    gone = repeated(marked.select("d", "x", "t"), "t", min_words)
    gone = gone.select(F.col("d").alias("_d"), F.col("x").alias("_x"), F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))).alias("gone"))
    both = marked.join(gone, F.col("d").eqNullSafe(F.col("_d")) & (F.col("x") == F.col("_x")), "left")
    both = both.withColumn("lines", F.split(whole(F.col("t")), "\n", -1))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    lines = F.col("lines")
    new = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    return both.select("row", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"), new.alias("new_text"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, n_deleted and the text left."""
    return dedup(docs).select("row.doc_id", "n_lines", F.when(F.col("n_deleted") > 0, F.col("n_deleted")).otherwise(0).cast("long").alias("n_deleted"), F.col("new_text").alias("text"))


def rewrite(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with their new texts, in the columns of ``docs``."""
    new = {text: F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return dedup(docs, text).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
