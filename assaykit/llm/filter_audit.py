"""Interaction of filters: for every order in which they can be applied, what
each step keeps and removes, and each filter's Shapley sum.

A document is one cell: its part and a mask with a bit for every filter it
fails. A recursive CTE enumerates the orders: it extends each prefix by the
letters not yet in it, joins the mask cells, and carries the applied bits, so
that a level's rows say for each cell whether that step removes it, keeps it,
or finds it failing but gone. The recursion holds no data of the corpus (for
five filters 325 prefixes x 32 cells, whatever the input); its rows are joined
with the counted cells of the parts. A prefix of k letters stands for all
orders that begin with it, which is the weight it has in the Shapley sum.

The five filters (A to E, bits 1 to 16) are those of :func:`document_cells`.
Copies are counted over digests of whole texts: rows are first summed by
(text, part, id), so a text or part with a third of all rows is spread by id.

Defined cases: a null text counts as empty, a null source is the part ''; a
text without words fails A, not B; a null doc_id is not larger than any id, so
its row never fails E; repeated rows with one doc_id are all counted, and none
of them fails E for the others; of a document's repeated labels a 1 holds,
null labels count for nothing, and rows without doc_id have none; an empty
table has no parts and gives an empty result; other columns are not read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.llm.common import whole, words
from assaykit.session import materialize

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def own_mask(text: str) -> tuple[dict[str, Column], Column]:
    """Helper columns and, over them, the bits of filters A to D of a text."""
    t = F.col(text)
    helpers = {"_w": words(t), "_caps": F.length(t) - F.length(F.translate(t, _CAPITALS, ""))}
    n = F.size("_w").cast("long")
    fails = [
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct("_w")).cast("long") < LEAST_DISTINCT * n,
        100 * F.col("_caps").cast("long") > MOST_CAPITALS * F.length(t),
        t.rlike(SYMBOLS),
    ]
    return helpers, sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


def document_cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, n_good, n_toxic) of the documents, one row per cell."""
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), whole(F.col("text")).alias("text"))
    helpers, mask = own_mask("text")
    flagged = rows.withColumns(helpers).select("id", "part", F.unhex(F.sha2("text", 256)).alias("sha"), mask.alias("mask"))
    counted = flagged.groupBy("sha", "mask", "part", "id").agg(F.count(F.lit(1)).alias("n"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("string").alias("key")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    # Rows without an id get a key of their own, or all of them would meet in one task.
    keyed = counted.withColumn("key", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("-"), F.hex("sha"))))
    known = keyed.join(materialize(told, "audit_labels"), "key", "left").fillna(False, ["good", "toxic"])
    groups = known.groupBy("sha", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    # By text there are now at most four rows a part.
    least = groups.groupBy("sha").agg(F.min("first.id").alias("least"))
    kept = F.col("nameless") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    dealt = groups.join(least, "sha").select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), kept.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - kept).alias("n")))).alias("x"))
    return dealt.where("x.n > 0").groupBy("part", "x.mask").agg(
        F.sum("x.n").alias("n"), F.coalesce(F.sum(F.when(F.col("good"), F.col("x.n"))), F.lit(0)).alias("n_good"),
        F.coalesce(F.sum(F.when(F.col("toxic"), F.col("x.n"))), F.lit(0)).alias("n_toxic"))


def steps(spark, letters: str = LETTERS) -> DataFrame:
    """(prefix, letter, applied, mask, gone, failing) of every prefix and mask
    cell. ``failing``: the cell fails the step's filter; ``gone``: a filter of
    the steps before removed it. Rows depend on the number of letters only."""
    named = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << i})" for i, c in enumerate(letters))
    return spark.sql(f"""
        WITH RECURSIVE steps(prefix, letter, applied, mask, gone, failing) AS (
          SELECT '', '', 0, CAST(id AS INT), false, false FROM range({1 << len(letters)})
          UNION ALL
          SELECT concat(prefix, more.letter), more.letter, applied | more.bit, mask, (mask & applied) <> 0, (mask & more.bit) <> 0
          FROM (SELECT *, explode(filter(array({named}), x -> (applied & x.bit) = 0)) AS more FROM steps)
        )
        SELECT * FROM steps WHERE prefix <> ''""")


def interactions(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order and step from counted cells."""
    spark = cells.sparkSession
    # Written, or the recursion would run once for each use. Its rows are fixed by the letters: a broadcast of constant size.
    enumerated = materialize(steps(spark, letters), "audit_steps")
    joined = cells.join(F.broadcast(enumerated), "mask")
    here = F.col("failing") & ~F.col("gone")
    alone = F.col("failing") & (F.bit_count("mask") == 1)

    def total(n: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(n)).otherwise(0)).cast("long")

    by_prefix = joined.groupBy("part", "prefix", "letter").agg(
        total("n", ~F.col("failing") & ~F.col("gone")).alias("kept"), total("n", here).alias("removed"), total("n", F.col("failing") & F.col("gone")).alias("redundant"),
        total("n", alone).alias("unique_fails"), total("n_good", here).alias("good_lost"), total("n_toxic", here).alias("toxic_lost"))
    stands_for = F.factorial(F.lit(len(letters)) - F.length("prefix"))
    # A window holds one row for each prefix that ends with the letter: 65 of them for five filters.
    shapley = F.sum(F.col("removed") * stands_for).over(Window.partitionBy("part", "letter")).cast("long")
    orders = enumerated.where(F.length("prefix") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    places = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters))))).withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    # As many rows as there are orders and steps, again fixed by the letters.
    return by_prefix.withColumn("shapley", shapley).join(F.broadcast(places), "prefix").select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over the documents, by source."""
    return interactions(materialize(document_cells(docs, labels), "audit_cells"))
