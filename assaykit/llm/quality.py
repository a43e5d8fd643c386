"""Quality rules by distribution divergence: histograms of character classes
and of common words are compared with references of the document's language
by Jensen-Shannon distance. DataFrame functions only.

A reference is the summed histogram of all documents of that language that
pass the base rules and have ``MIN_WORDS`` words, so it is gathered from the
whole corpus. Guards: a document under ``MIN_WORDS`` words, or a language
whose reference holds under ``MIN_REFERENCE`` words, is not judged by distance.

Defined cases: a null text counts as empty (no words, base rule fails); a null
or unknown language is compared by character classes only, with the documents
of the same label; repeated rows are judged alike; an empty table gives an
empty result; other columns, whatever their names, come through unchanged.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import SPACE, count_chars, fitted, whole, words
from assaykit.session import materialize

# The base rules.
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20

#: References are broadcast up to so many languages (under 300 bytes each); beyond, they are joined by shuffle.
MOST_LANGUAGES = 10_000

#: Guards: words a document, and a reference, must have.
MIN_WORDS, MIN_REFERENCE = 50, 2000
#: Jensen-Shannon distances (square root, base 2): a document goes if its
#: character classes alone are this far, or if both histograms are rather far.
MAX_CHAR, BOTH_CHAR, BOTH_WORD = 0.30, 0.16, 0.26
#: The same for taking part in the references of the second round.
FIRST_CHAR = 0.2

#: Common words of each language, counted where they stand alone in lower case.
COMMON = {
    "en": "the of and to a in is that for it on with as was by be at this from are have not or an which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus au sur ne se pas avec ce".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o".split(),
}


def repeated_words(word_hashes: Column, windows: Column) -> Column:
    """Words that lie in a window found twice or more in the same text.
    ``windows`` has the hash of the window that begins at each word."""
    order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(order)
    # Each entry beside its neighbours in hash order: equal to one of them means found twice.
    left = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(order, 1, n - 1))
    right = F.concat(F.slice(order, 2, n), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    twins = F.zip_with(order, left, lambda x, y: F.struct(x["h"].alias("h"), x["i"].alias("i"), x["h"].eqNullSafe(y["h"]).alias("twin")))
    seen = F.zip_with(twins, right, lambda x, y: F.struct(x["i"].alias("i"), (x["twin"] | x["h"].eqNullSafe(y["h"])).alias("twin")))
    at = F.sort_array(F.transform(F.filter(seen, lambda x: x["twin"]), lambda x: x["i"]))
    return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
                       lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n"), i.alias("last")),
                       lambda a: a["n"])


def _by_language(lang: Column, what, none: Column) -> Column:
    out = none
    for code, common in COMMON.items():
        out = F.when(lang == code, what([F.xxhash64(F.lit(w)) for w in common])).otherwise(out)
    return out


def common_words(word_hashes: Column, lang: Column) -> Column:
    """Those hashes that belong to common words of the language."""
    return _by_language(lang, lambda hashes: F.filter(word_hashes, lambda h: h.isin(*hashes)), F.array().cast("array<bigint>"))


def common_counts(named: Column, lang: Column) -> Column:
    """How often each common word of the language is in ``named``."""
    count = lambda h: F.size(F.filter(named, lambda x: x == h)).cast("long")
    return _by_language(lang, lambda hashes: F.array(*[count(h) for h in hashes]), F.array().cast("array<bigint>"))


def measures(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Add ``_f``: the base counts, the class histogram and the common-word
    histogram of each text."""
    t = F.col("_t")
    df = df.withColumn("_t", whole(F.col(f"`{text}`"))).withColumn("_w", words(t))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    n, word_hashes = F.size("_h"), F.col("_h")
    windows = F.transform(word_hashes, lambda h, i: F.xxhash64(h, *[F.get(word_hashes, i + k) for k in range(1, WINDOW)]))
    df = df.withColumn("_win", F.when(n > WINDOW, F.slice(windows, 1, n - WINDOW + 1)).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    df = df.withColumns({
        "_lines": lines,
        "_twice": F.size(F.array_distinct("_win")) < F.size("_win"),
        "_rest": F.regexp_replace(t, "[a-z]+", ""),
    })
    df = df.withColumn("_caseless", F.regexp_replace("_rest", "[A-Z]+", ""))
    spaces, symbols = count_chars(F.col("_caseless"), "\t\n\x0b\x0c\r "), count_chars(F.col("_caseless"), SYMBOLS)
    df = df.withColumns({
        "_spaces": spaces, "_symbols": symbols,
        "_digits": (F.length("_caseless") - F.length(F.regexp_replace("_caseless", "[0-9]+", ""))).cast("long"),
        "_wide": F.length(F.regexp_replace("_caseless", r"[\x00-\x7F]+", "")).cast("long"),
        "_named": common_words(F.col("_h"), F.col(f"`{lang}`")),
    })
    c = F.col
    lower = (F.length(t) - F.length("_rest")).cast("long")
    upper = (F.length("_rest") - F.length("_caseless")).cast("long")
    other = F.length("_caseless").cast("long") - c("_spaces") - c("_symbols") - c("_digits") - c("_wide")
    return df.withColumn("_f", F.struct(
        F.size("_w").cast("long").alias("n_words"),
        (F.length(t).cast("long") - c("_spaces")).alias("word_chars"),
        c("_symbols").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(c("_twice"), repeated_words(c("_h"), c("_win"))).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.length(t).cast("long").alias("n_chars"),
        F.array(lower, upper, c("_digits"), c("_spaces"), c("_symbols"), other, c("_wide")).alias("chars"),
        common_counts(c("_named"), F.col(f"`{lang}`")).alias("common"),
    )).drop("_t", "_w", "_h", "_win", "_lines", "_twice", "_rest", "_caseless", "_spaces", "_symbols", "_digits", "_wide", "_named")


def base_failed(f: Column) -> Column:
    return (f["n_words"] < LEAST_WORDS) | (100 * f["n_repeat_words"] > MOST_REPEATED * f["n_words"])


def with_rest(common: Column, n_words: Column) -> Column:
    """The common-word counts followed by the count of all other words."""
    named = F.aggregate(common, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(common) > 0, F.concat(common, F.array(n_words - named))).otherwise(common)


def shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: F.try_divide(x.cast("double"), total.cast("double")))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of equal length, given as
    shares: 0 if alike, 1 if nothing is in common; null if one is empty."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.get(p, F.lit(0)).isNotNull() & F.get(q, F.lit(0)).isNotNull(), F.sqrt(F.greatest(F.lit(0.0), total)))


def references(measured: DataFrame) -> DataFrame:
    """One row per language: summed histograms and words of its base-passing,
    long enough documents. Sums only, so a language of any size is combined in
    each task first."""
    longest = max(map(len, COMMON.values())) + 1
    f = F.col("f")
    good = measured.where(~base_failed(f) & (f["n_words"] >= MIN_WORDS)).withColumn("w", with_rest(f["common"], f["n_words"]))
    sums = good.groupBy("lang").agg(
        F.sum(f["n_words"]).alias("ref_words"), F.max(F.size("w")).alias("k"),
        *[F.sum(F.get(f["chars"], F.lit(i))).alias(f"c{i}") for i in range(7)],
        *[F.sum(F.get(F.col("w"), F.lit(i))).alias(f"w{i}") for i in range(longest)])
    chars = F.array(*[f"c{i}" for i in range(7)])
    common = F.slice(F.array(*[f"w{i}" for i in range(longest)]), 1, F.col("k"))
    return sums.select(
        "lang", "ref_words", shares(chars, sum(F.col(f"c{i}") for i in range(7))).alias("ref_chars"),
        shares(common, F.col("ref_words")).alias("ref_common"))


def compare(measured: DataFrame, good: DataFrame) -> DataFrame:
    """Add the distances of each document to the references of ``good``."""
    f = F.col("f")
    known = fitted(references(good).withColumnRenamed("lang", "_lang"), MOST_LANGUAGES)
    both = measured.join(known, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    judged = (f["n_words"] >= MIN_WORDS) & (F.coalesce("ref_words", F.lit(0)) >= MIN_REFERENCE)
    return both.withColumns({
        "char_distance": F.when(judged, distance(shares(f["chars"], f["n_chars"]), F.col("ref_chars"))),
        "word_distance": F.when(judged, distance(shares(with_rest(f["common"], f["n_words"]), f["n_words"]), F.col("ref_common"))),
    }).drop("ref_words", "ref_chars", "ref_common")


def near_enough() -> Column:
    chars, common = F.coalesce("char_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    return ~((chars > MAX_CHAR) | ((chars > BOTH_CHAR) & (common > BOTH_WORD)))


def judge(measured: DataFrame) -> DataFrame:
    """``measured`` has ``lang`` and ``f``; adds distances and verdicts.

    Two rounds: documents far from the mean of all are left out of the
    references of the second round, so that junk does not pull them."""
    first = compare(measured.select("lang", "f"), measured.select("lang", "f")).where((F.coalesce("char_distance", F.lit(0.0)) <= FIRST_CHAR)).select("lang", "f")
    both = compare(measured, first).withColumn("base_failed", base_failed(F.col("f")))
    return both.withColumn("kept", ~F.col("base_failed") & near_enough())


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept and
    the two distances (to 6 places; null where a guard holds)."""
    # The measures are written once (a few numbers a document); references and verdicts both read them.
    small = materialize(measures(docs.select("doc_id", "text", "lang")).select("doc_id", "lang", F.col("_f").alias("f")), "quality")
    return judge(small).select("doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words",
                               "base_failed", "kept", *[(F.round(d, 6) + F.lit(0.0)).alias(d) for d in ("char_distance", "word_distance")])


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = measures(docs.select(row, F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("lang")), "t").select("row", "lang", F.col("_f").alias("f"))
    # Written once with the text: the references then read the measures only.
    kept = judge(materialize(rows, "quality")).where("kept")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
