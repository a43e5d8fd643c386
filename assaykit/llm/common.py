"""Column helpers shared by the operators: words, spans with code-point
positions, and joins against tables of a checked size."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Java regular expression of one separator run; words are what lies between.
SPACE = "\\x20\\x09-\\x0D"
_CHUNK = 256


def whole(text: Column) -> Column:
    """The text, a null read as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character left as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` in order."""
    flat = whole(text)
    for c in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(flat, " ", -1), "")


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars`` (ASCII, distinct)."""
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")


def running(items: Column, item_type: str, step: Callable[[Column, Column], Column], size: Callable[[Column], Column]) -> Column:
    """Array of ``step(offset, item)``, where ``offset`` is the sum of ``size``
    over the items before.

    The result is gathered in chunks, so an array of n items costs O(n) copies
    and not O(n^2)."""
    none = F.array().cast(f"array<{item_type}>")
    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(f"array<array<{item_type}>>").alias("done"), none.alias("cur"))

    def merge(a: Column, x: Column) -> Column:
        full = F.size(a["cur"]) >= _CHUNK
        return F.struct(
            (a["pos"] + size(x)).cast("long").alias("pos"),
            F.when(full, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]).alias("done"),
            F.concat(F.when(full, none).otherwise(a["cur"]), F.array(step(a["pos"], x).cast(item_type))).alias("cur"),
        )

    return F.aggregate(items, zero, merge, lambda a: F.flatten(F.concat(a["done"], F.array(a["cur"]))))


SPAN = "struct<start:bigint,end:bigint,value:string,before:string,after:string>"


def find_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]], context: int = 0) -> DataFrame:
    """Add one array column per pattern with its matches, leftmost and without
    overlaps: start and end in code points (end exclusive), the matched string
    and up to ``context`` characters on either side, as far as the next match
    of the same pattern.

    ``patterns`` maps the new column to (Java pattern, gate); a text whose gate
    is false has no match and is not searched. The matches come from
    ``regexp_extract_all`` and their places from the lengths of what ``split``
    leaves between them."""
    found, gaps = {}, {}
    for name, (pattern, gate) in patterns.items():
        t = F.when(gate, F.col(text)).otherwise(F.lit(""))
        found[f"_m_{name}"] = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    df = df.withColumns(found)
    for name, (pattern, _) in patterns.items():
        gaps[f"_g_{name}"] = F.when(F.size(f"_m_{name}") > 0, F.split(F.col(text), pattern, -1))
    df = df.withColumns(gaps)
    return df.withColumns({name: _placed(F.col(f"_m_{name}"), F.col(f"_g_{name}"), context) for name in patterns}).drop(*found, *gaps)


def _placed(matches: Column, gaps: Column, context: int) -> Column:
    """Spans of ``matches``, given the strings between them."""
    before = (lambda s: F.right(s, F.lit(context))) if context else (lambda s: F.lit(""))
    after = (lambda s: F.left(s, F.lit(context))) if context else (lambda s: F.lit(""))
    # Zipped, not indexed: a column named inside a lambda could be inlined there and computed for each match.
    pairs = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda x, b: F.struct(x.alias("value"), b.alias("gap")))
    items = F.zip_with(pairs, F.slice(gaps, 2, F.size(matches)), lambda p, a: F.struct(
        F.length(p["gap"]).alias("gap"), F.length(p["value"]).alias("n"), p["value"].alias("value"), before(p["gap"]).alias("before"), after(a).alias("after")))
    spans = running(
        items, SPAN,
        lambda pos, x: F.struct((pos + x["gap"]).alias("start"), (pos + x["gap"] + x["n"]).alias("end"), x["value"], x["before"], x["after"]),
        lambda x: x["gap"] + x["n"])
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def fitted(table: DataFrame, rows: int) -> DataFrame:
    """``table`` marked for broadcast if a count shows at most ``rows`` rows;
    otherwise as it is, for Spark to shuffle."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table
