"""Cleaning scalars: ``Column -> Column`` functions, all JVM-side.

Every function here is a native Catalyst expression (regexp, translate,
sha1, transform/aggregate over arrays), so a projection that uses them
stays inside whole-stage codegen; no Python runs per row.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the source semantics)
# ---------------------------------------------------------------------------
# Cell values that mean "missing" after cleaning (exact, case-sensitive).
NULL_TOKENS = ["", "NA", "N/A", "na", "n/a", "NaN", "nan", "None", "none", "NULL", "null"]

# Characters typical of GB18030 text mis-decoded as Latin-1 ("weird" count).
WEIRD_CHARS = "ÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞß£¨©¼½º¬µý²âÏµÊýÁ¿Æ¬¶Î�"

# Unicode whitespace as Python's str.isspace() sees it. Written once so the
# same class works in Java regex (Spark) and RE2 (DuckDB oracle); plain
# ``\s`` misses nbsp/U+3000 in both engines.
WS_CLASS = (r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WS_RUN = f"[{WS_CLASS}]+"
# Whitespace runs other than one plain space. Texts are searched, not translated:
# translate() makes a string of every character, which on whole texts is most of a job. The
# lookaheads pass over printable ASCII with one test, before the long class is tried.
WS_OTHER = f"(?![!-~])(?: (?![!-~])(?=[{WS_CLASS}])|[{WS_CLASS}&&[^ ]])[{WS_CLASS}]*"
# Five characters that cleaning keeps together: no null token.
LONG_WORD = "[!-~]{5}"

# First decimal number in a text (ASCII digits).
NUMBER_PATTERN = r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?"

# One quantity term: optional "n*" multiplier, amount, optional unit.
QUANTITY_PATTERN = r"(?:([0-9]+(?:\.[0-9]+)?)\*)?([0-9]+(?:\.[0-9]+)?)(mg|ug|µg|μg|g)?"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(x) -> Column:
    """Drop U+FEFF, nbsp -> space, collapse whitespace runs, strip.

    Null stays null. Mojibake repair is a separate, opt-in Arrow UDF
    (:func:`assaykit.functions.mojibake.fix_mojibake`)."""
    c = _c(x)
    s = F.replace(c, F.lit("\ufeff"), F.lit(""))
    return F.trim(F.regexp_replace(s, WS_OTHER, " "))


def null_tokens(x) -> Column:
    """Exact missing-value tokens -> null (applied after :func:`clean_text`)."""
    c = _c(x)
    return F.when(c.isin(NULL_TOKENS), F.lit(None).cast("string")).otherwise(c)


def clean_cell(x) -> Column:
    """clean_text then null tokens: the per-cell step of wide ingest. Texts
    with a long word are no null token, and are cleaned once."""
    c = clean_text(x)
    return F.when(_c(x).rlike(LONG_WORD), c).otherwise(null_tokens(c))


def cjk_count(x) -> Column:
    """Number of characters in U+4E00..U+9FFF."""
    return F.regexp_count(_c(x), F.lit("[一-鿿]"))


def weird_count(x) -> Column:
    """Number of characters from :data:`WEIRD_CHARS`."""
    cls = "[" + WEIRD_CHARS + "]"
    return F.regexp_count(_c(x), F.lit(cls))


def normalize_sequence(x, cleaned: bool = False) -> Column:
    """clean_text, upper-case, drop all whitespace; null -> ''.
    ``cleaned=True`` skips the (idempotent) text cleaning."""
    c = _c(x) if cleaned else clean_text(x)
    # after clean_text the only whitespace left is the plain space
    return F.coalesce(F.replace(F.upper(c), F.lit(" "), F.lit("")), F.lit(""))


def letters_only_sequence(x) -> Column:
    """Upper-case and keep Unicode letters only; null -> ''."""
    return F.coalesce(F.regexp_replace(F.upper(_c(x)), r"[^\p{L}]", ""), F.lit(""))


def lower_trim(x) -> Column:
    """Lower-case and strip a category; null kept."""
    return F.lower(F.trim(_c(x)))


def parse_number(x) -> Column:
    """First decimal number in the cleaned text as double, else null
    (``'>95.3%'`` -> 95.3, ``'1,234'`` -> 1.0)."""
    m = F.regexp_extract(clean_text(x), NUMBER_PATTERN, 0)
    return F.when(m == "", F.lit(None).cast("double")).otherwise(m.try_cast("double"))


def parse_quantity_mg(x) -> Column:
    """Sum of ``n*amount unit`` terms in mg (unit mg/ug/g, default mg, n
    default 1); ``x`` and the times sign act as ``*``. Null when no term."""
    s = F.lower(clean_text(x))
    s = F.replace(F.replace(s, F.lit("×"), F.lit("*")), F.lit("x"), F.lit("*"))
    s = F.replace(s, F.lit(" "), F.lit(""))
    ns = F.regexp_extract_all(s, F.lit(QUANTITY_PATTERN), 1)
    amounts = F.regexp_extract_all(s, F.lit(QUANTITY_PATTERN), 2)
    units = F.regexp_extract_all(s, F.lit(QUANTITY_PATTERN), 3)
    terms = F.arrays_zip(ns.alias("n"), amounts.alias("a"), units.alias("u"))

    def step(acc, t):
        n = F.when(t["n"] == "", F.lit(1.0)).otherwise(t["n"].cast("double"))
        a = t["a"].cast("double")
        mg = (F.when(t["u"] == "g", a * 1000.0)
              .when(t["u"].isin("ug", "µg", "μg"), a / 1000.0)
              .otherwise(a))
        return acc + n * mg

    total = F.aggregate(terms, F.lit(0.0).cast("double"), step)
    return F.when(s.isNull() | (F.size(amounts) == 0), F.lit(None).cast("double")).otherwise(total)


def slugify(x) -> Column:
    """Identifier slug: cleaned lower text, ``%``->pct, ``+``->plus,
    non-[a-z0-9] runs -> ``_``, trimmed; empty -> unknown; leading digit
    -> ``s_`` prefix. Null input slugs the text 'None' (as ``str(None)``)."""
    s = F.lower(F.coalesce(clean_text(x), F.lit("None")))
    s = F.replace(F.replace(s, F.lit("%"), F.lit("pct")), F.lit("+"), F.lit("plus"))
    s = F.regexp_replace(s, "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    s = F.when(s == "", F.lit("unknown")).otherwise(s)
    return F.when(s.rlike("^[0-9]"), F.concat(F.lit("s_"), s)).otherwise(s)


def sha1_hex(x) -> Column:
    """Full 40-hex SHA-1 of the UTF-8 text (the internal, collision-safe key)."""
    return F.sha1(F.encode(_c(x), "UTF-8"))


def stable_id(prefix: str, *parts) -> Column:
    """``prefix_`` + first 12 hex digits of SHA-1 of the text; several parts
    are joined with ``|`` first (composite observation key)."""
    cols = [_c(p).cast("string") for p in parts]
    text = cols[0] if len(cols) == 1 else F.concat_ws("|", *cols)
    return F.concat(F.lit(prefix + "_"), F.substring(sha1_hex(text), 1, 12))


def missing_sequence_flag(x) -> Column:
    """1 when the cleaned sequence is null or empty, else 0."""
    c = _c(x)
    return F.when(c.isNull() | (F.length(c) == 0), 1).otherwise(0).cast("int")
