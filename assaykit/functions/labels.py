"""Label rules as native ``when`` chains."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WS_CLASS, _c, clean_text

# ---------------------------------------------------------------------------
# Fixed values (must equal the source semantics)
# ---------------------------------------------------------------------------
# Lenient (wide-table) rule: compacted tokens that mean "no label".
LABEL_NULL_COMPACT = ["na", "nan", "none", "null", "n/a", "nt", "nottested", "/", "-"]
# Negative markers are tested before positive ones ("insoluble" holds "soluble").
LABEL_NEGATIVE_COMPACT = "insoluble"
LABEL_NEGATIVE_PHRASE = "not soluble"
LABEL_NEGATIVE_CJK = ["不溶", "难溶"]
LABEL_POSITIVE_COMPACT = "soluble"
LABEL_POSITIVE_CJK = ["可溶"]

# Strict (long-table) rule: exact words after strip + lower.
STRICT_POSITIVE = ["1", "true", "t", "yes", "y", "pos", "positive", "soluble", "sol", "s"]
STRICT_NEGATIVE = ["0", "false", "f", "no", "n", "neg", "negative", "insoluble", "insol", "i",
                   "not soluble", "non-soluble", "nonsoluble"]


PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"


def _spaced(word: str) -> str:
    """Pattern of a word that a compacted text holds: whitespace, '_' and '-'
    may stand between its letters."""
    return f"[{WS_CLASS}_-]*".join(word)


def normalize_label(x, cleaned: bool = False) -> Column:
    """Lenient label -> 1 / 0 / null (int).

    Substring rules, negatives first: ``not-soluble`` and ``slightly
    soluble`` give 1 (only ``not soluble`` with a space is negative).
    ``cleaned=True`` skips the (idempotent) text cleaning for cells that
    already went through :func:`clean_text`."""
    s = _c(x) if cleaned else clean_text(x)
    low = F.lower(s)
    # Most cells and all whole texts have no marker: one search tells. The negative words hold the positive one, and
    # no token of LABEL_NULL_COMPACT has a marker.
    marked = low.rlike(_spaced(LABEL_POSITIVE_COMPACT))
    for w in LABEL_NEGATIVE_CJK + LABEL_POSITIVE_CJK:
        marked = marked | s.contains(w)
    neg = low.rlike(_spaced(LABEL_NEGATIVE_COMPACT)) | low.contains(LABEL_NEGATIVE_PHRASE)
    for w in LABEL_NEGATIVE_CJK:
        neg = neg | s.contains(w)
    return F.when(marked, F.when(neg, F.lit(0)).otherwise(F.lit(1))).cast("int")


def normalize_label_strict(x) -> Column:
    """Strict label -> 1 / 0, null when unrecognised (callers reject nulls
    with :func:`require_labels`). Numeric columns pass 0/1 through."""
    c = _c(x)
    v = F.lower(F.regexp_replace(c.cast("string"), f"^[{WS_CLASS}]+|[{WS_CLASS}]+$", ""))
    # Only plain decimal or exponent notation is a number; the cast alone also takes suffixes as in 1d.
    num = F.when(v.rlike(PLAIN_NUMBER), v.try_cast("double"))
    none = F.lit(None).cast("int")
    return (F.when(c.isNull(), none)
            .when(v.isin(STRICT_POSITIVE), F.lit(1))
            .when(v.isin(STRICT_NEGATIVE), F.lit(0))
            .when(num == 1.0, F.lit(1))
            .when(num == 0.0, F.lit(0))
            .otherwise(none))


class LabelError(ValueError):
    pass


def require_labels(df: DataFrame, raw_col: str, label_col: str, id_col: str | None = None,
                   max_examples: int = 20) -> None:
    """Raise with the first examples when any strict label failed to parse.

    One aggregate pass counts the failures; only on failure are at most
    ``max_examples`` rows fetched (ordered by id when given)."""
    bad = df.filter(F.col(label_col).isNull())
    n_bad = bad.select(F.count(F.lit(1))).first()[0]
    if n_bad:
        cols = ([id_col] if id_col else []) + [raw_col]
        q = bad.select(*cols)
        if id_col:
            q = q.orderBy(id_col)
        examples = [tuple(r) for r in q.limit(max_examples).collect()]
        raise LabelError(
            f"{n_bad} labels are missing or not understood, such as {examples}")
