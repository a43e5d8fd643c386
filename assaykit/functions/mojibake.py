"""Mojibake repair (GB18030 text mis-decoded as Latin-1), opt-in.

The rule needs strict codec errors, which Spark's native ``encode`` /
``decode`` do not give (they raise or substitute), so it runs as an
Arrow-batched pandas UDF. :func:`repair_column` applies it to the
*distinct* non-ASCII values of a column only and joins the fixes back,
so Python sees each distinct value once.
"""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (must equal the source semantics): see text.WEIRD_CHARS.
from .text import WEIRD_CHARS


_HAN = re.compile("[\u4e00-\u9fff]")
_ODD = re.compile("[" + re.escape("".join(WEIRD_CHARS)) + "]")


def _redecoded(text: str) -> str | None:
    """Latin-1 bytes read as GB18030, or None where either codec refuses."""
    try:
        return text.encode("latin-1").decode("gb18030")
    except UnicodeError:
        return None


def repaired(texts: pd.Series) -> pd.Series:
    """Each text, or what re-decoding makes of it where that has more Chinese
    characters net of odd ones."""
    other = texts.map(_redecoded, na_action="ignore")
    gain = pd.Series(0, index=texts.index)
    for sign, series in ((1, other), (-1, texts)):
        told = series.astype(object).where(series.notna(), "")
        gain += sign * (told.str.count(_HAN.pattern) - told.str.count(_ODD.pattern))
    return texts.where(~(other.notna() & (gain > 0)), other)


def fix_mojibake_text(text):
    """The rule for one value (headers, on the driver); others than strings
    are returned as they are."""
    return repaired(pd.Series([text], dtype=object)).iloc[0] if isinstance(text, str) else text


@F.pandas_udf(T.StringType())
def fix_mojibake(col: pd.Series) -> pd.Series:
    return repaired(col)


def repair_column(df: DataFrame, name: str) -> DataFrame:
    """Replace ``name`` by its repaired text. Only distinct values that
    hold a non-ASCII character go through Python; the fixes that change a
    value are joined back by its SHA-1 (ASCII text can never change)."""
    col = F.col(f"`{name}`")
    odd = df.select(col.alias("_orig")).where(F.col("_orig").rlike("[^\\x00-\\x7F]"))
    fixes = odd.groupBy(F.sha1("_orig").alias("_key")).agg(F.first("_orig").alias("_orig"))
    fixes = fixes.select("_key", "_orig", fix_mojibake(F.col("_orig")).alias("_fixed")).where("_fixed <> _orig").drop("_orig")
    cols = [F.coalesce(F.col("_fixed"), col).alias(name) if c == name else F.col(f"`{c}`") for c in df.columns]
    return df.join(fixes, F.sha1(col) == F.col("_key"), "left").select(*cols)
