"""Registry of the checkable queries: one per operator key.

Each key pairs a Spark job (``(spark, sf_dir) -> DataFrame``, reading
the driver tables, whole tables and whole texts) with an independent
DuckDB SQL rendering over the same tables, or ``None`` where the job is
not expressible in SQL (rows-only check). Spark results pass through
:func:`finish`, which rounds DOUBLE columns to 6 places exactly as the
SQL side does, so the two can be compared value for value.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUND_DIGITS = 6


@dataclass
class Entry:
    key: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: list[str] = field(default_factory=list)


REGISTRY: dict[str, Entry] = {}


def finish(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(
                F.round(c.cast("double"), ROUND_DIGITS) + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def add(key: str, fn, sql: str | None = None, doubles: list[str] | None = None):
    REGISTRY[key] = Entry(key, fn, sql, list(doubles or []))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import queries as _q  # noqa: F401  (registers everything)

    def wrap(e: Entry):
        return lambda spark, sf_dir: finish(e.build(spark, sf_dir))
    return {k: wrap(e) for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    from . import queries as _q  # noqa: F401
    from .oracle import rnd
    return {k: rnd(e.sql, e.doubles) for k, e in REGISTRY.items() if e.sql is not None}
