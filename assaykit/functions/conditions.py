"""Condition (test-column) rules: name hints and keyword class flags."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _c

# ---------------------------------------------------------------------------
# Fixed values (must equal the source semantics)
# ---------------------------------------------------------------------------
# A column whose lower-cased name holds one of these is a condition column.
CONDITION_HINTS = ["water", "ultrapure", "dpbs", "pbs", "dmso", "hcooh", "formic", "saline",
                   "acetic", "ammonia", "buffer", "超纯水", "生理盐水", "甲酸", "乙酸", "醋酸", "氨水"]

# Metadata roles that are never condition columns.
META_COLUMNS = ["sequence", "difficulty_prediction", "difficulty_score", "mw",
                "quantity_delivered", "hplc_result"]

# Keyword rules, in source order: (class, keywords, flags set).
WATER_WORDS = ["water", "ultrapure", "超纯水"]
DPBS_WORDS = ["dpbs"]
PBS_WORDS = ["pbs"]
SALINE_WORDS = ["saline", "生理盐水"]
DMSO_WORDS = ["dmso"]
FORMIC_WORDS = ["hcooh", "formic", "甲酸"]
ACETIC_WORDS = ["acetic", "乙酸", "醋酸"]
AMMONIA_WORDS = ["ammonia", "氨水"]

PHYSICAL_COLUMNS = ["pH", "ionic_strength_M", "dielectric_constant", "kamlet_taft_alpha",
                    "kamlet_taft_beta", "kamlet_taft_pi_star", "hansen_delta_d",
                    "hansen_delta_p", "hansen_delta_h"]
TEMPLATE_NOTE = "manual fill if available"


def _any(low: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def condition_class_columns(name) -> list[Column]:
    """solvent_class and six 0/1 flags for a condition name.

    The source tests its keyword rules one after another with plain
    ``if``s (dpbs/pbs is an if/elif pair), so the *last* matching rule
    sets the class while the flags accumulate. A ``when`` chain in
    reverse rule order gives the same class."""
    low = F.lower(_c(name))
    water, dpbs = _any(low, WATER_WORDS), _any(low, DPBS_WORDS)
    pbs = ~dpbs & _any(low, PBS_WORDS)
    saline, dmso = _any(low, SALINE_WORDS), _any(low, DMSO_WORDS)
    formic, acetic = _any(low, FORMIC_WORDS), _any(low, ACETIC_WORDS)
    ammonia = _any(low, AMMONIA_WORDS)
    cls = (F.when(ammonia, "ammonia_water").when(acetic, "acetic_acid")
           .when(formic, "formic_acid").when(dmso, "dmso").when(saline, "saline")
           .when(dpbs, "dpbs").when(pbs, "pbs").when(water, "water").otherwise("unknown"))

    def flag(b, alias):
        return F.when(b, 1).otherwise(0).cast("int").alias(alias)

    return [
        cls.alias("solvent_class"),
        flag(water | dpbs | pbs | saline | acetic | ammonia, "is_aqueous"),
        flag(dpbs | pbs, "is_buffer"),
        flag(dpbs | pbs | saline, "is_salt_containing"),
        flag(dmso | formic, "is_organic"),
        flag(formic | acetic, "is_acidic_condition"),
        flag(ammonia, "is_basic_condition"),
    ]
