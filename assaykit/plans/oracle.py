"""DuckDB CTEs mirroring the Spark build on the fixture tables."""
from __future__ import annotations

from ..functions.sequence import AMINO_ACIDS
from . import duck as d
from . import fixtures as fx

META = [("sequence", fx.H_SEQUENCE), ("difficulty_prediction", fx.H_DIFF_PRED),
        ("difficulty_score", fx.H_DIFF_SCORE), ("mw", fx.H_MW),
        ("quantity_delivered", fx.H_QUANTITY), ("hplc_result", fx.H_HPLC)]
OTHER = fx.CONDITION_HEADERS + [fx.H_SOURCE]
# Detected conditions of the fixture (name hints, or >= half the cells label-like).
CONDITIONS = ["Ultrapure water", "1X DPBS", "DMSO", "Saline", "Lot note"]
LONG_OPT = ["difficulty_prediction", "difficulty_score", "difficulty_score_num", "mw", "mw_num",
            "quantity_delivered", "quantity_total_mg", "hplc_result", "hplc_percent"]
CLEAN_COLS = (["source_row_index"] + [m for m, _ in META] + OTHER
              + ["sequence_raw", "sequence_clean", "sequence_id", "difficulty_score_num",
                 "mw_num", "quantity_total_mg", "hplc_percent"])


def raw_cte() -> str:
    return f"raw AS ({fx.wide_raw_sql()})"


def clean_cte() -> str:
    c0 = ", ".join([f"{d.clean_cell(d.qi(h))} AS {m}" for m, h in META]
                   + [f"{d.clean_cell(d.qi(h))} AS {d.qi(h)}" for h in OTHER])
    others = ", ".join(d.qi(h) for h in OTHER)
    return (f"clean0 AS (SELECT source_row_index, {c0} FROM raw),\n"
            f"clean AS (SELECT source_row_index, sequence, lower(trim(difficulty_prediction)) AS "
            f"difficulty_prediction, difficulty_score, mw, quantity_delivered, hplc_result, {others}, "
            f"sequence AS sequence_raw, {d.normalize_sequence('sequence')} AS sequence_clean, "
            f"{d.stable_id('pep', d.normalize_sequence('sequence'))} AS sequence_id, "
            f"{d.parse_number('difficulty_score')} AS difficulty_score_num, "
            f"{d.parse_number('mw')} AS mw_num, "
            f"{d.parse_quantity_mg('quantity_delivered')} AS quantity_total_mg, "
            f"{d.parse_number('hplc_result')} AS hplc_percent FROM clean0)")


def cells_cte(keep: list[str], name: str = "cells") -> str:
    parts = [f"SELECT {', '.join(keep)}, {d.lit(c)} AS solvent_name, {d.qi(c)} AS label_raw FROM clean"
             for c in CONDITIONS]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def long_cte() -> str:
    keep = ["source_row_index", "sequence_id", "sequence_raw", "sequence_clean"] + LONG_OPT
    slug = d.slugify("solvent_name")
    return (cells_cte(keep) + ",\n"
            f"labelled AS (SELECT *, {d.normalize_label('label_raw')} AS y FROM cells),\n"
            f"long AS (SELECT {d.stable_id('obs', 'sequence_id', slug, 'source_row_index')} AS "
            f"observation_id, source_row_index, sequence_id, sequence_raw, sequence_clean, "
            f"solvent_name, {slug} AS solvent_id, label_raw, CAST(y AS INTEGER) AS y, "
            f"{', '.join(LONG_OPT)} FROM labelled WHERE y IS NOT NULL)")


def feats_cte() -> str:
    st1 = ", ".join(d.peptide_stage1("sequence_clean"))
    st2 = ", ".join(d.peptide_stage2("sequence_clean"))
    order = (["length_raw", "is_canonical_aa", "noncanonical_symbols"]
             + [c for a in AMINO_ACIDS for c in (f"count_{a}", f"frac_{a}")])
    from ..functions.sequence import PEPTIDE_FEATURES
    return (
        "uniq AS (SELECT sequence_id, u.raw AS sequence_raw, u.clean AS sequence_clean FROM "
        "(SELECT sequence_id, arg_min({'raw': sequence_raw, 'clean': sequence_clean}, "
        "source_row_index) AS u FROM clean GROUP BY sequence_id)),\n"
        f"f1 AS (SELECT *, {st1} FROM uniq),\n"
        f"f2 AS (SELECT *, {st2} FROM f1),\n"
        f"feats AS (SELECT sequence_id, sequence_raw, sequence_clean, "
        f"{', '.join(PEPTIDE_FEATURES)} FROM f2)")


def build_with(*parts: str) -> str:
    """WITH clause of the build CTEs up to the named stage."""
    ctes = [raw_cte(), clean_cte()]
    if "long" in parts:
        ctes.append(long_cte())
    if "feats" in parts:
        ctes.append(feats_cte())
    return "WITH " + ",\n".join(ctes) + "\n"


def rnd(sql: str, cols: list[str]) -> str:
    """Round DOUBLE columns to 6 places (NaN -> null, -0 -> 0), matching
    the Spark side's finishing step."""
    if not cols:
        return sql
    rep = ", ".join(f"(CASE WHEN isnan({d.qi(c)}) THEN NULL ELSE round({d.qi(c)}, 6) + 0.0 END) "
                    f"AS {d.qi(c)}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) _r"
