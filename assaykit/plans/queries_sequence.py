"""Per-descriptor queries (2.3) over whole-document sequences.

Pool: for every document, its canonical-letter sequence (upper-cased
text with all but the 20 residue letters removed) and its cleaned raw
sequence (non-canonical), so both branches of every descriptor run.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions.text import letters_only_sequence, normalize_sequence
from ..operators.qc import features_of
from . import duck as d
from . import fixtures as fx
from .catalog import add

AA = S.AMINO_ACIDS


def pool(spark, sf):
    docs = fx.read(spark, sf, "documents").select("doc_id", "text")
    canon = docs.select("doc_id", F.lit("canonical").alias("kind"),
                        F.regexp_replace(F.upper("text"), f"[^{AA}]", "").alias("seq"))
    raw = docs.select("doc_id", F.lit("raw").alias("kind"), normalize_sequence("text").alias("seq"))
    return canon.unionByName(raw)


POOL_SQL = (f"pool AS (SELECT doc_id, 'canonical' AS kind, {d.rr(d.upper('text'), f'[^{AA}]', '')} AS seq "
            f"FROM documents UNION ALL SELECT doc_id, 'raw' AS kind, {d.normalize_sequence('text')} AS seq "
            f"FROM documents)")
FEAT_SQL = ("WITH " + POOL_SQL + f", f1 AS (SELECT *, {', '.join(d.peptide_stage1('seq'))} FROM pool), "
            f"f2 AS (SELECT *, {', '.join(d.peptide_stage2('seq'))} FROM f1) ")


def feats(spark, sf):
    return features_of(pool(spark, sf), "seq")


def _key(name, cols, doubles):
    add(name, lambda s, sf: feats(s, sf).select("doc_id", "kind", *cols),
        FEAT_SQL + f"SELECT doc_id, kind, {', '.join(cols)} FROM f2", doubles)


_key("is_canonical", ["is_canonical_aa"], [])
_key("noncanonical_symbols", ["noncanonical_symbols"], [])
_key("residue_counts", [c for a in AA for c in (f"count_{a}", f"frac_{a}")], [f"frac_{a}" for a in AA])
_key("length_stats", ["length_raw", "length"], ["length"])
_key("mol_weight", ["mw_calc_avg"], ["mw_calc_avg"])
_key("gravy", ["gravy", "hydropathy_std"], ["gravy", "hydropathy_std"])
_key("sequence_entropy", ["sequence_entropy", "sequence_entropy_norm20"],
     ["sequence_entropy", "sequence_entropy_norm20"])
_key("net_charge", ["net_charge_pH7", "abs_net_charge_pH7", "charge_per_residue_pH7"],
     ["net_charge_pH7", "abs_net_charge_pH7", "charge_per_residue_pH7"])
_key("isoelectric_point", ["pI_calc"], ["pI_calc"])
_key("max_run", [f"max_run_{g}" for g in S.RESIDUE_GROUPS], [f"max_run_{g}" for g in S.RESIDUE_GROUPS])
_gc = [f"{k}_{g}" for g in S.RESIDUE_GROUPS for k in ("count", "frac")]
_key("group_composition", _gc, _gc)
_key("fcr_ncpr", ["fcr", "ncpr"], ["fcr", "ncpr"])


# Model family over the long observation table: 54 features + condition.
def baseline(spark, sf):
    from ..operators.features import with_baseline_features
    o = fx.obs(spark, sf).select("record_id", "solvent", "sequence")
    return with_baseline_features(o).select("record_id", "solvent", *S.BASELINE_FEATURES)


BASE_SQL = (f"WITH o AS ({fx.obs_sql()}), b1 AS (SELECT record_id, solvent, "
            f"{', '.join(d.baseline_stage1(d.letters_only('sequence')))} FROM o), "
            f"b2 AS (SELECT record_id, solvent, {', '.join(d.baseline_stage2())} FROM b1) ")
add("baseline_features", lambda s, sf: baseline(s, sf).drop("solvent"),
    BASE_SQL + "SELECT * EXCLUDE (solvent) FROM b2", S.BASELINE_FEATURES)
add("feature_frame",
    lambda s, sf: baseline(s, sf).select("record_id", *S.BASELINE_FEATURES,
                                         F.lower(F.trim("solvent")).alias("solvent_norm")),
    BASE_SQL + f"SELECT record_id, {', '.join(S.BASELINE_FEATURES)}, lower(trim(solvent)) AS "
               f"solvent_norm FROM b2", S.BASELINE_FEATURES)
