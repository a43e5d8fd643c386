"""Query definitions for the registry (Spark job + DuckDB oracle SQL)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import sequence as S
from ..functions import text as X
from ..functions.conditions import condition_class_columns
from ..operators import qc
from ..operators.ingest import condition_candidates, detect_condition_columns, ingest_quality_score, q
from ..operators.prepare import drop_missing
from . import duck as d
from . import fixtures as fx
from . import oracle as o
from .build import DatasetBuild
from .catalog import add

B = o.build_with


def _build(spark, sf):
    return DatasetBuild.from_tables(spark, sf)


# ---------------------------------------------------------------------------
# 2.1 ingest and schema
# ---------------------------------------------------------------------------
CLEAN_DOUBLES = ["difficulty_score_num", "mw_num", "quantity_total_mg", "hplc_percent"]

add("ingest_wide", lambda s, sf: _build(s, sf).clean,
    B() + "SELECT * FROM clean", CLEAN_DOUBLES)


def _detect(spark, sf):
    b = _build(spark, sf)
    rows = [(x.column, x.n_label, x.n_nonempty, x.name_hint, x.label_hint, x.is_condition)
            for x in detect_condition_columns(b.clean)]
    schema = ("column_name string, n_label long, n_nonempty long, name_hint boolean, "
              "label_hint boolean, is_condition boolean")
    return spark.createDataFrame(rows, schema)


def _detect_sql():
    cands = [c for c in o.CLEAN_COLS if c not in ("sequence", "difficulty_prediction",
                                                   "difficulty_score", "mw", "quantity_delivered",
                                                   "hplc_result")]
    parts = []
    for c in cands:
        v = f"CAST({d.qi(c)} AS VARCHAR)"
        parts.append(f"SELECT {d.lit(c)} AS column_name, count({d.normalize_label(v)}) AS n_label, "
                     f"count({v}) AS n_nonempty FROM clean")
    body = " UNION ALL ".join(parts)
    return (B() + f", st AS ({body}) SELECT column_name, CAST(n_label AS BIGINT) AS n_label, "
            f"CAST(n_nonempty AS BIGINT) AS n_nonempty, {d.has_hint('column_name')} AS name_hint, "
            f"(n_nonempty > 0 AND n_label > 0 AND CAST(n_label AS DOUBLE) / n_nonempty >= 0.5) "
            f"AS label_hint, ({d.has_hint('column_name')} OR (n_nonempty > 0 AND n_label > 0 AND "
            f"CAST(n_label AS DOUBLE) / n_nonempty >= 0.5)) AS is_condition FROM st")


add("detect_condition_columns", _detect, _detect_sql())


def _quality(spark, sf):
    return ingest_quality_score(fx.wide_raw(spark, sf).drop("source_row_index"))


def _quality_sql():
    hdrs = [h for h, _ in fx.wide_cell_exprs()]
    lab = " + ".join(f"max(CASE WHEN {d.normalize_label(d.qi(h))} IS NOT NULL THEN 1 ELSE 0 END)"
                     for h in hdrs)
    from ..sources.schema import normalize_header
    weird = sum(sum(1 for ch in normalize_header(h) if ch in X.WEIRD_CHARS) for h in hdrs)
    has_seq = int("sequence" in [normalize_header(h) for h in hdrs])
    n = len(hdrs)
    return (f"WITH {o.raw_cte()} SELECT CAST({n} AS BIGINT) AS n_cols, CAST({has_seq} AS INTEGER) "
            f"AS has_sequence, CAST({lab} AS BIGINT) AS n_label_cols, "
            f"{float(n)} + {100.0 * has_seq} + CAST(({lab}) AS DOUBLE) * 10.0 - "
            f"CAST({weird} AS DOUBLE) * 0.1 AS score FROM raw")


add("ingest_quality_score", _quality, _quality_sql(), ["score"])

# ---------------------------------------------------------------------------
# 2.2 cleaning scalars (each over the raw wide table, all rows)
# ---------------------------------------------------------------------------
RAW_COLS = [h for h, _ in fx.wide_cell_exprs()]


def _raw_proj(fn_spark, fn_sql, cols, alias_fmt="{i}"):
    def spark_q(spark, sf):
        r = fx.wide_raw(spark, sf)
        return r.select("source_row_index",
                        *[fn_spark(q(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    sql = (f"WITH {o.raw_cte()} SELECT source_row_index, "
           + ", ".join(f"{fn_sql(d.qi(c))} AS c{i}" for i, c in enumerate(cols)) + " FROM raw")
    return spark_q, sql


for key, fs, fq in [("clean_text", X.clean_text, d.clean_text),
                    ("null_tokens", X.clean_cell, d.clean_cell)]:
    sq, sql = _raw_proj(fs, fq, RAW_COLS)
    add(key, sq, sql)

_cjk = _raw_proj(lambda c: X.cjk_count(c).cast("long"), lambda e: f"CAST({d.cjk_count(e)} AS BIGINT)",
                 RAW_COLS)
add("cjk_count", *_cjk)
_weird = _raw_proj(lambda c: X.weird_count(c).cast("long"),
                   lambda e: f"CAST({d.weird_count(e)} AS BIGINT)", RAW_COLS)
add("weird_count", *_weird)

add("normalize_sequence", *_raw_proj(X.normalize_sequence, d.normalize_sequence, [fx.H_SEQUENCE]))
add("normalize_label", *_raw_proj(L.normalize_label, d.normalize_label, fx.CONDITION_HEADERS + [fx.H_SOURCE]))
_pn_cols = [fx.H_DIFF_SCORE, fx.H_MW, fx.H_HPLC]
add("parse_number", *_raw_proj(X.parse_number, d.parse_number, _pn_cols), ["c0", "c1", "c2"])
add("parse_quantity_mg", *_raw_proj(X.parse_quantity_mg, d.parse_quantity_mg, [fx.H_QUANTITY]), ["c0"])
add("lower_trim_category", *_raw_proj(X.lower_trim, lambda e: f"lower(trim({e}))", [fx.H_DIFF_PRED]))
add("missing_sequence_flag", *_raw_proj(
    lambda c: X.missing_sequence_flag(X.normalize_sequence(X.clean_cell(c))),
    lambda e: f"CAST(CASE WHEN length({d.normalize_sequence(d.clean_cell(e))}) = 0 THEN 1 ELSE 0 END "
              f"AS INTEGER)", [fx.H_SEQUENCE]))


def _docs(spark, sf):
    return fx.read(spark, sf, "documents")


add("letters_only_sequence",
    lambda s, sf: _docs(s, sf).select("doc_id", X.letters_only_sequence("text").alias("letters")),
    f"SELECT doc_id, {d.letters_only('text')} AS letters FROM documents")
add("slugify",
    lambda s, sf: _docs(s, sf).select("doc_id", X.slugify("text").alias("slug_text"),
                                      X.slugify("source").alias("slug_source"),
                                      X.slugify("lang").alias("slug_lang")),
    f"SELECT doc_id, {d.slugify('text')} AS slug_text, {d.slugify('source')} AS slug_source, "
    f"{d.slugify('lang')} AS slug_lang FROM documents")
add("stable_id",
    lambda s, sf: _docs(s, sf).select(
        "doc_id", X.stable_id("pep", X.normalize_sequence("text")).alias("sequence_id"),
        X.stable_id("obs", "source", "lang", "doc_id").alias("observation_id")),
    f"SELECT doc_id, {d.stable_id('pep', d.normalize_sequence('text'))} AS sequence_id, "
    f"{d.stable_id('obs', 'source', 'lang', 'doc_id')} AS observation_id FROM documents")


def _obs(spark, sf):
    return fx.obs(spark, sf)


OBS = f"WITH obs AS ({fx.obs_sql()}) "
add("condition_norm",
    lambda s, sf: _obs(s, sf).select("record_id", X.lower_trim("solvent").alias("condition_norm")),
    OBS + "SELECT record_id, lower(trim(solvent)) AS condition_norm FROM obs")


def _strict(spark, sf):
    """Strict labels; one that is not understood raises, with examples."""
    out = _obs(spark, sf).select("record_id", "label_raw", L.normalize_label_strict("label_raw").alias("y"))
    L.require_labels(out, "label_raw", "y", "record_id")
    return out


add("normalize_label_strict", _strict,
    OBS + f"SELECT record_id, label_raw, CAST({d.normalize_label_strict('label_raw')} AS INTEGER) "
          f"AS y FROM obs")
add("filter_missing",
    lambda s, sf: drop_missing(_obs(s, sf), ["sequence", "solvent", "label"])[0]
    .select("record_id", "solvent", "label"),
    OBS + "SELECT record_id, solvent, label FROM obs WHERE sequence IS NOT NULL AND solvent IS NOT "
          "NULL AND label IS NOT NULL")


def _project(spark, sf):
    c = _build(spark, sf).clean
    want = ["sequence_id", "source_row_index", "hplc_percent", "not_a_column", "mw"]
    return c.select(*[w for w in want if w in c.columns])


add("project_reorder", _project,
    B() + "SELECT sequence_id, source_row_index, hplc_percent, mw FROM clean", ["hplc_percent"])


def _flags(spark, sf):
    b = _build(spark, sf)
    return b.condition_metadata_template()


_flag_cols = ", ".join(f"{e} AS {n}" for n, e in d.condition_class("solvent_name"))
_phys = ", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in
                  ["pH", "ionic_strength_M", "dielectric_constant", "kamlet_taft_alpha",
                   "kamlet_taft_beta", "kamlet_taft_pi_star", "hansen_delta_d", "hansen_delta_p",
                   "hansen_delta_h"])
_cond_values = " UNION ALL ".join(f"SELECT {i} AS solvent_order, {d.lit(c)} AS solvent_name"
                                  for i, c in enumerate(o.CONDITIONS))
add("condition_class_flags", _flags,
    B() + f", conds AS ({_cond_values}) SELECT solvent_name, {d.slugify('solvent_name')} AS solvent_id, "
          f"{_flag_cols}, {_phys}, 'manual fill if available' AS notes FROM conds "
          f"WHERE EXISTS (SELECT 1 FROM clean)")

# ---------------------------------------------------------------------------
# 2.4 reshape
# ---------------------------------------------------------------------------
LONG_DOUBLES = ["difficulty_score_num", "mw_num", "quantity_total_mg", "hplc_percent"]
add("wide_to_long", lambda s, sf: _build(s, sf).long, B("long") + "SELECT * FROM long", LONG_DOUBLES)
add("unknown_label_values", lambda s, sf: _build(s, sf).unknown_label_values(),
    B() + ", " + o.cells_cte(["source_row_index"]) +
    f" SELECT source_row_index AS row_index, solvent_name AS solvent_column, label_raw AS raw_value "
    f"FROM cells WHERE label_raw IS NOT NULL AND {d.normalize_label('label_raw')} IS NULL")

# ---------------------------------------------------------------------------
# 2.6 build QC tables
# ---------------------------------------------------------------------------
add("condition_summary", lambda s, sf: _build(s, sf).condition_summary(),
    B("long") + f", conds AS ({_cond_values}), agg AS (SELECT solvent_name, count(*) AS n_lab, "
    f"count_if(y = 1) AS n_sol, count_if(y = 0) AS n_ins, count(DISTINCT sequence_id) AS n_pep "
    f"FROM long GROUP BY solvent_name) SELECT c.solvent_name, {d.slugify('c.solvent_name')} AS "
    f"solvent_id, CAST(coalesce(n_lab, 0) AS BIGINT) AS n_labeled_records, CAST(coalesce(n_sol, 0) "
    f"AS BIGINT) AS n_soluble, CAST(coalesce(n_ins, 0) AS BIGINT) AS n_insoluble, CASE WHEN "
    f"coalesce(n_lab, 0) = 0 THEN NULL ELSE CAST(n_sol AS DOUBLE) / n_lab END AS positive_rate, "
    f"CAST((SELECT count(*) FROM clean) - coalesce(n_lab, 0) AS BIGINT) AS n_missing_cells, "
    f"CAST(coalesce(n_pep, 0) AS BIGINT) AS n_unique_peptides FROM conds c LEFT JOIN agg a "
    f"ON c.solvent_name = a.solvent_name", ["positive_rate"])

add("label_variability", lambda s, sf: _build(s, sf).label_variability(),
    B("long") + "SELECT any_value(sequence_id) AS sequence_id, sequence_clean, count(*) AS n_records, "
    "count(DISTINCT solvent_id) AS n_solvents_tested, CAST(count_if(y = 1) AS BIGINT) AS n_soluble, "
    "CAST(count_if(y = 0) AS BIGINT) AS n_insoluble, CAST(CASE WHEN count_if(y = 1) > 0 AND count_if(y = 0) > 0 THEN 1 ELSE 0 END "
    "AS INTEGER) AS has_discordant_solvent_labels FROM long GROUP BY sequence_clean")

DUP_SQL = ("SELECT sequence_clean, solvent_name, count(*) AS n_records, "
           "CAST(count(DISTINCT y) AS BIGINT) AS n_unique_labels, "
           "array_to_string(list_sort(list_distinct(list(CAST(y AS VARCHAR)))), ';') AS labels_observed, "
           "CAST(CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS INTEGER) AS has_duplicate, "
           "CAST(CASE WHEN count(DISTINCT y) > 1 THEN 1 ELSE 0 END AS INTEGER) AS has_conflict, "
           "string_agg(observation_id, ';' ORDER BY source_row_index) AS observation_ids "
           "FROM long GROUP BY sequence_clean, solvent_name")
add("duplicate_conflicts", lambda s, sf: _build(s, sf).duplicate_conflicts(), B("long") + DUP_SQL)

add("distinct_by_key",
    lambda s, sf: qc.distinct_by_key(_build(s, sf).clean, "sequence_id",
                                     ["sequence_raw", "sequence_clean"]),
    B("feats") + "SELECT sequence_id, sequence_raw, sequence_clean FROM uniq")

FEAT_DOUBLES = ([f"frac_{a}" for a in S.AMINO_ACIDS] + S.PEPTIDE_SCALARS
                + [f"{k}_{g}" for g in S.RESIDUE_GROUPS for k in ("count", "frac", "max_run")])
add("peptide_features", lambda s, sf: _build(s, sf).features, B("feats") + "SELECT * FROM feats",
    FEAT_DOUBLES)
add("sequence_qc", lambda s, sf: _build(s, sf).sequence_qc(),
    B("feats") + "SELECT sequence_id, sequence_raw, sequence_clean, length_raw, length, "
    "is_canonical_aa, noncanonical_symbols, CAST(CASE WHEN length(sequence_clean) = 0 THEN 1 "
    "ELSE 0 END AS INTEGER) AS missing_sequence FROM feats", ["length"])

MW_SQL = ("SELECT u.sequence_id, u.sequence_clean, u.mw, u.mw_num, f.mw_calc_avg, "
          "abs(u.mw_num - f.mw_calc_avg) AS mw_abs_diff FROM (SELECT sequence_id, x.clean AS "
          "sequence_clean, x.mw AS mw, x.mw_num AS mw_num FROM (SELECT sequence_id, arg_min({'clean': "
          "sequence_clean, 'mw': mw, 'mw_num': mw_num}, source_row_index) AS x FROM clean GROUP BY "
          "sequence_id)) u LEFT JOIN feats f ON u.sequence_id = f.sequence_id")
add("join_mw_check", lambda s, sf: qc.join_mw_check(_build(s, sf).clean, _build(s, sf).features),
    B("feats") + MW_SQL, ["mw_num", "mw_calc_avg", "mw_abs_diff"])
add("mw_discrepancies", lambda s, sf: _build(s, sf).mw_discrepancies(),
    B("feats") + MW_SQL, ["mw_num", "mw_calc_avg", "mw_abs_diff"])

add("join_long_features", lambda s, sf: _build(s, sf).features_for_model(),
    B("long", "feats") + "SELECT l.*, " + ", ".join(f"f.{c}" for c in S.PEPTIDE_FEATURES)
    + " FROM long l LEFT JOIN feats f ON l.sequence_id = f.sequence_id AND "
      "l.sequence_clean = f.sequence_clean", LONG_DOUBLES + FEAT_DOUBLES)


def _category(spark, sf):
    return qc.category_counts(_build(spark, sf).clean, "difficulty_prediction")


add("category_counts", _category,
    B() + "SELECT coalesce(difficulty_prediction, 'missing') AS value, count(*) AS count FROM clean "
          "GROUP BY 1")


def _numeric(spark, sf):
    return qc.numeric_summaries(_build(spark, sf).clean, ["mw_num", "quantity_total_mg", "hplc_percent"])


def _numeric_sql():
    parts = []
    for col in ["mw_num", "quantity_total_mg", "hplc_percent"]:
        parts.append(
            f"SELECT '{col}' AS column_name, count({col}) AS n, avg({col}) AS mean, "
            f"CASE WHEN count({col}) = 1 THEN 0.0 ELSE stddev_samp({col}) END AS std, "
            f"min({col}) AS min, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS median, "
            f"quantile_cont({col}, 0.75) AS q3, max({col}) AS max FROM clean")
    return B() + " UNION ALL ".join(parts)


add("numeric_summary", _numeric, _numeric_sql(), ["mean", "std", "min", "q1", "median", "q3", "max"])


def _summary(spark, sf):
    return _build(spark, sf).summary()


add("dataset_summary", _summary,
    B("long", "feats") + ", lv AS (SELECT sequence_clean, count(DISTINCT solvent_id) AS nsol, "
    "count_if(y = 1) AS p, count_if(y = 0) AS n FROM long GROUP BY sequence_clean), dc AS ("
    "SELECT count(*) AS c, count(DISTINCT y) AS u FROM long GROUP BY sequence_clean, solvent_name), "
    "unk AS (" + " UNION ALL ".join(
        f"SELECT {d.qi(c)} AS v FROM clean" for c in o.CONDITIONS) + ") SELECT "
    "(SELECT count(*) FROM clean) AS wide_peptide_rows, "
    "(SELECT count(*) FROM long) AS labeled_peptide_solvent_records, "
    "(SELECT count(DISTINCT sequence_id) FROM clean) AS unique_peptides_wide, "
    "(SELECT count(DISTINCT sequence_id) FROM long) AS unique_peptides_long, "
    f"CAST({len(o.CONDITIONS)} AS BIGINT) AS n_detected_solvent_columns, "
    "(SELECT count(DISTINCT solvent_id) FROM long) AS n_solvents_with_labels, "
    "CAST((SELECT count_if(y = 1) FROM long) AS BIGINT) AS n_soluble, CAST((SELECT count_if(y = 0) FROM long) AS BIGINT) AS n_insoluble, "
    "(SELECT avg(CAST(y AS DOUBLE)) FROM long) AS positive_rate, "
    "CAST((SELECT count_if(is_canonical_aa) FROM feats) AS BIGINT) AS canonical_sequence_count, "
    "CAST((SELECT count_if(NOT is_canonical_aa) FROM feats) AS BIGINT) AS noncanonical_or_missing_sequence_count, "
    "CAST((SELECT count_if(nsol >= 2) FROM lv) AS BIGINT) AS sequences_tested_in_multiple_solvents, "
    "CAST((SELECT count_if(p > 0 AND n > 0) FROM lv) AS BIGINT) AS sequences_with_discordant_solvent_labels, "
    "CAST((SELECT count_if(c > 1) FROM dc) AS BIGINT) AS duplicate_sequence_solvent_groups, "
    "CAST((SELECT count_if(u > 1) FROM dc) AS BIGINT) AS conflicting_sequence_solvent_groups, "
    f"(SELECT count(*) FROM unk WHERE v IS NOT NULL AND {d.normalize_label('v')} IS NULL) "
    "AS unknown_label_values_count", ["positive_rate"])

# Remaining families register themselves on import.
from . import queries_metrics, queries_sequence, queries_splits  # noqa: E402,F401
from . import queries_io  # noqa: E402,F401


def _row_index(spark, sf):
    """Position of each document in its source files (Parquet row index +
    per-file offsets; no sort, no single task)."""
    from ..operators.rows import with_file_row_index
    return with_file_row_index(fx.read(spark, sf, "documents").select("doc_id", "lang")) \
        .select("doc_id", "lang", "source_row_index")


add("row_index", _row_index,
    "SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS source_row_index "
    "FROM documents")
