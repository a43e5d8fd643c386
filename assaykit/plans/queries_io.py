"""Source/sink, audit and model queries.

Queries that exercise files write their inputs (derived from the driver
tables) under the shared checkpoint folder first, then return the lazy
read-back."""
from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mojibake import repair_column
from ..functions.sequence import BASELINE_FEATURES
from ..operators import audit as A
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import splits as SP
from ..operators.features import with_features_of_texts
from ..operators.ingest import KEY
from ..session import materialize, scratch_path
from ..sources import files as IO
from ..sources.schema import dedupe_headers, normalize_header, resolve_roles
from . import fixtures as fx
from . import oracle as o
from .build import DatasetBuild
from .catalog import add
from .queries_metrics import results as metric_results
from .queries_sequence import BASE_SQL
from .queries_splits import (REC, SEED, group_holdout_sql, keyed, loco_sql, pair_holdout_sql, pair_kfold_sql,
                             records)

B = o.build_with


# ---------------------------------------------------------------------------
# 2.1 sources and sinks
# ---------------------------------------------------------------------------
def _raw_csv(spark, sf):
    raw = fx.wide_raw(spark, sf)
    # a second "Source " header: distinct for Spark, a duplicate once cleaned
    raw = raw.withColumn("Source ", F.col("Source"))
    path = scratch_path(spark, "raw_wide.csv")
    IO.write_csv(raw.drop("source_row_index"), path)
    return path


add("scan_csv_raw", lambda s, sf: IO.scan_csv_raw(s, _raw_csv(s, sf)))


def _headers(spark, sf):
    path = _raw_csv(spark, sf)
    hdr = IO.read_header(spark, path)
    norm = [normalize_header(h) for h in hdr]
    rows = list(zip(range(len(hdr)), hdr, norm, dedupe_headers(norm)))
    return spark.createDataFrame(rows, "position int, header string, normalized string, deduped string")


# What the header rules have to give, written out: (header, role or name, name without duplicates).
HEADERS = [(fx.H_SEQUENCE, "sequence", "sequence"), (fx.H_DIFF_PRED, "difficulty_prediction", "difficulty_prediction"),
           (fx.H_DIFF_SCORE, "difficulty_score", "difficulty_score"), (fx.H_MW, "mw", "mw"), (fx.H_QUANTITY, "quantity_delivered", "quantity_delivered"),
           (fx.H_HPLC, "hplc_result", "hplc_result"), *[(c, c, c) for c in fx.CONDITION_HEADERS], ("Source", "Source", "Source"), ("Source ", "Source", "Source__dup1")]


def values_sql(names: list[str], rows: list[tuple]) -> str:
    """A table of literal rows; a number is an INTEGER, a truth value a BOOLEAN."""
    def one(v):
        return str(v).upper() if isinstance(v, bool) else f"CAST({v} AS INTEGER)" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


add("header_normalize", lambda s, sf: _headers(s, sf).select("position", "header", "normalized"),
    values_sql(["position", "header", "normalized"], [(i, h, n) for i, (h, n, _) in enumerate(HEADERS)]))
add("header_dedupe", lambda s, sf: _headers(s, sf).select("position", "normalized", "deduped"),
    values_sql(["position", "normalized", "deduped"], [(i, n, u) for i, (_, n, u) in enumerate(HEADERS)]))


def _roles(spark, sf):
    rows = []
    for name, df in [("obs", fx.obs(spark, sf)), ("long", DatasetBuild.from_tables(spark, sf).long)]:
        for role, col in resolve_roles(df.columns).items():
            rows.append((name, role, col))
    return spark.createDataFrame(rows, "table_name string, role string, column_name string")


add("resolve_column_role", _roles, values_sql(["table_name", "role", "column_name"], [
    ("obs", "sequence", "sequence"), ("obs", "condition", "solvent"), ("obs", "label", "label"), ("obs", "record_id", "record_id"),
    ("long", "sequence", "sequence_clean"), ("long", "condition", "solvent_name"), ("long", "label", "y"), ("long", "record_id", "observation_id")]))

TYPED = T.StructType([T.StructField("record_id", T.StringType()),
                      T.StructField("solvent", T.StringType()),
                      T.StructField("label", T.IntegerType())])


def _typed(spark, sf):
    path = scratch_path(spark, "obs_typed.csv")
    IO.write_csv(fx.obs(spark, sf).select("record_id", "solvent", "label"), path)
    return IO.scan_csv_typed(spark, path, TYPED)


add("scan_csv_typed", _typed, f"SELECT record_id, solvent, label FROM ({fx.obs_sql()}) o")


def _split_file(spark, sf):
    path = scratch_path(spark, "pair_stratified_fold0.csv")
    IO.write_csv(SP.split_pair_holdout(records(spark, sf), SEED).select("record_id", "split"), path)
    return IO.scan_split_file(spark, path).select("record_id", "split", "fold")


add("scan_split_file", _split_file,
    f"SELECT record_id, split, fold FROM ({pair_holdout_sql()}) t")


def _protocols(spark, sf):
    rec = records(spark, sf)
    base = scratch_path(spark, "splits")
    # The other protocols know no groups, so the keys are joined for one of them.
    tables = {"pair_stratified_fold0": SP.split_pair_holdout(rec, SEED),
              "sequence_disjoint_fold0": SP.split_group_holdout(keyed(spark, sf, rec), SEED),
              "solvent_heldout_loso": SP.split_leave_one_condition_out(rec),
              "custom_kfold": SP.split_pair_kfold(rec, SEED)}
    paths = []
    for name, t in tables.items():
        p = f"{base}/{name}.csv"
        IO.write_csv(t.select("record_id", "fold", "split"), p)
        paths.append(p)
    df = IO.scan_split_files(spark, paths)
    return df.groupBy("split_file", "protocol").agg(F.count(F.lit(1)).alias("n_records"))


add("protocol_from_filename", _protocols,
    f"SELECT 'pair_stratified_fold0' AS split_file, 'pair-stratified' AS protocol, count(*) AS n_records "
    f"FROM ({pair_holdout_sql()}) a UNION ALL SELECT 'sequence_disjoint_fold0', 'sequence-disjoint', "
    f"count(*) FROM ({group_holdout_sql()}) b UNION ALL SELECT 'solvent_heldout_loso', "
    f"'solvent-held-out', count(*) FROM ({loco_sql()}) c UNION ALL SELECT 'custom_kfold', "
    f"'custom_kfold', count(*) FROM ({pair_kfold_sql()}) d")


def _json_files(spark, sf, build=None, rec=None):
    """A folder of JSON documents; of a dataset build and records that are made already, if given."""
    base = scratch_path(spark, "json")
    IO.sink_json((build or DatasetBuild.from_tables(spark, sf)).summary(), f"{base}/summary.json")
    rec = keyed(spark, sf, rec) if rec else records(spark, sf, True)
    rows = SP.split_summary(SP.split_pair_holdout(rec, SEED))  # three rows
    IO.sink_json(rows.agg(F.collect_list(F.struct(*rows.columns)).alias("splits")), f"{base}/splits_manifest.json")
    spark.createDataFrame([('{"broken": [1, 2',)], "value string").write.mode("overwrite") \
        .text(f"{base}/broken.json")
    return base


def _json_validate(spark, sf):
    base = _json_files(spark, sf)
    v = IO.scan_json_validate(spark, [f"{base}/summary.json", f"{base}/splits_manifest.json",
                                      f"{base}/broken.json"])
    return v.select(IO.split_name(F.col("file")).alias("name"),
                    F.regexp_extract("file", r"/([^/]+\.json)/", 1).alias("document"), "valid")


add("scan_json_validate", _json_validate, values_sql(["name", "document", "valid"], [
    ("", "summary.json", True), ("", "splits_manifest.json", True), ("", "broken.json", False)]))


def _inventory_root(spark, sf, build=None, rec=None):
    """A release folder; of a dataset build and records that are made already, if given."""
    base = scratch_path(spark, "release")
    b = build or DatasetBuild.from_tables(spark, sf)
    IO.sink_table(b.condition_summary(), f"{base}/data/processed/condition_summary.csv", "csv")
    IO.sink_table(b.condition_metadata_template(), f"{base}/data/processed/condition_metadata.csv", "csv")
    IO.sink_table(SP.split_pair_holdout(rec or records(spark, sf), SEED).select("record_id", "fold", "split"),
                  f"{base}/splits/pair_stratified_fold0.csv", "csv")
    return base


def _inventory(spark, sf):
    return IO.file_hash_inventory(spark, _inventory_root(spark, sf)).drop("path")


add("file_hash_inventory", _inventory)


def _checksums(spark, sf):
    root = _inventory_root(spark, sf)
    inv = IO.file_hash_inventory(spark, root)
    lines = inv.select(F.concat(F.col("sha256"), F.lit("  "), F.col("rel")).alias("value"))
    ck = scratch_path(spark, "checksums.sha256")
    lines.write.mode("overwrite").text(ck)
    return IO.checksum_verify(IO.read_checksums(spark, ck), inv)


add("checksum_verify", _checksums)


def _sink_table(spark, sf):
    path = scratch_path(spark, "long.parquet")
    IO.sink_table(DatasetBuild.from_tables(spark, sf).long, path)
    return spark.read.parquet(path)


add("sink_table", _sink_table, B("long") + "SELECT * FROM long", ["difficulty_score_num", "mw_num", "quantity_total_mg", "hplc_percent"])


def _sink_json(spark, sf):
    path = scratch_path(spark, "summary.json")
    IO.sink_json(DatasetBuild.from_tables(spark, sf).summary_document({"source": sf}, {"summary": path}), path)
    return spark.read.json(path).drop("read_info", "output_files")  # they name the run's folders


add("sink_json_summary", _sink_json)


def _mojibake(spark, sf):
    docs = fx.read(spark, sf, "documents").select("doc_id", "text")
    fixed = repair_column(docs.withColumn("text_fixed", F.col("text")), "text_fixed")
    return fixed.select("doc_id", (F.col("text_fixed") != F.col("text")).alias("changed"),
                        F.length("text_fixed").alias("n_chars_fixed"), "text_fixed")


add("mojibake_repair", _mojibake)

# ---------------------------------------------------------------------------
# 2.11 audit (long table of the build; expected numbers of the release)
# ---------------------------------------------------------------------------
E = A.RELEASE_EXPECTED


def _long(spark, sf):
    return DatasetBuild.from_tables(spark, sf).long


def _faulty_long(spark, sf, build=None):
    """The long table with faults planted: rows of one condition come twice,
    and half of those with a label that is neither 0 nor 1. The clean table is
    written and has the sequences' keys: texts are not written again for each
    condition, and counts do not read them."""
    lg = (build or DatasetBuild.from_tables(spark, sf)).cells.select("observation_id", "sequence_clean", "solvent_name", "y", "source_row_index", KEY)
    again = lg.where("source_row_index % 100 = 0 AND solvent_name = 'Lot note'")
    again = again.withColumn("y", F.when(F.col("source_row_index") % 200 == 0, 2).otherwise(F.col("y")))
    return lg, lg.unionByName(again).drop("source_row_index")


FAULTY = (B("long") + ", faulty AS (SELECT observation_id, y FROM long UNION ALL SELECT observation_id, "
          "CAST(CASE WHEN source_row_index % 200 = 0 THEN 2 ELSE y END AS INTEGER) AS y FROM long "
          "WHERE source_row_index % 100 = 0 AND solvent_name = 'Lot note') ")


def _f(check, sev, detail, n):
    return (f"SELECT '{check}' AS \"check\", '{sev}' AS severity, CAST({detail} AS VARCHAR) AS detail, "
            f"CAST({n} AS BIGINT) AS n")


# A long table that lacks two of the required columns.
add("audit_required_columns", lambda s, sf: A.audit_required_columns(_long(s, sf).drop("solvent_name", "y")),
    "SELECT 'required_columns' AS \"check\", 'error' AS severity, 'the long table has no column ' || c AS detail, "
    f"CAST(NULL AS BIGINT) AS n FROM (SELECT unnest({A.REQUIRED_LONG_COLUMNS!r}) AS c) r "
    f"WHERE c NOT IN (SELECT column_name FROM (DESCRIBE {B('long')} SELECT * EXCLUDE (solvent_name, y) FROM long))")
add("audit_row_count", lambda s, sf: A.audit_row_count(_long(s, sf), E["n_records"]),
    B("long") + f"SELECT * FROM ({_f('row_count', 'error', chr(39) + 'record count differs: ' + chr(39) + ' || CAST(n AS VARCHAR)', 'n')} "
    f"FROM (SELECT count(*) AS n FROM long)) t WHERE n <> {E['n_records']}")
add("audit_unique_key", lambda s, sf: A.audit_unique_key(_faulty_long(s, sf)[1]),
    FAULTY + f"SELECT * FROM ({_f('unique_key', 'error', chr(39) + 'values of observation_id repeat' + chr(39), 'n')} "
    f"FROM (SELECT count(*) AS n FROM (SELECT observation_id FROM faulty GROUP BY 1 HAVING count(*) > 1))) t "
    f"WHERE n > 0")
add("audit_distinct_counts",
    lambda s, sf: A.audit_distinct_counts(_long(s, sf), E["n_unique_sequences"], E["n_unique_solvents"]),
    B("long") + "SELECT * FROM (" + _f("distinct_sequences", "error",
                                       "'sequence count differs: ' || CAST(s AS VARCHAR)", "s")
    + f" FROM (SELECT count(DISTINCT sequence_clean) AS s FROM long)) a WHERE n <> {E['n_unique_sequences']} "
    "UNION ALL SELECT * FROM (" + _f("distinct_conditions", "error",
                                     "'condition count differs: ' || CAST(c AS VARCHAR)", "c")
    + f" FROM (SELECT count(DISTINCT solvent_name) AS c FROM long)) b WHERE n <> {E['n_unique_solvents']}")
add("audit_positive_rate", lambda s, sf: A.audit_positive_rate(_long(s, sf), E["positive_rate"]),
    B("long") + "SELECT \"check\", severity, detail, n FROM (" + _f(
        "positive_rate", "error", "'share of positives differs: ' || printf('%.12f', r)", "NULL")
    + f", r FROM (SELECT avg(CAST(y AS DOUBLE)) AS r FROM long)) t WHERE abs(r - {E['positive_rate']!r}) > 1e-12")
add("audit_binary_label", lambda s, sf: A.audit_binary_label(_faulty_long(s, sf)[1]),
    FAULTY + "SELECT * FROM (" + _f("binary_label", "error", "'y has values other than 0 and 1'", "n")
    + " FROM (SELECT count(*) AS n FROM faulty WHERE y IS NOT NULL AND y NOT IN (0, 1))) t WHERE n > 0")
add("value_subset", lambda s, sf: A.outside(_faulty_long(s, sf)[1], "y", [0, 1]).select("observation_id", "y"),
    FAULTY + "SELECT observation_id, y FROM faulty WHERE y NOT IN (0, 1)")


def _split_refs(spark, sf):
    lg = _long(spark, sf)
    own = SP.split_pair_holdout(lg.select(F.col("observation_id").alias("record_id"),
                                          F.col("sequence_clean").alias("sequence"),
                                          F.col("solvent_name").alias("solvent"),
                                          F.col("y").alias("label")), SEED)
    other = SP.split_pair_holdout(records(spark, sf), SEED)
    return A.audit_split_refs(lg, own, "own_split").unionByName(A.audit_split_refs(lg, other, "obs_split"))


add("audit_split_refs", _split_refs,
    B("long") + ", " + REC.replace("rec AS", "rec0 AS") + ", x AS (SELECT count(*) AS n FROM "
    "(SELECT DISTINCT record_id FROM rec0) r WHERE record_id NOT IN (SELECT observation_id FROM long)) "
    "SELECT * FROM (" + _f("split_refs", "error",
                           "'ids that the data lack: ' || CAST(n AS VARCHAR) || ' in split obs_split'", "n")
    + " FROM x) t WHERE n > 0")
add("anti_join_unknown_ids",
    lambda s, sf: A.unknown_ids(_long(s, sf), SP.split_pair_holdout(records(s, sf), SEED)),
    B("long") + f", t AS ({pair_holdout_sql()}) SELECT DISTINCT record_id FROM t WHERE record_id NOT IN "
                f"(SELECT observation_id FROM long)")
add("audit_result_rows", lambda s, sf: A.audit_result_rows(metric_results(s, sf)),
    _f("result_rows", "warning",
       f"'result table has ' || CAST(n AS VARCHAR) || ' rows instead of {A.EXPECTED_RESULT_ROWS}'", "n")
    + f" FROM (SELECT count(*) AS n FROM (SELECT DISTINCT fold FROM ({fx.scores_sql()}) s) f, "
      f"(SELECT DISTINCT model FROM ({fx.scores_sql()}) s2) m) t WHERE n <> {A.EXPECTED_RESULT_ROWS}")


# Expected numbers of the gate below. They differ from those of the tables, but for the conditions: every count is a finding.
GATE_EXPECTED = E | {"n_unique_solvents": 4}


def _release_gate(spark, sf):
    """The whole audit over a release folder written from the given tables, with
    faults planted: repeated ids and odd labels in the long table, a split with
    foreign ids, an empty split, a split without ids, a missing and an empty
    file, a broken document, too few results and an error row."""
    build, rec = DatasetBuild.from_tables(spark, sf), records(spark, sf)  # one of each for all parts
    root = _inventory_root(spark, sf, build, rec)
    spark.createDataFrame([], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/notes.md")
    lg, faulty = _faulty_long(spark, sf, build)
    ids = lg.select("observation_id")
    splits = {"own": ids, "foreign": ids.unionByName(fx.obs(spark, sf).select(F.col("record_id").alias("observation_id"))),
              "empty": ids.limit(0), "nameless": lg.select(F.col("y").alias("fold"))}
    base = _json_files(spark, sf, build, rec)
    documents = IO.scan_json_validate(spark, [f"{base}/summary.json", f"{base}/broken.json"]).withColumn("file", F.regexp_extract("file", r"([a-z]+\.json)", 1))
    files = A.audit_required_files(spark, root, ["data/processed/condition_summary.csv", "notes.md", "absent.csv"])
    errors = spark.createDataFrame([("pair-stratified", "no fit")], "protocol string, error string")
    return A.release_audit(faulty, splits, metric_results(spark, sf), errors, files, documents, GATE_EXPECTED)


def _release_gate_sql() -> str:
    def row(check, severity, detail, n):
        return f"SELECT '{check}' AS \"check\", '{severity}' AS severity, CAST({detail} AS VARCHAR) AS detail, CAST({n} AS BIGINT) AS n"
    counted = [("row_count", "record count", "r", E["n_records"]), ("distinct_sequences", "sequence count", "s", E["n_unique_sequences"]),
               ("distinct_conditions", "condition count", "c", GATE_EXPECTED["n_unique_solvents"])]
    parts = [row(k, "error", f"'{t} differs: ' || CAST({v} AS VARCHAR)", v) + f" FROM a WHERE {v} <> {w}" for k, t, v, w in counted]
    parts += [row("unique_key", "error", "'values of observation_id repeat'", "dup") + " FROM a WHERE dup > 0",
              row("binary_label", "error", "'y has values other than 0 and 1'", "odd") + " FROM a WHERE odd > 0",
              row("positive_rate", "error", "'share of positives differs: ' || printf('%.12f', rate)", "NULL") + f" FROM a WHERE abs(rate - {E['positive_rate']!r}) > 1e-12",
              row("split_refs", "error", "'ids that the data lack: ' || CAST(n AS VARCHAR) || ' in split foreign'", "n") + " FROM x WHERE n > 0",
              row("split_refs", "error", "'no rows in split empty'", "0"), row("split_refs", "error", "'no id column among [''fold''] of split nameless'", "NULL"),
              row("required_files", "error", "'file not found: absent.csv'", "NULL"), row("required_files", "warning", "'file without content: notes.md'", "0"),
              row("json", "error", "'no valid JSON: broken.json'", "NULL"), row("result_errors", "error", "'the error table has rows'", "1"),
              row("result_rows", "warning", f"'result table has ' || CAST(n AS VARCHAR) || ' rows instead of {A.EXPECTED_RESULT_ROWS}'", "n")
              + f" FROM (SELECT count(*) AS n FROM (SELECT DISTINCT fold, model FROM ({fx.scores_sql()}) s)) t WHERE n <> {A.EXPECTED_RESULT_ROWS}"]
    return (B("long") + ", f AS (SELECT observation_id, sequence_clean, solvent_name, y FROM long UNION ALL SELECT observation_id, sequence_clean, solvent_name, "
            "CASE WHEN source_row_index % 200 = 0 THEN 2 ELSE y END FROM long WHERE source_row_index % 100 = 0 AND solvent_name = 'Lot note'), "
            "a AS (SELECT count(*) AS r, count(observation_id) - count(DISTINCT observation_id) AS dup, count(DISTINCT sequence_clean) AS s, "
            "count(DISTINCT solvent_name) AS c, avg(CAST(y AS DOUBLE)) AS rate, count_if(y NOT IN (0, 1)) AS odd FROM f), "
            f"x AS (SELECT count(DISTINCT record_id) AS n FROM ({fx.obs_sql()}) o WHERE record_id NOT IN (SELECT observation_id FROM long)) "
            + " UNION ALL ".join(parts))


add("release_gate", _release_gate, _release_gate_sql())


def _required_files(spark, sf):
    root = _inventory_root(spark, sf)
    req = ["data/processed/condition_summary.csv", "data/processed/long.csv",
           "splits/pair_stratified_fold0.csv", "README.md"]
    return A.audit_required_files(spark, root, req)


add("audit_required_files", _required_files,
    _f("required_files", "error", "'file not found: data/processed/long.csv'", "NULL") + " UNION ALL "
    + _f("required_files", "error", "'file not found: README.md'", "NULL"))

# ---------------------------------------------------------------------------
# 2.9 models (train on the pair-stratified train split, score its test split)
# ---------------------------------------------------------------------------


def split_data(rec):
    """Narrow records with their pair-stratified split: all that models without
    sequence features read."""
    split = SP.split_pair_holdout(rec, SEED).select("record_id", "split", F.col("label").alias("y"))
    j = rec.select("record_id", SP.TEXT, "solvent").join(split, "record_id")
    return j.select("record_id", "split", "y", F.lower(F.trim("solvent")).alias("solvent_norm"), SP.TEXT)


def model_data(spark, sf):
    """Records with their pair-stratified split and the 54 model features
    (computed once per document that records refer to; no text is joined to
    the records, nor is one shuffled)."""
    rec = records(spark, sf)
    # Written, so that its size is known and the texts stay where they are read.
    refs = materialize(rec.select(SP.TEXT).distinct(), "referred")
    return with_features_of_texts(split_data(rec), fx.texts(spark, sf), refs, SP.TEXT)


def _parts(data):
    d = materialize(data, "model_data")
    return d.where(F.col("split") == "train"), d.where(F.col("split") == "test")


def _train_test(spark, sf):
    return _parts(model_data(spark, sf))


def _train_test_without_features(spark, sf):
    """Train and test rows for models that know conditions and labels; no text is read."""
    return _parts(split_data(records(spark, sf)).drop(SP.TEXT))


HOLD = f"WITH t AS ({pair_holdout_sql()}) "


def _bw(spark, sf):
    tr, _ = _train_test_without_features(spark, sf)
    return ML.balanced_weights(tr)


add("balanced_weights", _bw,
    HOLD + "SELECT label AS y, count(*) AS n_class, CAST((SELECT count(*) FROM t WHERE split = 'train') AS "
           "DOUBLE) / ((SELECT count(DISTINCT label) FROM t WHERE split = 'train') * count(*)) AS weight "
           "FROM t WHERE split = 'train' GROUP BY label", ["weight"])


def _majority(spark, sf):
    tr, te = _train_test_without_features(spark, sf)
    return ML.predict_majority(tr, te).select("record_id", "y_pred", "p")


add("model_majority", _majority,
    HOLD + ", m AS (SELECT label FROM t WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label "
           "LIMIT 1) SELECT record_id, CAST((SELECT label FROM m) AS INTEGER) AS y_pred, "
           "CAST((SELECT label FROM m) AS DOUBLE) AS p FROM t WHERE split = 'test'", ["p"])


def _dummy(spark, sf):
    tr, te = _train_test_without_features(spark, sf)
    return ML.predict_stratified_dummy(tr, te, SEED).select("record_id", "y_pred", "p")


_h01 = f"CAST(('0x' || substr(md5('dummy{SEED}|' || record_id), 1, 8))::UBIGINT AS DOUBLE) / 4294967296.0"
add("model_stratified_dummy", _dummy,
    HOLD + f", r AS (SELECT avg(CAST(label AS DOUBLE)) AS rate FROM t WHERE split = 'train') SELECT record_id, "
           f"CAST(CASE WHEN {_h01} < (SELECT rate FROM r) THEN 1 ELSE 0 END AS INTEGER) AS y_pred, "
           f"CAST(CASE WHEN {_h01} < (SELECT rate FROM r) THEN 1 ELSE 0 END AS DOUBLE) AS p FROM t "
           f"WHERE split = 'test'", ["p"])


def planted(columns: list[str]) -> list[str]:
    """SQL of the columns with every seventh record's value missing, for each
    column in other records."""
    return [f"CASE WHEN CAST(record_id AS BIGINT) % 7 = {i % 7} THEN NULL ELSE {c} END AS {c}" for i, c in enumerate(columns)]


def _numeric_stages(spark, sf, scaled: bool):
    """The 54 features of the test records after the numeric stages, fitted on
    the training records, with missing values planted in both."""
    d = materialize(model_data(spark, sf).selectExpr("record_id", "split", *planted(BASELINE_FEATURES)), "model_data")
    tr, te = d.where("split = 'train'"), d.where("split = 'test'")
    imputer = ML.imputer_stage(BASELINE_FEATURES).fit(tr)
    out = imputer.transform(te)
    if scaled:
        out = ML.scaler_stage(BASELINE_FEATURES).fit(imputer.transform(tr)).transform(out)
    return out.select("record_id", *[F.col(f"{c}__{'std' if scaled else 'imp'}").alias(c) for c in BASELINE_FEATURES])


def _numeric_stages_sql(scaled: bool) -> str:
    def each(form: str) -> str:
        return ", ".join(form.format(c=c) + f" AS {c}" for c in BASELINE_FEATURES)
    return (HOLD + f", b AS ({BASE_SQL} SELECT * FROM b2), p AS (SELECT b.record_id, t.split, {', '.join(planted(BASELINE_FEATURES)).replace('CAST(record_id', 'CAST(b.record_id')} "
            f"FROM b JOIN t ON t.record_id = b.record_id), m AS (SELECT {each('quantile_cont({c}, 0.5)')} FROM p WHERE split = 'train'), "
            f"i AS (SELECT p.record_id, p.split, {each('coalesce(p.{c}, m.{c})')} FROM p, m)"
            + (f", a AS (SELECT {each('avg({c})')} FROM i WHERE split = 'train'), d AS (SELECT {each('stddev_pop({c})')} FROM i WHERE split = 'train') "
               f"SELECT i.record_id, {each('(i.{c} - a.{c}) / CASE WHEN d.{c} = 0 THEN 1 ELSE d.{c} END')} FROM i, a, d WHERE split = 'test'"
               if scaled else " SELECT * EXCLUDE (split) FROM i WHERE split = 'test'"))


add("ml_impute_median", lambda s, sf: _numeric_stages(s, sf, False), _numeric_stages_sql(False), BASELINE_FEATURES)
add("ml_standardize", lambda s, sf: _numeric_stages(s, sf, True), _numeric_stages_sql(True), BASELINE_FEATURES)


# One row per test record and place of its vector: the 54 numbers first, then one place per condition of the training
# rows in order. The encoder has not seen 'view', which is left out of the training rows.
UNSEEN = "view"
SEEN_SQL = f"k AS (SELECT solvent_norm AS c, row_number() OVER (ORDER BY solvent_norm) - 1 AS i FROM (SELECT DISTINCT lower(trim(solvent)) AS solvent_norm FROM t WHERE split = 'train') g WHERE solvent_norm <> '{UNSEEN}')"
ONE_HOT_SQL = "CAST(i + {shift} AS INTEGER) AS place, CAST(CASE WHEN lower(trim(solvent)) = c THEN 1 ELSE 0 END AS DOUBLE) AS value"


def _vectors(spark, sf, mode, scaled):
    tr, te = (_train_test_without_features if mode == "condition" else _train_test)(spark, sf)
    model = Pipeline(stages=ML.feature_stages(mode, scaled)).fit(tr.where(F.col("solvent_norm") != UNSEEN))
    return model.transform(te).select("record_id", F.posexplode(vector_to_array("features")).alias("place", "value"))


def _feature_modes_sql() -> str:
    cols = BASELINE_FEATURES
    each = [f"(x.{c} - a.m_{c}) / CASE WHEN a.d_{c} = 0 THEN 1 ELSE a.d_{c} END" for c in cols]
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in cols)
    return (HOLD + f", b AS ({BASE_SQL} SELECT * FROM b2), x AS (SELECT b.*, t.split FROM b JOIN t ON t.record_id = b.record_id), {SEEN_SQL}, "
            f"a AS (SELECT {stats} FROM x WHERE split = 'train' AND lower(trim(solvent)) <> '{UNSEEN}'), "
            f"v AS (SELECT record_id, [{', '.join(each)}] AS nums FROM x, a WHERE split = 'test') "
            f"SELECT record_id, CAST(generate_subscripts(nums, 1) - 1 AS INTEGER) AS place, unnest(nums) AS value FROM v "
            f"UNION ALL SELECT record_id, {ONE_HOT_SQL.format(shift=len(cols))} FROM t, k WHERE split = 'test'")


add("ml_one_hot", lambda s, sf: _vectors(s, sf, "condition", False),
    HOLD + f", {SEEN_SQL} SELECT record_id, {ONE_HOT_SQL.format(shift=0)} FROM t, k WHERE split = 'test'", ["value"])
add("ml_feature_modes", lambda s, sf: _vectors(s, sf, "both", True), _feature_modes_sql(), ["value"])


def _model(name):
    def q(spark, sf):
        tr, te = (_train_test_without_features if ML.MODEL_MODES[name][0] == "condition" else _train_test)(spark, sf)
        return ML.fit_predict(name, tr, te, ML.ModelParams()).select("record_id", "y", "y_pred", "p")
    return q


add("model_logistic_sequence", _model("sequence_logistic"))
add("model_logistic_condition", _model("solvent_logistic"))
add("model_logistic_both", _model("sequence_solvent_logistic"))
add("model_random_forest", _model("sequence_solvent_random_forest"))
add("model_gradient_boosting", _model("sequence_solvent_gradient_boosting"))


def _positive_probability(spark, sf):
    """P(1) of the test records by a model that knows both labels, and by
    models trained on one label alone."""
    tr, te = _train_test_without_features(spark, sf)
    out = []
    for name, rows in (("both", tr), ("0", tr.where("y = 0")), ("1", tr.where("y = 1"))):
        got = ML.fit_predict("solvent_logistic", rows, te, ML.ModelParams())
        out.append(got.select(F.lit(name).alias("trained_on"), "record_id", "y", "y_pred", "p"))
    return out[0].unionByName(out[1]).unionByName(out[2])


add("positive_probability", _positive_probability)


def _grid(spark, sf):
    rec = records(spark, sf, True)
    hold = SP.split_pair_holdout(rec, SEED).select("record_id", F.lit("pair-stratified").alias("protocol"),
                                                     "fold", "split")
    grp = SP.split_group_holdout(rec, SEED).select("record_id", F.lit("sequence-disjoint").alias("protocol"),
                                                     "fold", "split")
    loco = SP.split_leave_one_condition_out(rec).select(
        "record_id", F.lit("solvent-held-out").alias("protocol"), "fold", "split")
    # Written, for the grid and its sizes read it several times.
    assign = materialize(hold.unionByName(grp).unionByName(loco), "assignments")
    model_tbl = materialize(model_data(spark, sf).drop("split"), "model_data")
    return ML.grid_results(model_tbl, assign, *ML.evaluate_grid(model_tbl, assign, ML.ModelParams()))


add("evaluate_grid", _grid)
