"""Audits with planted faults, the choice among readings, manifests, descriptions."""
import pytest
from pyspark.sql import functions as F

from assaykit.operators import audit as A
from assaykit.plans import manifest
from assaykit.sources import files

LONG = "observation_id string, sequence_clean string, solvent_name string, y int"


def told(df):
    return {(r.check, r.severity, r.detail, r.n) for r in df.collect()}


def test_counting_checks_in_one_aggregate(spark):
    rows = [("a", "S", "w", 1), ("b", "S", "w", 0), ("b", "T", "d", 1), ("c", None, "d", 7), (None, "T", "d", None)]
    expected = {"n_records": 5, "n_unique_sequences": 2, "n_unique_solvents": 2, "positive_rate": 9 / 4}
    df = spark.createDataFrame(rows, LONG)
    assert told(A.counting_checks(df, expected)) == {("unique_key", "error", "values of observation_id repeat", 1), ("binary_label", "error", "y has values other than 0 and 1", 1)}
    got = told(A.counting_checks(df.limit(2).coalesce(1), expected))
    assert got == {("row_count", "error", "record count differs: 2", 2), ("distinct_sequences", "error", "sequence count differs: 1", 1),
                   ("distinct_conditions", "error", "condition count differs: 1", 1), ("positive_rate", "error", "share of positives differs: 0.500000000000", None)}
    plan = A.counting_checks(spark.read.parquet(_written(df, spark)), expected)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def _written(df, spark):
    from assaykit.session import scratch_path
    path = scratch_path(spark, "test_long")
    df.write.parquet(path)
    return path


def test_split_checks_in_one_join(spark):
    long = spark.createDataFrame([("a", "S", "w", 1), ("b", "S", "w", 0)], LONG)
    ids = lambda *v, name="record_id": spark.createDataFrame([(x,) for x in v], f"{name} string")
    splits = {"good": ids("a", "b", "a"), "bad": ids("a", "x", "y", "x", name="id"), "empty": ids(), "nameless": ids("a", name="other")}
    assert told(A.split_checks(long, splits)) == {
        ("split_refs", "error", "ids that the data lack: 2 in split bad", 2), ("split_refs", "error", "no rows in split empty", 0),
        ("split_refs", "error", "no id column among ['other'] of split nameless", None)}
    assert told(A.split_checks(long, {"nameless": splits["nameless"]})) == {("split_refs", "error", "no id column among ['other'] of split nameless", None)}


def test_required_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/full.csv").write_text("x")
    (tmp_path / "a/empty.csv").write_text("")
    got = told(A.audit_required_files(spark, str(tmp_path), ["a/full.csv", "a/empty.csv", "gone.md"]))
    assert got == {("required_files", "warning", "file without content: a/empty.csv", 0), ("required_files", "error", "file not found: gone.md", None)}


def test_gate_of_a_good_release(spark, tmp_path):
    long = spark.createDataFrame([("a", "S", "w", 1), ("b", "T", "d", 0)], LONG)
    (tmp_path / "s.json").write_text("{}")
    ok = files.scan_json_validate(spark, [str(tmp_path / "s.json")])
    gate = A.release_audit(long, {"s": long.select("observation_id")}, spark.range(3), spark.createDataFrame([], "e string"), A.audit_required_files(spark, str(tmp_path), ["s.json"]), ok,
                           {"n_records": 2, "n_unique_sequences": 2, "n_unique_solvents": 2, "positive_rate": 0.5}, 3)
    assert told(gate) == set()
    short = A.release_audit(long.drop("y"), {}, spark.range(3), spark.createDataFrame([], "e string"), A.audit_required_files(spark, str(tmp_path), ["s.json"]), ok, None, 3)
    assert told(short) == {("required_columns", "error", "the long table has no column y", None)}


def test_choice_among_readings(spark, tmp_path):
    (tmp_path / "semi.csv").write_text("Sequence;Water;M.W.\nAC;soluble;1,5\nAD;insoluble;2\n")
    (tmp_path / "latin.csv").write_bytes("Sequence,Gelöst in Wasser\nAC,soluble\nÄD,insoluble\n".encode("latin-1"))
    (tmp_path / "one.csv").write_text("only\n1\n")
    df, got = files.choose_read(spark, str(tmp_path / "semi.csv"))
    assert got == {"encoding": "UTF-8", "sep": ";", "n_cols": 3, "score": 3 + 100 + 10.0} and df.count() == 2
    df, got = files.choose_read(spark, str(tmp_path / "latin.csv"))
    assert got["encoding"] == "ISO-8859-1" and got["sep"] == "," and sorted(r.sequence for r in df.collect()) == ["AC", "ÄD"]
    assert files.choose_read(spark, str(tmp_path / "one.csv"))[1]["score"] == 1.0
    with pytest.raises(ValueError):
        files.choose_read(spark, str(tmp_path / "latin.csv"), encodings=["UTF-8"])


def test_split_of_large_files_and_descriptions(spark, tmp_path):
    (tmp_path / "splits").mkdir()
    path = tmp_path / "splits/pair_stratified.csv"
    path.write_text("record_id,split\n" + "".join(f"r{i},train\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        parts = files.scan_split_file(spark, str(path)).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts > 1
    (tmp_path / "LICENSE").write_text("x")
    got = {r.rel: r.description for r in files.file_hash_inventory(spark, str(tmp_path)).collect()}
    assert got == {"splits/pair_stratified.csv": "Split assignments or their manifest.", "LICENSE": "File of the release."}
    own = files.file_hash_inventory(spark, str(tmp_path), descriptions=[("LIC", "terms")]).where("rel = 'LICENSE'").first()
    assert own.description == "terms"


def test_manifest_and_metadata(spark):
    rec = spark.createDataFrame([("1", "S", "w", 1), ("2", "S", "d", 0), ("3", "T", "d", 1)], "record_id string, sequence string, solvent string, label int")
    roles = {"record_id": "observation_id", "sequence": "sequence_clean", "condition": "solvent_name", "label": "y"}
    m = manifest.split_manifest(rec, roles, 5, "long.csv", ["a.csv"]).first()
    assert (m.n_records, m.n_unique_sequences, m.n_unique_solvents, round(m.positive_rate, 6), m.seed, m.files) == (3, 2, 2, 0.666667, 5, ["a.csv"])
    assert m.detected_columns.asDict() == roles and m.created_at_utc[4] == "-"
    results = spark.createDataFrame([("m1", None), ("m2", "no fit"), ("m3", None)], "model string, error string")
    r = manifest.run_metadata(rec, results, roles, 5, "long.csv", "splits", ["m1", "m2", "m3"], []).first()
    assert (r.n_result_rows, r.n_error_rows, r.models, r.split_files) == (2, 1, ["m1", "m2", "m3"], [])
