"""Cases with values taken from the rules, one for each fault found before."""
import json

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from assaykit.functions.labels import normalize_label_strict
from assaykit.functions.mojibake import repair_column
from assaykit.operators import models, qc, splits
from assaykit.operators.rows import with_file_row_index, with_partition_row_index
from assaykit.sources import files


def test_numeric_summary_with_infinity_and_an_overflowing_range(spark):
    n = 100_001
    base = spark.range(n).select(F.col("id").cast("double").alias("v"))
    df = base.union(spark.createDataFrame([(float("inf"),), (-1.7e308,), (1.7e308,), (None,)], "v double"))
    got = qc.numeric_summary(df, "v").first()
    # Sorted: -1.7e308, 0 .. 100000, 1.7e308, inf: 100,004 values.
    assert (got.n, got.min, got.max) == (n + 3, -1.7e308, float("inf"))
    assert (got.q1, got.median, got.q3) == (24999.75, 50000.5, 75001.25)
    same = qc.numeric_summary(spark.createDataFrame([(float("inf"),)] * 3, "v double"), "v").first()
    assert same.median == float("inf")


def test_names_with_dots(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "Ã©", "x")], "`0.1 M PBS` int, `M.W.` string, `a b` string").write.parquet(path)
    df = with_file_row_index(spark.read.parquet(path))
    assert df.columns == ["0.1 M PBS", "M.W.", "a b", "source_row_index"]
    assert with_partition_row_index(df).columns[-1] == "row_index"
    fixed = repair_column(df, "M.W.")
    assert fixed.columns == df.columns and fixed.count() == 1


def test_mojibake_columns(spark):
    good = "难溶"
    bad = good.encode("gb18030").decode("latin-1")
    df = spark.createDataFrame([(1, bad), (2, good), (3, "plain"), (4, None), (5, bad), (6, "é")], "i int, t string")
    assert [r.t for r in repair_column(df, "t").orderBy("i").collect()] == [good, good, "plain", None, good, "é"]


def test_an_unseen_condition_is_all_zeros(spark):
    train = spark.createDataFrame([("a",), ("b",)], "solvent_norm string")
    stages = models.feature_stages("condition", True)
    model = Pipeline(stages=stages).fit(train)
    rows = model.transform(spark.createDataFrame([("a",), ("b",), ("zzz",)], "solvent_norm string")).orderBy("solvent_norm").collect()
    assert [r.features.toArray().tolist() for r in rows] == [[1, 0], [0, 1], [0, 0]]


def test_strict_labels(spark):
    rows = [("1", 1), ("1.0", 1), (" 0.0 ", 0), ("1e0", 1), ("1d", None), ("1.0f", None), ("0D", None), ("nan", None), ("2", None), ("Soluble", 1), ("not soluble", 0)]
    df = spark.createDataFrame(rows, "t string, want int").withColumn("got", normalize_label_strict("t"))
    assert df.where(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


def test_splits_keep_their_contract(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "record_id string")
    out = splits.assign_splits(ids("a", "b", "c"), ids("a"), ids("b"), ids("c"))
    splits.require_covered(out)
    with pytest.raises(KeyError):
        splits.require_covered(splits.assign_splits(ids("a", "z"), ids("a"), ids(), ids()))
    split = spark.createDataFrame([("a", 0, "train")], "record_id string, fold int, split string")
    assert splits.match_split(split, ids("a", "b")).count() == 1
    for s, r in ((split.union(split), ids("a")), (split, ids("a", "a"))):
        with pytest.raises(KeyError):
            splits.match_split(s, r)


def test_null_sequences_and_labels_stay(spark):
    rows = [(f"r{i}", None if i % 5 == 0 else f"S{i % 40}", f"c{i % 4}", None if i % 11 == 0 else i % 2) for i in range(200)]
    rec = spark.createDataFrame(rows, "record_id string, sequence string, solvent string, label int")
    assert splits.split_group_holdout(rec, 1).count() == 200
    assert splits.split_pair_holdout(rec, 1).count() == 200


def test_many_conditions(spark):
    rec = spark.range(60).select(F.col("id").cast("string").alias("record_id"), F.lit("AC").alias("sequence"), F.concat(F.lit("c"), F.lpad((F.col("id") % 20).cast("string"), 2, "0")).alias("solvent"), (F.col("id") % 2).cast("int").alias("label"))
    got = splits.split_leave_one_condition_out(rec)
    assert got.count() == 60 * 20
    assert got.where("fold = 19 and split = 'val'").select("solvent").distinct().first()[0] == "c00"


def test_json_keeps_nulls_and_drops_nan(spark, tmp_path):
    path = str(tmp_path / "j")
    df = spark.createDataFrame([(None, (float("nan"), 1.5), [float("inf"), 2.0], {"k": float("nan")})], "a string, s struct<x:double,y:double>, l array<double>, m map<string,double>")
    files.sink_json(df.coalesce(1), path)
    told = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert told == [{"a": None, "s": {"x": None, "y": 1.5}, "l": [None, 2.0], "m": {"k": None}}]


def test_json_documents(spark, tmp_path):
    cases = {"empty.json": ("", False), "array.json": ("[1,2]", True), "number.json": ("3", True), "object.json": ('{"a":\n 1}', True), "broken.json": ('{"a": [1', False)}
    for name, (text, _) in cases.items():
        (tmp_path / name).write_text(text)
    got = files.scan_json_validate(spark, [str(tmp_path / n) for n in cases]).collect()
    assert {r.file.rsplit("/", 1)[1]: r.valid for r in got} == {n: ok for n, (_, ok) in cases.items()}


def test_grid_keeps_going_after_an_error(spark, monkeypatch):
    from assaykit.functions.sequence import BASELINE_FEATURES
    feats = [f"cast(id % 7 as double) as {c}" for c in BASELINE_FEATURES]
    data = spark.range(60).selectExpr("cast(id as string) as record_id", "cast(id % 2 as int) as y", "concat('c', id % 3) as solvent_norm", *feats)
    assign = spark.range(60).selectExpr("cast(id as string) as record_id", "'p' as protocol", "0 as fold", "if(id < 40, 'train', 'test') as split")

    def fails(*a):
        raise RuntimeError("no fit")

    monkeypatch.setattr(models, "predict_stratified_dummy", fails)
    names = ["majority_class", "stratified_dummy"]
    rows = models.grid_results(data, assign, *models.evaluate_grid(data, assign, models=names)).collect()
    told = {r.model: r for r in rows}
    assert set(told) == set(names)
    assert told["majority_class"].error is None and (told["majority_class"].n_train, told["majority_class"].n_test) == (40, 20)
    assert "no fit" in told["stratified_dummy"].error and told["stratified_dummy"].accuracy is None


def test_null_and_empty_sequences_share_their_features(spark):
    """Both have the key of the empty text: one row of features, no copies."""
    from assaykit.operators.features import baseline_feature_table, with_baseline_features
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ACD"), (4, "ACD"), (5, None)], "id int, sequence string")
    assert baseline_feature_table(df, write=False).count() == 2
    assert "SortAggregate" not in baseline_feature_table(df, write=False)._jdf.queryExecution().toString()
    got = with_baseline_features(df)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4, 5]


def test_values_outside_a_set(spark):
    from assaykit.operators.audit import audit_binary_label, outside
    df = spark.createDataFrame([(0,), (1,), (2,), (None,), (-1,), (2,)], "y int")
    assert sorted(r.y for r in outside(df, "y", [0, 1]).collect()) == [-1, 2, 2]
    assert [r.n for r in audit_binary_label(df).collect()] == [3] and audit_binary_label(df.where("y < 2 and y >= 0")).count() == 0
