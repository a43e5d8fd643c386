"""Groups without lists, the nested summary, splits without texts, the ring of
conditions, and the first steps of a job."""
import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assaykit.functions.labels import LabelError
from assaykit.operators import qc, splits
from assaykit.operators.prepare import drop_missing, prepare_records
from assaykit.plans.build import DatasetBuild
from assaykit.sources import files

from .conftest import SF_SMALL


def _long(spark, rows):
    return spark.createDataFrame(rows, "source_row_index long, sequence_id string, sequence_clean string, solvent_name string, solvent_id string, y int, observation_id string")


def test_a_group_with_a_third_of_the_rows(spark, monkeypatch):
    """Ranks and id lists against plain lists, pieces included; no list of a group is aggregated in the child table."""
    monkeypatch.setattr(qc, "IDS_A_PIECE", 7)
    rnd = random.Random(4)
    rows = []
    for i in rnd.sample(range(900), 900):
        seq, cond = ("HOT", "water") if i % 3 == 0 else (f"S{i % 40}", f"c{i % 4}")
        rows.append((i, f"pep_{seq}", seq, cond, cond, 1 if seq != "HOT" else int(i % 2 == 0), f"obs_{i}"))
    long = _long(spark, rows).repartition(6)
    want = defaultdict(list)
    for r in sorted(rows):
        want[r[2], r[3]].append(r)
    got = {(r.sequence_clean, r.solvent_name): r for r in qc.duplicate_conflicts(long).collect()}
    assert set(got) == set(want)
    for k, own in want.items():
        r, labels = got[k], sorted({x[5] for x in own})
        assert r.observation_ids == ";".join(x[6] for x in own)
        assert (r.n_records, r.n_unique_labels, r.labels_observed, r.has_duplicate, r.has_conflict) == (len(own), len(labels), ";".join(map(str, labels)), int(len(own) > 1), int(len(labels) > 1))
    assert "collect_list" not in qc.group_members(long)._jdf.queryExecution().toString()
    plan = qc.duplicate_groups(long)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
    top = qc.top_conflicts(long, n=3).collect()
    assert top[0].sequence_clean == "HOT" and [r.observation_ids for r in top] == [got[r.sequence_clean, r.solvent_name].observation_ids for r in top]


def test_groupings_sort_no_text(spark):
    b = DatasetBuild.from_tables(spark, SF_SMALL)
    for df in (qc.peptide_features(b.keyed), b.label_variability(), qc.duplicate_groups(b.cells), b.summary()):
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()


def test_nested_summary(spark, tmp_path):
    b = DatasetBuild.from_tables(spark, SF_SMALL)
    files.sink_json(b.summary_document({"encoding": "utf-8"}, {"long": "x.parquet"}), str(tmp_path / "s"))
    (told,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "s")).collect()]
    flat = b.summary().first().asDict()
    assert told["label_counts"] == pytest.approx({"soluble": flat["n_soluble"], "insoluble": flat["n_insoluble"], "positive_rate": flat["positive_rate"]})
    assert all(told[k] == v for k, v in flat.items() if k not in ("n_soluble", "n_insoluble", "positive_rate"))
    assert told["detected_solvent_columns"] == b.conditions and len(b.conditions) == told["n_detected_solvent_columns"]
    clean = b.clean.select("mw_num", "difficulty_prediction", "sequence_id", "sequence_clean").collect()
    mw = sorted(r.mw_num for r in clean if r.mw_num is not None)
    assert (told["mw_input_stats"]["n"], told["mw_input_stats"]["min"], told["mw_input_stats"]["max"]) == (len(mw), mw[0], mw[-1])
    assert told["difficulty_prediction_counts"] == Counter(r.difficulty_prediction or "missing" for r in clean)
    lengths = [len(s) for s in {r.sequence_id: r.sequence_clean for r in clean}.values() if s and set(s) <= set("ACDEFGHIKLMNPQRSTVWY")]
    assert told["peptide_length_stats"]["n"] == len(lengths) and told["read_info"] == {"encoding": "utf-8"} and told["output_files"] == {"long": "x.parquet"}


def _records(spark, n=200):
    rows = [(f"r{i}", f"SEQ{i % 31}", f"c{i % 4}", i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "record_id string, sequence string, solvent string, label int")


def test_no_text_in_the_ranking_exchanges(spark):
    rec = _records(spark)
    for assign in (splits.holdout_assign(rec.select("record_id", "label"), "record_id", "label", 1),
                   splits.holdout_assign(splits._groups(rec, [1, 2]), "_seq_key", "group_label", 1, (F.col("_d0"), F.col("_d1"))).select("_seq_key", "split")):
        plan = assign._jdf.queryExecution().optimizedPlan().toString()
        moved = [line for line in plan.split("\n") if "Window" in line or "Aggregate" in line]
        assert moved and not any("sequence#" in line.split("sha1")[0].split("md5")[0] for line in moved if "Window" in line)


def test_ring_of_conditions(spark):
    rec = _records(spark)
    ring = [tuple(r) for r in splits.condition_ring(rec).orderBy("fold").collect()]
    assert ring == [(0, "c0", "c1"), (1, "c1", "c2"), (2, "c2", "c3"), (3, "c3", "c0")]
    plan = splits.split_leave_one_condition_out(rec)._jdf.queryExecution().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
    with pytest.raises(ValueError):
        splits.condition_ring(rec.where("solvent in ('c0', 'c1')"))


def test_dropped_rows_are_counted(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None), (None, None), (5, "e")], "`a.b` int, t string")
    kept, told = drop_missing(df, ["a.b", "t"])
    assert kept.count() == 2 and told.get == {"n_rows": 5, "n_dropped": 3}


def test_first_steps(spark):
    table = spark.createDataFrame([("AC", "Water", " Soluble "), ("AD", None, "1"), ("AE", "DMSO", "no"), ("AF", "DMSO", None)], "Sequence string, `Solvent Name` string, Label string")
    got, told = prepare_records(table)
    assert sorted(tuple(r)[1:] for r in got.collect()) == [("AC", "Water", 1), ("AE", "DMSO", 0)] and told.get["n_dropped"] == 2
    assert len({r.record_id for r in got.collect()}) == 2
    bad = table.union(spark.createDataFrame([("AG", "DMSO", "perhaps")], table.schema))
    with pytest.raises(LabelError, match="perhaps"):
        prepare_records(bad)
    assert {r.label for r in prepare_records(bad, strict=False)[0].collect()} == {0, 1, None}
