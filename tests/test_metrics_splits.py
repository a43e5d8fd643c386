"""Metric edge cases and brute-force checks; split properties."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from assaykit.operators import metrics as M
from assaykit.operators import splits as SP


def scored(spark, rows):
    return spark.createDataFrame(rows, "g string, y int, y_pred int, p double")


def brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def brute_ap(ys, ps):
    P = sum(ys)
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(ps), reverse=True):
        tp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 1)
        fp = sum(1 for y, p in zip(ys, ps) if p >= t and y == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def test_auc_ap_match_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for g in ["a", "b"]:
        for _ in range(300):
            y = rnd.randint(0, 1)
            p = round(min(1.0, max(0.0, rnd.random() * 0.7 + 0.3 * y)), 2)   # many ties
            rows.append((g, y, int(p >= 0.5), p))
    out = {r["g"]: r for r in M.metric_table(scored(spark, rows), ["g"]).collect()}
    for g in ["a", "b"]:
        ys = [r[1] for r in rows if r[0] == g]
        ps = [r[3] for r in rows if r[0] == g]
        assert out[g]["roc_auc"] == pytest.approx(brute_auc(ys, ps), abs=1e-12)
        assert out[g]["average_precision"] == pytest.approx(brute_ap(ys, ps), abs=1e-12)


def test_single_class_edge_cases(spark):
    # all labels positive, every prediction positive, constant score
    rows = [("g", 1, 1, 1.0)] * 10
    r = M.metric_table(scored(spark, rows), ["g"]).first()
    assert r["roc_auc"] is None and r["average_precision"] is None
    assert r["mcc"] == 0.0 and r["kappa"] is None
    assert r["accuracy"] == 1.0 and r["balanced_accuracy"] == 1.0 and r["brier"] == 0.0


def test_threshold_metrics_known_values(spark):
    rows = ([("g", 1, 1, 0.9)] * 3 + [("g", 1, 0, 0.2)] * 1 + [("g", 0, 1, 0.7)] * 2
            + [("g", 0, 0, 0.1)] * 4)
    r = M.metric_table(scored(spark, rows), ["g"]).first()
    tp, fn, fp, tn = 3, 1, 2, 4
    assert r["precision"] == pytest.approx(tp / (tp + fp))
    assert r["recall"] == pytest.approx(tp / (tp + fn))
    assert r["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
    assert r["balanced_accuracy"] == pytest.approx((tp / 4 + tn / 6) / 2)
    mcc = (tp * tn - fp * fn) / ((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) ** 0.5
    assert r["mcc"] == pytest.approx(mcc)
    po = (tp + tn) / 10
    pe = ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / 100
    assert r["kappa"] == pytest.approx((po - pe) / (1 - pe))


def test_leaderboard_mean_and_sample_std(spark):
    rows = [("p", "m", f, 10, 5, 0.5, 0.5) + tuple([0.1 * (f + 1)] * 10) for f in range(3)]
    rows.append(("q", "m", 0, 10, 5, 0.5, 0.5) + tuple([0.7] * 10))
    cols = ("protocol string, model string, fold int, n_train long, n_test long, "
            "train_positive_rate double, test_positive_rate double, "
            + ", ".join(f"{m} double" for m in M.METRICS))
    s = {r["protocol"]: r for r in M.leaderboard_summary(spark.createDataFrame(rows, cols)).collect()}
    assert s["p"]["n_folds"] == 3
    assert s["p"]["f1_mean"] == pytest.approx(0.2)
    assert s["p"]["f1_std"] == pytest.approx(0.1)      # sample std of 0.1, 0.2, 0.3
    assert s["q"]["f1_std"] is None                     # one fold -> null


def test_allocation_rule_matches_published_sizes():
    # 4,405 records with 2,844 positives: test 661 (427/234), then val 661 (427/234).
    counts = [(0, 1561), (1, 2844)]
    n_test = 661
    assert SP.allocate(counts, n_test) == {0: 234, 1: 427}
    rest = [(0, 1561 - 234), (1, 2844 - 427)]
    assert SP.allocate(rest, 661) == {0: 234, 1: 427}


def test_split_properties(spark):
    rnd = random.Random(3)
    rows = [(str(i), f"SEQ{rnd.randint(0, 80)}", f"c{rnd.randint(0, 3)}", rnd.randint(0, 1))
            for i in range(1500)]
    rec = spark.createDataFrame(rows, "record_id string, sequence string, solvent string, label int")
    hold = SP.split_pair_holdout(rec, 2026).collect()
    assert sorted(r["record_id"] for r in hold) == sorted(r[0] for r in rows)      # a partition
    n = {k: sum(1 for r in hold if r["split"] == k) for k in ("train", "val", "test")}
    assert n["test"] == 225 and n["val"] == 225                                      # ceil(.15N), ceil(3N'/17)
    grp = SP.split_group_holdout(rec, 2026).collect()
    seq_split = {}
    for r in grp:
        seq_split.setdefault(r["sequence"], set()).add(r["split"])
    assert all(len(v) == 1 for v in seq_split.values())                             # disjoint sequences
    kf = SP.split_pair_kfold(rec, 2026).where(F.col("split") == "test").groupBy("record_id").count()
    assert kf.where("count != 1").count() == 0 and kf.count() == 1500               # tested once
    loco = SP.split_leave_one_condition_out(rec)
    assert loco.select("fold").distinct().count() == 4
    t0 = loco.where("fold = 0").select("heldout_test_solvent", "heldout_val_solvent").distinct().collect()
    assert [tuple(r) for r in t0] == [("c0", "c1")]
