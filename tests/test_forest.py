"""Forests that score while they grow, against plain Python and across both ways of growing."""
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from assaykit.operators import forest as FO


def _rows(spark, n, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        x = [rnd.random(), float(rnd.randrange(3)), rnd.gauss(0, 1), 1.0]
        rows.append((str(i), int((x[0] > 0.4) == (x[1] < 2)) if rnd.random() < 0.95 else rnd.randrange(2), x))
    return spark.createDataFrame(rows, "record_id string, y int, x array<double>") \
        .select("record_id", "y", F.when(F.col("y") == 1, 0.9).otherwise(1.1).alias("weight"), array_to_vector("x").alias("features"))


def test_best_cut_against_all_cuts():
    rnd = np.random.default_rng(3)
    h, w = rnd.integers(0, 4, (2, 40, FO.BINS)).astype(float), (1.3, 0.8)
    h[:, 0] = 0
    gain, cut = FO.best_cut(h, w, 2)

    def impurity(c):
        a, b = c[0] * w[0], c[1] * w[1]
        return a + b - (a * a + b * b) / (a + b) if a + b else 0.0

    for i in range(40):
        told = []
        for k in range(FO.BINS - 1):
            left, right = h[:, i, :k + 1].sum(1), h[:, i, k + 1:].sum(1)
            if min(left.sum(), right.sum()) >= 2:
                told.append((impurity(h[:, i].sum(1)) - impurity(left) - impurity(right), -k))
        best = max(told, default=(0, 0))
        assert gain[i] == pytest.approx(max(best[0], 0)) and (gain[i] == 0 or cut[i] == -best[1])


def test_subtree_parts_all_rows():
    """Distinct rows with one label each, all drawn: leaves are pure, and the votes are the labels."""
    bins = np.array([[i // 8, i % 8] for i in range(64)], np.uint8)
    y = np.array([int(i % 8 > i // 8) for i in range(64)])
    counts = np.stack([2 * (1 - y), 2 * y], 1).astype(np.int32)
    got = FO.subtree(bins, counts, np.ones(64, bool), (1.0, 1.0), np.random.default_rng(1), 0, 30, 2)
    assert got.tolist() == y.tolist()
    shallow = FO.subtree(bins, counts, np.ones(64, bool), (1.0, 1.0), np.random.default_rng(1), 0, 0, 2)
    assert set(shallow) == {y.mean()}


def test_forest_learns_and_grows_alike(spark, monkeypatch):
    data = _rows(spark, 900)
    train, test = data.where("cast(record_id as int) % 5 > 0"), data.where("cast(record_id as int) % 5 = 0")

    def scored():
        return {r.record_id: (r.p, r.y_pred, r.y) for r in FO.score_forest(train, test, 40, 7, 30, 2).collect()}

    whole = scored()
    assert len(whole) == 180 and sum(a == b for _, a, b in whole.values()) > 155
    assert all(0 <= p <= 1 and a == int(p > 0.5) for p, a, _ in whole.values())
    # Large nodes split by histograms of all tasks give as good a forest, of the same draws.
    monkeypatch.setattr(FO, "LOCAL_ROWS", 100)
    apart = scored()
    assert apart.keys() == whole.keys() and sum(a == b for _, a, b in apart.values()) > 155
    assert np.mean([abs(whole[k][0] - apart[k][0]) for k in whole]) < 0.08


def test_few_values_are_all_cut(spark):
    df = spark.range(2000).select(F.array(F.when(F.col("id") == 7, 0.0).when(F.col("id") == 8, 1.5).otherwise(2.0), F.col("id").cast("double")).alias("x"))
    few, many = FO.cut_points(df, 2)
    assert few == [0.0, 1.5] and 20 < len(many) < FO.BINS
    got = df.select(FO.binned([few, many])("x").alias("b")).collect()
    assert [got[i].b[0] for i in (7, 8, 9)] == [0, 1, 2]


def test_large_leaf_is_not_gathered(spark, monkeypatch):
    """Rows that no cut divides stay by block, whatever their number; copies are one row with counts."""
    monkeypatch.setattr(FO, "LOCAL_ROWS", 20)
    data = spark.range(200).select(F.col("id").cast("string").alias("record_id"), F.lit(1).alias("y"), F.lit(1.0).alias("weight"), array_to_vector(F.array(F.col("id").cast("double"), F.lit(0.0))).alias("features"))
    got = FO.score_forest(data, data, 3, 1, 30, 2)
    assert got.where("p = 1 and y_pred = 1").count() == 200
    monkeypatch.setattr(FO, "LOCAL_ROWS", 100_000)
    assert FO.score_forest(data.withColumn("y", F.lit(0)), data, 3, 1, 30, 2).where("p = 0 and y_pred = 0").count() == 200


@pytest.mark.parametrize("summarized", [FO.SUMMARIZED, 0])
def test_counts_stand_for_rows(spark, monkeypatch, summarized):
    """A row with a count weighs as that many rows: the same cut points, draws and scores."""
    monkeypatch.setattr(FO, "SUMMARIZED", summarized)
    data = _rows(spark, 300)
    train, test = data.where("cast(record_id as int) % 3 > 0").coalesce(1), data.where("cast(record_id as int) % 3 = 0").coalesce(1)
    n = F.col("record_id").cast("int") % 3 + 1
    counted = train.withColumn("n", n.cast("long"))
    whole = train.withColumn("k", F.explode(F.sequence(F.lit(1), n))).drop("k")
    x = vector_to_array("features").alias("x")
    assert FO.cut_points(counted.select(x, "n"), 4) == FO.cut_points(whole.select(x), 4)
    a, b = ({r.record_id: (r.p, r.y_pred) for r in FO.score_forest(t, test, 10, 7, 30, 2).collect()} for t in (counted, whole))
    assert a == b and len(a) == 100


def test_cut_points_are_values_of_their_rank(spark, monkeypatch):
    monkeypatch.setattr(FO, "SUMMARIZED", 0)
    rnd = random.Random(2)
    values = [round(rnd.gauss(0, 1), 2) for _ in range(1000)]
    got = FO.cut_points(spark.createDataFrame([([v],) for v in values], "x array<double>"), 1)
    told = sorted(values)
    assert got == [sorted({told[-(-k * 1000 // FO.BINS) - 1] for k in range(1, FO.BINS)})]


def test_whole_trees_as_node_by_node():
    """Stretches of a level, and counts summed as one number or two, give one tree."""
    rnd = np.random.default_rng(8)
    bins, counts = rnd.integers(0, 9, (700, 12)).astype(np.uint8), rnd.poisson(0.8, (700, 2)).astype(np.int32)
    asked = rnd.random(700) < 0.8

    def votes():
        return FO.subtree(bins, counts, asked, (0.7, 1.2), np.random.default_rng(4), 0, 30, 2).tolist()

    want, told = votes(), (FO.CHUNK, FO.PACKED)
    try:
        for FO.CHUNK, FO.PACKED in ((1, told[1]), (50, told[1]), (told[0], 1.0)):
            assert votes() == want
    finally:
        FO.CHUNK, FO.PACKED = told


def test_forest_is_fitted_on_distinct_rows(spark, monkeypatch):
    """Records of one sequence, condition and label are one row for its passes."""
    from assaykit.functions.sequence import BASELINE_FEATURES
    from assaykit.operators import models
    feats = [f"cast((id % 5) * {i + 2} as double) as {c}" for i, c in enumerate(BASELINE_FEATURES)]
    data = spark.range(200).selectExpr("cast(id as string) as record_id", "cast(id % 5 > 2 as int) as y", "concat('c', id % 2) as solvent_norm", *feats)
    seen = []

    def scored(train, test, *a):
        seen.append((train.count(), train.groupBy().sum("n").first()[0], test.count()))
        return FO.score_forest(train, test, *a)

    monkeypatch.setattr(models, "score_forest", scored)
    got = models.fit_predict("sequence_solvent_random_forest", data, data, models.ModelParams(forest_trees=8))
    assert got.where("y = y_pred").count() == 200 and got.columns[:3] == ["record_id", "y", "solvent_norm"]
    assert seen == [(10, 200, 10)]
