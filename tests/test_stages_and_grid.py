"""Model stages against their definitions, forests in parts, the ledger of
fits, and running sums by ranges."""
import random
import statistics

import pytest
from concurrent.futures import ThreadPoolExecutor
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from assaykit.functions.sequence import BASELINE_FEATURES
from assaykit.operators import metrics, models
from assaykit.operators.ml_stages import ExactMedianImputer, PopulationScaler
from assaykit.operators.rows import exact_quantiles, prefix_digits, rank_within, running_sums


def test_stages_fit_save_and_load(spark, tmp_path):
    a = [3.0, None, 1.0, float("nan"), 10.0, 2.0]
    df = spark.createDataFrame([(x, 5.0, None) for x in a], "`a.b` double, k double, none double")
    cols = ["a.b", "k", "none"]
    imputer = ExactMedianImputer(inputCols=cols, outputCols=["a1", "k1", "n1"])
    scaler = PopulationScaler(inputCols=["a1", "k1", "n1"], outputCols=["a2", "k2", "n2"])
    model = Pipeline(stages=[imputer, scaler]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    for m in (model, PipelineModel.load(str(tmp_path / "m"))):
        rows = m.transform(df).collect()
        filled = [3.0, 2.5, 1.0, 2.5, 10.0, 2.0]
        assert [r.a1 for r in rows] == filled and {r.k2 for r in rows} == {0.0} and {r.n1 for r in rows} == {0.0}
        mean, dev = statistics.fmean(filled), statistics.pstdev(filled)
        assert [r.a2 for r in rows] == pytest.approx([(x - mean) / dev for x in filled])


def test_running_sums(spark):
    rnd = random.Random(3)
    rows = [(g, v, rnd.randrange(9)) for g in ("a", "b", None) for v in {rnd.choice([0.999, 5.0, -1.0]) + rnd.randrange(400) * 1e-9 for _ in range(300)}]
    got = running_sums(spark.createDataFrame(rows, "g string, v double, n long").repartition(5), ["g"], "v", ["n"]).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [x for x in rows if x[0] == r.g]
        assert (r.n_below, r.n_total) == (sum(x[2] for x in own if x[1] < r.v), sum(x[2] for x in own))


def test_quantiles_of_many_columns(spark):
    df = spark.range(101).select((F.col("id") * 2.0).alias("a"), F.when(F.col("id") < 4, F.col("id")).alias("b"), F.lit(None).cast("double").alias("c"))
    got = {r.column_name: r.q for r in exact_quantiles(df, ["a", "b", "c"], [0.25, 0.5, 1.0]).collect()}
    assert got == {"a": [50.0, 100.0, 200.0], "b": [0.75, 1.5, 3.0]}


def test_crowded_and_wide_scores(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("xy"), rnd.randrange(2), p) for p in [0.999 + i * 1e-9 for i in range(300)] + [-3.0, 7.5, 7.5, 0.999]]
    got = {r.k: r for r in metrics.ranking_metrics(spark.createDataFrame(rows, "k string, y int, p double"), ["k"]).collect()}
    for k, r in got.items():
        own = [(y, p) for g, y, p in rows if g == k]
        pos, neg = [p for y, p in own if y], [p for y, p in own if not y]
        auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
        ap = sum(sum(y and q >= p for y, q in own) / sum(q >= p for _, q in own) for p in pos) / len(pos)
        assert r.roc_auc == pytest.approx(auc) and r.average_precision == pytest.approx(ap)


def test_longer_prefixes_rank_alike(spark, monkeypatch):
    assert [prefix_digits(n) for n in (0, 10, 25_600_000, 25_600_001, 10**12)] == [2, 2, 2, 3, 6]
    df = spark.range(500).select(F.col("id"), (F.col("id") % 2).alias("s"))
    key = F.md5(F.col("id").cast("string"))
    a = {(r.id, r.rank) for r in rank_within(df, "s", key, "id").collect()}
    assert a == {(r.id, r.rank) for r in rank_within(df, "s", key, "id", largest=10**9).collect()}


def _data(spark):
    feats = [f"cast((id * {i + 3}) % 17 as double) as {c}" for i, c in enumerate(BASELINE_FEATURES)]
    data = spark.range(120).selectExpr("cast(id as string) as record_id", "cast(id % 17 > 8 as int) as y", "concat('c', id % 3) as solvent_norm", *feats)
    assign = spark.range(120).selectExpr("cast(id as string) as record_id", "explode(array(0, 1)) as fold", "'p' as protocol", "id") \
        .selectExpr("record_id", "protocol", "fold", "if(id % 4 = fold, 'test', 'train') as split")
    return data, assign


def test_forest_in_parts(spark):
    data, assign = _data(spark)
    p = models.ModelParams(forest_trees=7, forest_part=3, forest_max_depth=4)
    assert models.forest_parts(p) == [(3, 2026), (3, 2027), (1, 2028)]
    train, test = data.where("cast(record_id as int) < 90"), data.where("cast(record_id as int) >= 90")
    f = models.FoldFeatures(train, test)
    tr, te = f.get(("both", False))
    with ThreadPoolExecutor(2) as pool:
        forest = models.Forest.fit(tr, p, pool)
    rows = forest.transform(te).select("features", "p", "y_pred", "y").collect()
    trees = [t for part in forest.parts for t in part.trees]
    assert len(trees) == 7
    for r in rows:
        # Spark's vote of a tree: the class shares of the leaf.
        votes = sum(part.predictProbability(r.features)[1] * part.getNumTrees for part in forest.parts) / 7
        assert r.p == pytest.approx(votes) and r.y_pred == int(r.p > 0.5)
    assert sum(r.y == r.y_pred for r in rows) > 0.8 * len(rows)


def test_models_score_after_an_observed_metric(spark):
    from assaykit.operators.prepare import drop_missing
    data, _ = _data(spark)
    kept, told = drop_missing(data, ["y"])
    assert kept.count() == 120 and told.get == {"n_rows": 120, "n_dropped": 0}
    p = models.ModelParams(forest_trees=2, forest_max_depth=2, boosting_iters=2, logistic_max_iter=5)
    for name in models.MODEL_MODES:
        assert models.fit_predict(name, data, data, p).where("p between 0 and 1").count() == 120, name


def test_finished_fits_are_not_repeated(spark, monkeypatch):
    data, assign = _data(spark)
    p = models.ModelParams(forest_trees=2, forest_max_depth=3, boosting_iters=2, logistic_max_iter=5, seed=random.randrange(10**9))
    first, errors = models.evaluate_grid(data, assign, p)
    assert errors == [], p.seed
    assert first.select("fold", "model").distinct().count() == 14

    def fails(*a, **k):
        raise AssertionError("fitted twice")

    monkeypatch.setattr(models, "FoldFeatures", fails)
    monkeypatch.setattr(models, "fit_predict", fails)
    again, errors = models.evaluate_grid(data, assign, p)
    assert errors == [], p.seed
    assert sorted(again.collect()) == sorted(first.collect()), p.seed
    with pytest.raises(AssertionError):
        models.evaluate_grid(data.withColumn("y", 1 - F.col("y")), assign, p)


def test_one_class(spark):
    """Trained on one class, every model scores all rows with that class."""
    data, _ = _data(spark)
    p = models.ModelParams(forest_trees=2, forest_max_depth=2, boosting_iters=2, logistic_max_iter=5)
    for label in (0, 1):
        train = data.where(f"y = {label}")
        for name in ("sequence_solvent_logistic", "sequence_solvent_random_forest"):
            got = models.fit_predict(name, train, data, p).select("p", "y_pred").distinct().collect()
            assert {r.y_pred for r in got} == {label} and all(abs(r.p - label) < 0.05 for r in got), (name, got[:3])


def test_stages_weigh_counts(spark):
    rows = [(1.5, 0.1, 3), (None, 0.1, 2), (4.0, 0.1, 1), (7.25, 0.1, 5)]
    counted = spark.createDataFrame(rows, "a double, k double, n long")
    whole = spark.createDataFrame([(a, k) for a, k, n in rows for _ in range(n)], "a double, k double")
    fits = []
    for df, weight in ((counted, "n"), (whole, None)):
        imputer = ExactMedianImputer(inputCols=["a", "k"], outputCols=["a1", "k1"], weightCol=weight).fit(df)
        scaler = PopulationScaler(inputCols=["a1", "k1"], outputCols=["a2", "k2"], weightCol=weight).fit(imputer.transform(df))
        fits.append([x for m, p in ((imputer, "medians"), (scaler, "means"), (scaler, "deviations")) for x in m.getOrDefault(p)])
    assert fits[0] == pytest.approx(fits[1]) and fits[0][-1] == 1.0


def test_names_tell_nulls_apart(spark):
    feats = ", ".join(f"cast(if(id = {i}, null, 1) as double) as {c}" for i, c in enumerate(BASELINE_FEATURES))
    df = spark.sql(f"select if(id = 54, null, 'c') as solvent_norm, {feats} from range(56)")
    assert models.named(models.packed(df), ["solvent_norm"], models.NAME).select(*models.NAME).distinct().count() == 56


def test_grid_fits_distinct_rows_and_keeps_all_records(spark, monkeypatch):
    """Each fold is fitted on distinct rows with counts; records and assignments that come twice are all scored."""
    data, assign = _data(spark)
    data, assign = data.unionByName(data.where("record_id = '4'")), assign.unionByName(assign.where("record_id in ('4', '8')"))
    joined = data.join(assign, "record_id")
    seen = []

    class Seen(models.FoldFeatures):
        def __init__(self, train, test):
            super().__init__(train, test)
            seen.append((self.rows, self.n, test.count()))

    monkeypatch.setattr(models, "FoldFeatures", Seen)
    p = models.ModelParams(forest_trees=2, forest_max_depth=3, boosting_iters=2, logistic_max_iter=5, seed=random.randrange(10**9))
    names = ["majority_class", "solvent_logistic", "sequence_solvent_random_forest", "sequence_solvent_gradient_boosting"]
    got, errors = models.evaluate_grid(data, assign, p, names)
    assert errors == [] and got.where("p is null or y_pred is null").count() == 0
    want = sorted((r.fold, r.record_id, r.y) for r in joined.where("split = 'test'").collect())
    for name in names:
        assert sorted((r.fold, r.record_id, r.y) for r in got.where(F.col("model") == name).collect()) == want
    kinds = [c for c in data.columns if c != "record_id"]
    sizes = [[joined.where(f"split = '{s}' and fold = {f}").select(*kinds) for s in ("train", "test")] for f in (0, 1)]
    assert sorted(seen) == sorted((a.distinct().count(), a.count(), b.distinct().count()) for a, b in sizes)
    told = {r.fold: r for r in models.grid_results(data, assign, got, errors).where("model = 'majority_class'").collect()}
    for f, (a, b) in enumerate(sizes):
        assert (told[f].n_train, told[f].n_test) == (a.count(), b.count())
        assert told[f].train_positive_rate == pytest.approx(a.agg(F.avg("y")).first()[0])
