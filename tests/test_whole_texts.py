"""Rules on whole texts and on rows of many records: searched instead of translated, read once, written narrow."""
import random
from collections import Counter

from pyspark.sql import functions as F

from assaykit.functions import labels as L
from assaykit.functions.text import NULL_TOKENS, WS_CLASS, clean_cell, clean_text
from assaykit.operators import models as ML
from assaykit.operators.rows import rank_within
from assaykit.plans import queries as _registered  # noqa: F401
from assaykit.plans import queries_io as Q
from assaykit.plans.build import DatasetBuild
from assaykit.plans.catalog import REGISTRY
from tests.test_narrow_records import _tables

SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]


def _clean(x):
    return " ".join(x.replace("﻿", "").split())


def _label(s):
    low = s.lower()
    compact = "".join(c for c in low if not c.isspace() and c not in "_-")
    if "insoluble" in compact or "not soluble" in low or any(w in s for w in L.LABEL_NEGATIVE_CJK):
        return 0
    return 1 if "soluble" in compact or any(w in s for w in L.LABEL_POSITIVE_CJK) else None


def _written(monkeypatch):
    """The names and columns of the tables that queries write."""
    seen, write = [], Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, name: seen.append((name, df.columns)) or write(df, name))
    return seen


def test_cells_against_python(spark):
    draw = random.Random(7)
    bits = [*SPACES, *"   __--/aN﻿", "soluble", "In", "not soluble", "so-lu ble", "不溶", "难溶", "可溶", "NA", "n/a", "none", "nottested", "words"]
    cells = ["".join(draw.choices(bits, k=draw.randint(0, 8))) for _ in range(4000)] + ["", " ", "NA\n", "﻿nan"]
    got = spark.createDataFrame([(c,) for c in cells] + [(None,)], "x string").select(
        "x", clean_text("x").alias("text"), clean_cell("x").alias("cell"), L.normalize_label("x").alias("label")).collect()
    for r in got:
        want = None if r.x is None else _clean(r.x)
        assert (r.text, r.cell, r.label) == (want, None if want in NULL_TOKENS else want, None if want is None else _label(want))


def test_cells_are_not_translated(spark):
    df = spark.range(1).select(F.lit("x").alias("x")).select(clean_cell("x").alias("a"), L.normalize_label("x").alias("b"))
    assert "translate(" not in df._jdf.queryExecution().analyzed().toString()
    assert WS_CLASS in df._jdf.queryExecution().analyzed().toString()


def test_models_without_features_read_no_text(spark, tmp_path, monkeypatch):
    sf, seen = _tables(spark, tmp_path), _written(monkeypatch)
    for key in ("balanced_weights", "model_majority", "model_stratified_dummy", "ml_one_hot", "model_logistic_condition"):
        seen.clear()
        monkeypatch.setattr(Q.fx, "texts", None)
        REGISTRY[key].build(spark, sf).count()
        assert seen == [("model_data", ["record_id", "split", "y", "solvent_norm"])], key


def test_features_are_joined_in_the_order_of_documents(spark, tmp_path):
    plan = Q.model_data(spark, _tables(spark, tmp_path))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [_text" in plan and "sha1" not in plan


def test_rank_keys_are_binary(spark):
    ids = [(str(i), "ab"[i % 2]) for i in range(500)]
    ranked = rank_within(spark.createDataFrame(ids, "id string, s string"), "s", F.md5("id"), "id", n_strata=2, largest=250)
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex" in plan
    import hashlib
    for s in "ab":
        order = sorted((i for i, t in ids if t == s), key=lambda i: hashlib.md5(i.encode()).hexdigest())
        assert [r.id for r in ranked.where(F.col("s") == s).orderBy("rank").collect()] == order


def test_boosting_counts_equal_rows(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors
    draw = random.Random(3)
    rows = [(Vectors.dense([float(i % 6), float(i % 4)]), float(draw.random() < 0.2 + 0.1 * (i % 6))) for i in range(400)]
    train = spark.createDataFrame(rows, ["features", "y"])
    alike = ML.counted(train)
    assert Counter({(tuple(r.features), r.y): r.n for r in alike.collect()}) == Counter((tuple(v), y) for v, y in rows)
    fit = {"featuresCol": "features", "labelCol": "y", "maxIter": 5, "maxDepth": 3, "seed": 1}
    test = train.select("features").distinct()

    def scores(model):
        return {tuple(r.features): round(r.probability[1], 6) for r in model.transform(test).collect()}
    assert scores(GBTClassifier(weightCol="n", **fit).fit(alike)) == scores(GBTClassifier(**fit).fit(train))


def test_release_gate_builds_once(spark, tmp_path, monkeypatch):
    made, init = [], DatasetBuild.__init__
    monkeypatch.setattr(DatasetBuild, "__init__", lambda self, *a: made.append(1) or init(self, *a))
    seen = _written(monkeypatch)
    REGISTRY["release_gate"].build(spark, "/root/testdata/sf0.001")
    assert len(made) == 1 and not [n for n, columns in seen if "sequence_clean" in columns]
