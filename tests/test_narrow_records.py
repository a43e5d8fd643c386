"""Records move through splits without their texts, and get them back whole."""
import hashlib
from collections import Counter

from assaykit.operators import splits as SP
from assaykit.plans import fixtures as fx
from assaykit.plans import queries as _registered  # noqa: F401
from assaykit.plans.catalog import REGISTRY
from assaykit.plans.queries_io import model_data
from assaykit.plans.queries_splits import SEED, K, records


def _tables(spark, folder):
    """Events of users with one, two and no documents, of a document without text and of no user."""
    docs = [(i, f"text {chr(97 + i % 9)} of {i % 7}") for i in range(12)] + [(3, "another"), (12, None)]
    events = [(i, None if i % 41 == 5 else i % 15, "abc"[i % 3], float(i % 50)) for i in range(160)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def _rows(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def test_narrow_records_get_their_texts(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    want = _rows(fx.obs(spark, sf), "record_id", "sequence", "solvent", "label")
    narrow = records(spark, sf)
    assert "sequence" not in narrow.columns
    assert _rows(SP.with_texts(narrow, fx.texts(spark, sf)), "record_id", "sequence", "solvent", "label") == want
    keys = {s: "null" if s is None else hashlib.sha1(s.encode()).hexdigest() for _, s, _, _ in want}
    keyed = records(spark, sf, True)
    assert _rows(keyed, "record_id", SP.KEY) == sum((Counter({(r, keys[s]): n}) for (r, s, _, _), n in want.items()), Counter())


def test_protocols_of_narrow_records(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    whole, narrow, texts = fx.obs(spark, sf).select("record_id", "sequence", "solvent", "label"), records(spark, sf, True), fx.texts(spark, sf)
    cols = ["record_id", "fold", "split", *SP.CONTEXT]
    for of in (SP.split_pair_holdout, SP.split_group_holdout):
        assert _rows(of(narrow, SEED, texts), *cols) == _rows(of(whole, SEED), *cols)
    for of in (SP.split_pair_kfold, SP.split_group_kfold):
        assert _rows(of(narrow, SEED, K, texts), *cols) == _rows(of(whole, SEED, K), *cols)
    assert _rows(REGISTRY["union_folds"].build(spark, sf), *cols) == _rows(SP.split_pair_kfold(whole, SEED, K), *cols)
    told = SP.split_summary(SP.split_group_kfold(narrow, SEED, K))
    assert _rows(told, *told.columns) == _rows(SP.split_summary(SP.split_group_kfold(whole, SEED, K)), *told.columns)


def test_texts_are_read_once(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    for key in ("union_folds", "split_pair_kfold", "split_pair_holdout", "join_split_context"):
        plan = REGISTRY[key].build(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") == 1, key
    assert "regexp_replace" not in model_data(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_features_of_keys(spark, tmp_path):
    from assaykit.operators.features import with_baseline_features
    sf = _tables(spark, tmp_path)
    got = model_data(spark, sf)
    rec = fx.obs(spark, sf).select("record_id", "sequence", "solvent", "label")
    split = SP.split_pair_holdout(rec, SEED).selectExpr("record_id", "split", "label AS y")
    j = rec.select("record_id", "sequence", "solvent").join(split, "record_id").selectExpr("record_id", "split", "y", "lower(trim(solvent)) AS solvent_norm", "sequence")
    want = with_baseline_features(j).drop("sequence")
    assert _rows(got, *want.columns) == _rows(want, *want.columns)
