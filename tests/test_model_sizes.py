"""The registered model queries fit the published sizes."""
from assaykit.plans import queries as _registered  # noqa: F401
from assaykit.plans import queries_io
from assaykit.plans.catalog import REGISTRY


class Seen(Exception):
    pass


def test_registered_models_use_the_published_sizes(monkeypatch):
    def stop(*args):
        raise Seen(args[-1])

    monkeypatch.setattr(queries_io, "_train_test", lambda s, d: (None, None))
    monkeypatch.setattr(queries_io.ML, "fit_predict", stop)
    for key in ("model_logistic_both", "model_random_forest", "model_gradient_boosting"):
        assert _params(key) == (400, 30, 100)

    class Table:
        def __getattr__(self, _):
            return lambda *a, **k: self

    table = lambda *_: Table()
    for name in ("split_pair_holdout", "split_group_holdout", "split_leave_one_condition_out"):
        monkeypatch.setattr(queries_io.SP, name, table)
    for name in ("records", "model_data", "materialize"):
        monkeypatch.setattr(queries_io, name, table)
    monkeypatch.setattr(queries_io.F, "lit", table)
    monkeypatch.setattr(queries_io.ML, "evaluate_grid", stop)
    monkeypatch.setattr(queries_io.ML, "grid_results", table)
    assert _params("evaluate_grid") == (400, 30, 100)


def _params(key):
    try:
        REGISTRY[key].build(None, "")
    except Seen as e:
        p = e.args[0]
        return p.forest_trees, p.forest_max_depth, p.boosting_iters
    raise AssertionError(f"{key} fits no model")
