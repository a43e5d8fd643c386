"""Spark queries vs their DuckDB oracle SQL on the driver tables (sf0.001).

A representative key per family runs by default; ASSAYKIT_FULL_ORACLE=1
runs every registered key (rows-only keys just have to run)."""
import os

import pytest

from .conftest import SF_SMALL
from .harness import duck_connect, run_key

QUICK = ["condition_summary", "wide_to_long", "ingest_wide", "detect_condition_columns",
         "duplicate_conflicts", "peptide_features", "parse_quantity_mg", "normalize_label",
         "split_pair_holdout", "split_group_kfold", "split_leave_one_condition_out",
         "metric_roc_auc", "metric_average_precision", "leaderboard_summary", "numeric_summary",
         "isoelectric_point", "baseline_features", "audit_row_count", "scan_split_file"]


def _keys():
    import __spark_entry__ as entry
    keys = list(entry.queries())
    if os.environ.get("ASSAYKIT_FULL_ORACLE") == "1":
        return keys
    return [k for k in QUICK if k in keys]


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("key", _keys())
def test_query_matches_oracle(spark, con, key):
    r = run_key(spark, key, SF_SMALL, con)
    assert r["ok"], r


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "n_labeled_records" in df.columns
