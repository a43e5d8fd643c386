"""Inline literal fixtures: one case per rule and per quirk."""
import pytest
from pyspark.sql import functions as F

from assaykit.functions import labels as L
from assaykit.functions import text as X
from assaykit.functions.conditions import condition_class_columns
from assaykit.functions.mojibake import fix_mojibake_text
from assaykit.sources.schema import dedupe_headers, normalize_header, resolve_column


def col_values(spark, values, fn, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.select(fn(F.col("v"))).orderBy(F.monotonically_increasing_id()).collect()]


def one(spark, value, fn):
    return col_values(spark, [value], fn)[0]


LABEL_CASES = [
    ("Soluble", 1), (" INSOLUBLE ", 0), ("in-soluble", 0), ("not soluble", 0),
    ("not-soluble", 1),            # only the spaced form is negative; compact holds "soluble"
    ("slightly soluble", 1), ("N/A", None), ("n_t", None), ("-", None), ("/", None),
    ("", None), (None, None), ("5", None), ("可溶", 1), ("不溶", 0), ("难溶", 0),
    ("Not Tested", None), ("soluble ", 1),
]


@pytest.mark.parametrize("raw,expected", LABEL_CASES)
def test_normalize_label(spark, raw, expected):
    assert one(spark, raw, L.normalize_label) == expected


STRICT = [("1", 1), ("0", 0), ("1.0", 1), ("true", 1), (" pos ", 1), ("NON-SOLUBLE", 0),
          ("2", None), ("maybe", None), (None, None), ("0.0", 0), ("not soluble", 0)]


@pytest.mark.parametrize("raw,expected", STRICT)
def test_normalize_label_strict(spark, raw, expected):
    assert one(spark, raw, L.normalize_label_strict) == expected


def test_require_labels_reports_examples(spark):
    df = spark.createDataFrame([("a", "yes"), ("b", "maybe")], "id string, raw string")
    df = df.withColumn("y", L.normalize_label_strict("raw"))
    with pytest.raises(L.LabelError, match="maybe"):
        L.require_labels(df, "raw", "y", "id")


NUMBERS = [("98.5%", 98.5), (">95", 95.0), ("-3.2e1", -32.0), (".5", 0.5), ("95.", 95.0),
           ("1,234", 1.0), ("abc", None), (None, None), ("~12.3 Da", 12.3)]


@pytest.mark.parametrize("raw,expected", NUMBERS)
def test_parse_number(spark, raw, expected):
    assert one(spark, raw, X.parse_number) == expected


QUANTITIES = [("7*2.0mg", 14.0), ("4*3.0mg+2.0mg", 14.0), ("3 x 5 mg", 15.0), ("2*3*4mg", 10.0),
              ("10 vials 5mg", 15.0), ("500µg", 0.5), ("0.5G", 500.0), ("-", None), (None, None),
              ("3×5mg", 15.0)]


@pytest.mark.parametrize("raw,expected", QUANTITIES)
def test_parse_quantity(spark, raw, expected):
    got = one(spark, raw, X.parse_quantity_mg)
    assert (got is None and expected is None) or got == pytest.approx(expected)


# Condition names and their ids as published with the release.
SLUGS = [("Ultrapure water", "ultrapure_water"), ("1X DPBS", "s_1x_dpbs"), ("0.1 M PBS", "s_0_1_m_pbs"),
         ("DMSO", "dmso"), ("HCOOH", "hcooh"), ("Saline", "saline"),
         ("0.2M acetic acid", "s_0_2m_acetic_acid"), ("3% ammonia water(v/v)", "s_3pct_ammonia_water_v_v"),
         ("超纯水", "unknown"), ("", "unknown"), ("a+b", "aplusb")]


@pytest.mark.parametrize("raw,expected", SLUGS)
def test_slugify(spark, raw, expected):
    assert one(spark, raw, X.slugify) == expected


# Class and six flags per published condition.
FLAGS = {
    "Ultrapure water": ("water", 1, 0, 0, 0, 0, 0), "1X DPBS": ("dpbs", 1, 1, 1, 0, 0, 0),
    "0.1 M PBS": ("pbs", 1, 1, 1, 0, 0, 0), "DMSO": ("dmso", 0, 0, 0, 1, 0, 0),
    "HCOOH": ("formic_acid", 0, 0, 0, 1, 1, 0), "Saline": ("saline", 1, 0, 1, 0, 0, 0),
    "0.2M acetic acid": ("acetic_acid", 1, 0, 0, 0, 1, 0),
    "3% ammonia water(v/v)": ("ammonia_water", 1, 0, 0, 0, 0, 1),
}


def test_condition_flags_golden(spark):
    df = spark.createDataFrame([(k,) for k in FLAGS], "name string")
    got = {r[0]: tuple(r[1:]) for r in df.select("name", *condition_class_columns("name")).collect()}
    assert got == FLAGS


def test_clean_text_and_tokens(spark):
    assert one(spark, "\ufeff a \u3000b \n", X.clean_text) == "a b"
    assert one(spark, "  NULL ", X.clean_cell) is None
    assert one(spark, " nan", X.clean_cell) is None
    assert one(spark, "Nan", X.clean_cell) == "Nan"     # tokens are case-sensitive


def test_normalize_sequence_and_ids(spark):
    assert one(spark, " ac d e ", X.normalize_sequence) == "ACDE"
    assert one(spark, None, X.normalize_sequence) == ""
    import hashlib
    want = "pep_" + hashlib.sha1("ACDE".encode()).hexdigest()[:12]
    assert one(spark, "ACDE", lambda c: X.stable_id("pep", c)) == want


def test_mojibake_docstring_pairs():
    # GB18030 text decoded as Latin-1 is restored; other text is kept.
    for good in ["难度预测", "难度系数", "检测结果", "（含难度片段）"]:
        bad = good.encode("gb18030").decode("latin1")
        assert fix_mojibake_text(bad) == good
    assert fix_mojibake_text("plain ascii") == "plain ascii"
    assert fix_mojibake_text("已经是中文") == "已经是中文"


def test_headers():
    assert normalize_header("Sequence（含难度片段）") == "sequence"
    assert normalize_header("M.W.") == "mw"
    assert normalize_header("Quantity (delivered)") == "quantity_delivered"
    assert normalize_header("HPLC (%)") == "hplc_result"
    assert normalize_header("难度系数") == "difficulty_score"
    assert dedupe_headers(["a", "a", "b", "a"]) == ["a", "a__dup1", "b", "a__dup2"]
    assert resolve_column(["Observation-ID", "Solvent Name"], ["solvent_name"]) == "Solvent Name"
    with pytest.raises(ValueError):
        resolve_column(["x"], ["y"])
