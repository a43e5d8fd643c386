"""Release audit: each check yields rows (check, severity, detail, n); the
audit is their union. Counting checks are single aggregates; id checks
are anti joins, so nothing is collected per id."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .qc import sequence_key
from .rows import small_join

AUDIT_SCHEMA = T.StructType([T.StructField("check", T.StringType(), False),
                             T.StructField("severity", T.StringType(), False),
                             T.StructField("detail", T.StringType(), True),
                             T.StructField("n", T.LongType(), True)])

# Expected release numbers (fixed values of the published release).
RELEASE_EXPECTED = {"n_records": 4405, "n_unique_sequences": 1337, "n_unique_solvents": 7,
                    "positive_rate": 0.6456299659477867}
REQUIRED_LONG_COLUMNS = ["observation_id", "sequence_clean", "solvent_name", "y"]
SPLIT_ID_CANDIDATES = ["observation_id", "record_id", "id"]
EXPECTED_RESULT_ROWS = 63


def _rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, AUDIT_SCHEMA)


def _finding(df: DataFrame, check: str, severity: str, detail, n) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"),
                     detail.cast("string").alias("detail"), n.cast("long").alias("n"))


def audit_required_columns(long: DataFrame, required=REQUIRED_LONG_COLUMNS) -> DataFrame:
    missing = [c for c in required if c not in long.columns]
    return _rows(long.sparkSession, [("required_columns", "error", f"the long table has no column {c}", None)
                                     for c in missing])


def audit_row_count(long: DataFrame, expected: int) -> DataFrame:
    n = long.agg(F.count(F.lit(1)).alias("n"))
    return _finding(n.where(F.col("n") != expected), "row_count", "error",
                    F.concat(F.lit("record count differs: "), F.col("n").cast("string")), F.col("n"))


def audit_unique_key(long: DataFrame, key: str = "observation_id") -> DataFrame:
    dup = long.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1)
    agg = dup.agg(F.count(F.lit(1)).alias("n"))
    return _finding(agg.where(F.col("n") > 0), "unique_key", "error",
                    F.lit(f"values of {key} repeat"), F.col("n"))


def audit_distinct_counts(long: DataFrame, expected_sequences: int, expected_conditions: int,
                          seq_col: str = "sequence_clean", cond_col: str = "solvent_name") -> DataFrame:
    a = long.agg(F.countDistinct(F.sha1(F.col(seq_col))).alias("s"), F.countDistinct(cond_col).alias("c"))
    s = _finding(a.where(F.col("s") != expected_sequences), "distinct_sequences", "error",
                 F.concat(F.lit("sequence count differs: "), F.col("s").cast("string")), F.col("s"))
    c = _finding(a.where(F.col("c") != expected_conditions), "distinct_conditions", "error",
                 F.concat(F.lit("condition count differs: "), F.col("c").cast("string")), F.col("c"))
    return s.unionByName(c)


def audit_positive_rate(long: DataFrame, expected: float, tol: float = 1e-12) -> DataFrame:
    a = long.agg(F.avg(F.col("y").cast("double")).alias("r"))
    return _finding(a.where(F.abs(F.col("r") - F.lit(expected)) > tol), "positive_rate", "error",
                    F.concat(F.lit("share of positives differs: "), F.format_string("%.12f", F.col("r"))),
                    F.lit(None))


def outside(df: DataFrame, col: str, allowed: list) -> DataFrame:
    """The rows whose value is not among ``allowed``; a null is no value."""
    return df.where(~F.col(col).isin(*allowed))


def audit_binary_label(long: DataFrame, col: str = "y") -> DataFrame:
    bad = outside(long, col, [0, 1]).agg(F.count(F.lit(1)).alias("n"))
    return _finding(bad.where(F.col("n") > 0), "binary_label", "error",
                    F.lit(f"{col} has values other than 0 and 1"), F.col("n"))


def split_id_column(columns: list[str]) -> str | None:
    return min(set(columns) & set(SPLIT_ID_CANDIDATES), key=SPLIT_ID_CANDIDATES.index, default=None)


def audit_split_refs(long: DataFrame, split: DataFrame, name: str,
                     data_key: str = "observation_id") -> DataFrame:
    """Split file must be non-empty, have an id column, and reference only
    known ids (one anti join, distinct ids counted)."""
    spark = long.sparkSession
    idc = split_id_column(split.columns)
    if idc is None:
        return _rows(spark, [("split_refs", "error",
                              f"no id column among {split.columns} of split {name}", None)])
    empty = _finding(split.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0), "split_refs", "error",
                     F.lit(f"no rows in split {name}"), F.lit(0))
    ids = split.select(F.col(idc).cast("string").alias("_id")).distinct()
    known = long.select(F.col(data_key).cast("string").alias("_id"))
    unknown = ids.join(known, "_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))
    bad = _finding(unknown.where(F.col("n") > 0), "split_refs", "error",
                   F.concat(F.lit("ids that the data lack: "), F.col("n").cast("string"),
                            F.lit(f" in split {name}")), F.col("n"))
    return empty.unionByName(bad)


def unknown_ids(long: DataFrame, split: DataFrame, data_key: str = "observation_id") -> DataFrame:
    """Distinct split ids missing from the data."""
    idc = split_id_column(split.columns)
    ids = split.select(F.col(idc).cast("string").alias("record_id")).distinct()
    return ids.join(long.select(F.col(data_key).cast("string").alias("record_id")), "record_id", "left_anti")


def audit_result_rows(results: DataFrame, errors: DataFrame | None = None,
                      expected: int = EXPECTED_RESULT_ROWS) -> DataFrame:
    n = results.agg(F.count(F.lit(1)).alias("n"))
    out = _finding(n.where(F.col("n") != expected), "result_rows", "warning",
                   F.concat(F.lit("result table has "), F.col("n").cast("string"),
                            F.lit(f" rows instead of {expected}")), F.col("n"))
    if errors is not None:
        e = errors.agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(_finding(e.where(F.col("n") > 0), "result_errors", "error",
                                       F.lit("the error table has rows"), F.col("n")))
    return out


def counting_checks(long: DataFrame, expected: dict, tol: float = 1e-12) -> DataFrame:
    """All checks that count, over one aggregate of the long table: rows,
    repeated ids (``n``: rows too many), distinct sequences and conditions,
    share of positives, labels other than 0 and 1. ``expected`` has the keys of
    RELEASE_EXPECTED."""
    y = F.col("y")
    counted = long.agg(
        F.count(F.lit(1)).alias("rows"), (F.count("observation_id") - F.countDistinct("observation_id")).alias("repeated"),
        F.countDistinct(sequence_key(long)).alias("sequences"), F.countDistinct("solvent_name").alias("conditions"),
        F.avg(y.cast("double")).alias("rate"), F.count_if(y.isNotNull() & ~y.isin(0, 1)).alias("odd"))

    def differs(check: str, of: str, told: str, want) -> Column:
        n = F.col(of)
        return F.when(n != want, F.struct(F.lit(check).alias("check"), F.concat(F.lit(f"{told} differs: "), n.cast("string")).alias("detail"), n.cast("long").alias("n")))

    def some(check: str, of: str, told: str) -> Column:
        return F.when(F.col(of) > 0, F.struct(F.lit(check).alias("check"), F.lit(told).alias("detail"), F.col(of).cast("long").alias("n")))

    off = F.when(F.abs(F.col("rate") - F.lit(expected["positive_rate"])) > tol, F.struct(
        F.lit("positive_rate").alias("check"), F.format_string("share of positives differs: %.12f", F.col("rate")).alias("detail"), F.lit(None).cast("long").alias("n")))
    found = F.array(
        differs("row_count", "rows", "record count", expected["n_records"]), some("unique_key", "repeated", "values of observation_id repeat"),
        differs("distinct_sequences", "sequences", "sequence count", expected["n_unique_sequences"]),
        differs("distinct_conditions", "conditions", "condition count", expected["n_unique_solvents"]), off, some("binary_label", "odd", "y has values other than 0 and 1"))
    each = counted.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    return each.select("x.check", F.lit("error").alias("severity"), "x.detail", "x.n")


def split_checks(long: DataFrame, splits: dict[str, DataFrame], data_key: str = "observation_id") -> DataFrame:
    """The checks of :func:`audit_split_refs` for many split tables: no rows, no
    id column, unknown ids. All tables go through one anti join and one
    aggregate; the list of tables is the caller's."""
    spark = long.sparkSession
    columns = {name: split_id_column(df.columns) for name, df in splits.items()}
    lacking = _rows(spark, [("split_refs", "error", f"no id column among {splits[n].columns} of split {n}", None) for n, c in columns.items() if c is None])
    named = {n: c for n, c in columns.items() if c is not None}
    if not named:
        return lacking
    ids = reduce(DataFrame.unionByName, [splits[n].select(F.lit(n).alias("_split"), F.col(c).cast("string").alias("_id")) for n, c in named.items()])
    # Counted per (table, id) before the join: ids repeat over the folds of a table.
    distinct = ids.groupBy("_split", "_id").agg(F.count(F.lit(1)).alias("_n"))
    known = long.select(F.col(data_key).cast("string").alias("_id"), F.lit(True).alias("_known")).distinct()
    seen = distinct.join(known, "_id", "left").groupBy("_split").agg(F.sum("_n").alias("rows"), F.count_if(F.col("_known").isNull()).alias("n"))
    want = spark.createDataFrame([(n,) for n in named], "_split string")
    told = small_join(seen.withColumnRenamed("_split", "_s"), want, F.col("_s") == F.col("_split"), "right", rows=len(named))
    empty = _finding(told.where(F.col("rows").isNull()), "split_refs", "error", F.concat(F.lit("no rows in split "), F.col("_split")), F.lit(0))
    bad = _finding(told.where(F.col("n") > 0), "split_refs", "error",
                   F.concat(F.lit("ids that the data lack: "), F.col("n").cast("string"), F.lit(" in split "), F.col("_split")), F.col("n"))
    return lacking.unionByName(empty).unionByName(bad)


def json_checks(validated: DataFrame) -> DataFrame:
    """A finding for each document that :func:`assaykit.sources.files.scan_json_validate` found broken."""
    return _finding(validated.where(~F.col("valid")), "json", "error", F.concat(F.lit("no valid JSON: "), F.col("file")), F.lit(None))


def release_audit(long: DataFrame, splits: dict[str, DataFrame], results: DataFrame, errors: DataFrame, files: DataFrame, documents: DataFrame,
                  expected: dict | None = None, n_results: int = EXPECTED_RESULT_ROWS) -> DataFrame:
    """The whole release gate as one table of findings; a release passes if it
    has no row of severity error. ``files`` are the findings of
    :func:`audit_required_files`, ``documents`` validated JSON documents. A
    long table that lacks a column is not counted further."""
    columns = audit_required_columns(long)
    parts = [files, columns, json_checks(documents), audit_result_rows(results, errors, n_results)]
    if not set(REQUIRED_LONG_COLUMNS) - set(long.columns):
        parts += [counting_checks(long, expected or RELEASE_EXPECTED), split_checks(long, splits)]
    return reduce(DataFrame.unionByName, parts)


def audit_required_files(spark: SparkSession, root: str, required: list[str]) -> DataFrame:
    """Required relative paths must exist (error) and be non-empty (warning).

    The file system is asked for each path of the (short) list: Spark's file
    sources leave empty files out, so a scan cannot tell one from a missing
    one. A table written by Spark is a folder of parts under the required name
    and counts by the sum of their lengths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for rel in required:
        path = hadoop.Path(f"{root.rstrip('/')}/{rel}")
        fs = path.getFileSystem(settings)
        if not fs.exists(path):
            found.append(("required_files", "error", f"file not found: {rel}", None))
        elif fs.getContentSummary(path).getLength() == 0:
            found.append(("required_files", "warning", f"file without content: {rel}", 0))
    return _rows(spark, found)
