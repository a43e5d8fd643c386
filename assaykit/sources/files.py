"""File sources and sinks.

* CSV ingest reads every column as a string (no inference: ids like
  ``007`` must survive) and gives each row its position in the source
  files (file path, block start, position in block), computed from
  per-block counts - no global sort, no single task.
* Split files, JSON validation, SHA-256 inventories and checksum lists
  are read with the matching Spark data sources (csv, json with a
  corrupt-record column, binaryFile, text).
"""
from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import small_join
from .schema import dedupe_headers, normalize_header

CSV_QUOTING = {"quote": '"', "escape": '"'}


def with_scan_row_index(scan: DataFrame, name: str = "source_row_index") -> DataFrame:
    """0-based position of each row across the scanned files (path order).

    Rows are tagged with their file, the start of their file block and
    ``monotonically_increasing_id``; per-block counts (one row per block,
    bounded by the number of input splits) give each block its offset."""
    cols = scan.columns
    t = scan.select("*", F.col("_metadata.file_path").alias("_f"),
                    F.col("_metadata.file_block_start").alias("_b"),
                    F.monotonically_increasing_id().alias("_m"))
    blocks = t.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    w = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = blocks.select("_f", "_b", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    j = small_join(t, offs, ["_f", "_b"], rows=max(len(scan.inputFiles()), 1) * 1024)
    return j.select(*[F.col(f"`{c}`") for c in cols],
                    (F.col("_off") + F.col("_m") - F.col("_m0")).cast("long").alias(name))


def read_header(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", multi_line: bool = True) -> list[str]:
    """The header row of a CSV file or folder, as written (duplicates kept)."""
    first = (spark.read.option("header", False).option("sep", sep).option("encoding", encoding)
             .options(**CSV_QUOTING).option("multiLine", multi_line).csv(path).limit(1).collect())
    return [("" if v is None else v) for v in first[0]] if first else []


def scan_csv_raw(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8",
                 repair_headers: bool = True, multi_line: bool = True) -> DataFrame:
    """All-string read with role-normalised, deduplicated headers and
    ``source_row_index``. Empty cells are null (as the null tokens would
    make them). A file is one task's work while cells may hold line ends;
    ``multi_line=False`` lets Spark split it."""
    header = read_header(spark, path, sep, encoding, multi_line)
    names = dedupe_headers([normalize_header(h) for h in header]) if repair_headers else header
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(header))])
    df = (spark.read.schema(schema).option("header", True).option("sep", sep)
          .option("encoding", encoding).options(**CSV_QUOTING).option("multiLine", multi_line).csv(path))
    df = with_scan_row_index(df)
    return df.toDF(*names, "source_row_index")


#: Readings that :func:`choose_read` tries, in order of preference. Encodings that this Spark refuses are passed over.
ENCODINGS = ["UTF-8", "GB18030", "GBK", "ISO-8859-1"]
SEPARATORS = [",", "\t", ";"]


def choose_read(spark: SparkSession, path: str, encodings: list[str] | None = None, separators: list[str] | None = None,
                multi_line: bool = True) -> tuple[DataFrame, dict]:
    """The reading of a CSV file with the highest score (see
    :func:`assaykit.operators.ingest.ingest_quality_score`), the first of equal
    ones, and what was chosen: encoding, sep, n_cols, score.

    A reading that fails, or in which bytes cannot be decoded, is out. Headers
    are compared first: a reading that has one column is scored by that alone,
    and the rows are read for the others only, in one aggregate each."""
    from ..operators.ingest import ingest_quality_score
    best, told = None, {"score": float("-inf")}
    for encoding in encodings or ENCODINGS:
        for sep in separators or SEPARATORS:
            try:
                header = read_header(spark, path, sep, encoding, multi_line)
                if not header or any("\ufffd" in h for h in header):
                    continue
                df = scan_csv_raw(spark, path, sep, encoding, multi_line=multi_line)
                score = float(len(header))
                if len(header) > 1:
                    cells = df.drop("source_row_index")
                    broken = F.max(F.concat_ws("", *[F.col(f"`{c}`") for c in cells.columns]).contains("\ufffd"))
                    if cells.agg(broken).first()[0]:
                        continue
                    score = ingest_quality_score(cells.toDF(*header) if len({*header}) == len(header) else cells).first()["score"]
            except (PySparkException, Py4JJavaError):
                continue
            if score > told["score"]:
                best, told = df, {"encoding": encoding, "sep": sep, "n_cols": len(header), "score": score}
    if best is None:
        raise ValueError(f"no reading of {path} succeeds")
    return best, told


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).options(**CSV_QUOTING).csv(path)


def scan_csv_typed(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Re-read of a processed table with an explicit schema. Large files are
    split over tasks, unless ``multi_line`` says that cells hold line ends."""
    return (spark.read.schema(schema).option("header", True).options(**CSV_QUOTING)
            .option("multiLine", multi_line).option("mode", "FAILFAST").csv(path))


def scan_split_file(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Split assignments: needs record_id and split; fold defaults to 0;
    ids are strings."""
    df = spark.read.option("header", True).options(**CSV_QUOTING).option("multiLine", multi_line).csv(path)
    missing = {"record_id", "split"} - set(df.columns)
    if missing:
        raise ValueError(f"Split file {path} must contain record_id and split columns.")
    if "fold" not in df.columns:
        df = df.withColumn("fold", F.lit(0))
    return df.withColumn("record_id", F.col("record_id").cast("string")) \
             .withColumn("fold", F.col("fold").cast("int"))


# ---------------------------------------------------------------------------
# Protocol by split-file name prefix.
PROTOCOL_PREFIXES = [("pair_stratified", "pair-stratified"),
                     ("sequence_disjoint", "sequence-disjoint"),
                     ("solvent_heldout", "solvent-held-out")]


def split_name(path_col) -> "F.Column":
    """Name of the split file: the last path element ending in .csv (a
    Spark-written folder or a plain file)."""
    return F.regexp_extract(path_col, r"([^/]+)\.csv(?:/[^/]*)?$", 1)


def protocol_from_name(stem) -> "F.Column":
    e = stem
    for prefix, proto in reversed(PROTOCOL_PREFIXES):
        e = F.when(stem.startswith(prefix), F.lit(proto)).otherwise(e)
    return e


def scan_split_files(spark: SparkSession, paths: list[str], multi_line: bool = False) -> DataFrame:
    """Several split files at once with their protocol from the name."""
    df = spark.read.option("header", True).options(**CSV_QUOTING).option("multiLine", multi_line).csv(paths)
    stem = split_name(F.col("_metadata.file_path"))
    return df.select("*", stem.alias("split_file"), protocol_from_name(stem).alias("protocol"))


# ---------------------------------------------------------------------------
# JSON, hashes, checksums
# ---------------------------------------------------------------------------
def _same_file(path):
    """A path without its scheme, to compare given paths with scanned ones."""
    return F.regexp_replace(path, "^[a-zA-Z][a-zA-Z0-9+.-]*:/{1,3}|^/", "/")


def scan_json_validate(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, valid) for every path given: a file must be one JSON document of
    any kind. An empty file, and a path that holds no file, is not valid; a
    folder stands for the files in it, each of which is a document."""
    # Every file is read whole: it is one document. Paths without rows (empty files) come from the list.
    text = spark.read.text(paths, wholetext=True)
    read = text.select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").isNotNull().alias("ok"))
    want = spark.createDataFrame([(p.rstrip("/"),) for p in paths], "given string")
    at, of = _same_file(F.col("file")), _same_file(F.col("given"))
    under = (at == of) | at.startswith(F.concat(of, F.lit("/")))
    found = want.join(read, under, "left")  # a handful of given paths
    return found.select(F.coalesce("file", "given").alias("file"), F.coalesce("ok", F.lit(False)).alias("valid"))


# MIME type by suffix.
MIME_BY_SUFFIX = [(".csv", "text/csv"), (".json", "application/json"), (".sha256", "text/plain"),
                  (".md", "text/markdown"), (".py", "text/x-python"), (".tex", "text/x-tex")]


#: What a file is, by the folder it lies in; the first prefix that fits counts.
DESCRIPTIONS = [("splits/", "Split assignments or their manifest."), ("results/", "Result of the reference models."),
                ("scripts/", "Program of the release."), ("data/metadata/", "Metadata, column dictionary or checksums."),
                ("data/processed/", "Processed table or quality report."), ("data/raw/", "Raw wide table."), ("", "File of the release.")]


def file_hash_inventory(spark: SparkSession, root: str, pattern: str = "*", descriptions: list[tuple[str, str]] | None = None) -> DataFrame:
    """(path, rel, size, sha256, encoding_format, description) of every file
    under root; ``descriptions`` are (path prefix, text) in order of priority.
    Hashing runs in the tasks that read the bytes (binaryFile source)."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
          .option("pathGlobFilter", pattern).load(root))
    rel = F.regexp_replace(F.col("path"), "^.*?\\Q" + root.rstrip("/").split("://")[-1] + "\\E/", "")
    low = F.lower(F.col("path"))
    mime = F.lit("application/octet-stream")
    for suffix, m in reversed(MIME_BY_SUFFIX):
        mime = F.when(low.endswith(suffix), F.lit(m)).otherwise(mime)
    told = F.lit(None).cast("string")
    for prefix, text in reversed(descriptions or DESCRIPTIONS):
        told = F.when(F.col("rel").startswith(prefix), F.lit(text)).otherwise(told)
    return df.select(F.col("path"), rel.alias("rel"), F.col("length").alias("size"),
                     F.sha2(F.col("content"), 256).alias("sha256"), mime.alias("encoding_format")).withColumn("description", told)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``<sha256>  <relative path>`` lines -> (rel, recorded_sha256)."""
    t = spark.read.text(path)
    m = F.regexp_extract("value", r"^([0-9a-fA-F]{64})\s+\*?(.+)$", 0)
    return t.where(m != "").select(
        F.regexp_extract("value", r"^[0-9a-fA-F]{64}\s+\*?(.+)$", 1).alias("rel"),
        F.lower(F.regexp_extract("value", r"^([0-9a-fA-F]{64})", 1)).alias("recorded_sha256"))


def checksum_verify(recorded: DataFrame, inventory: DataFrame) -> DataFrame:
    """Full outer join of recorded and recomputed digests -> status
    ok / mismatch / missing_file / unlisted_file."""
    j = recorded.join(inventory.select("rel", "sha256"), "rel", "full_outer")
    status = (F.when(F.col("sha256").isNull(), "missing_file")
              .when(F.col("recorded_sha256").isNull(), "unlisted_file")
              .when(F.col("sha256") == F.col("recorded_sha256"), "ok").otherwise("mismatch"))
    return j.select("rel", "recorded_sha256", "sha256", status.alias("status"))


def _finite(c, kind: T.DataType):
    """``c`` with every NaN or infinite number in it, at any depth, as null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: _finite(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_finite(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))
    return c


def json_safe_row(df: DataFrame) -> DataFrame:
    """NaN and infinities -> null, nested ones too (JSON has no such numbers)."""
    return df.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def sink_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; null fields are written as null."""
    json_safe_row(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def sink_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).options(**CSV_QUOTING).csv(path)
    else:
        w.format(fmt).save(path)
