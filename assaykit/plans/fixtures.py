"""Inputs derived from the driver tables.

The release's own raw and long tables are not available, so the jobs run
on tables that Spark derives from the given Parquet tables (all rows,
whole texts):

* ``wide_raw``  - a raw wide table (entities x conditions, all strings,
  messy headers and cells) from ``documents`` left-joined with ``labels``;
* ``obs``       - a labelled long table (record, sequence, condition,
  label) from ``events`` with each user's document as its sequence;
* ``scores``    - scored records for the metric jobs, from ``obs``.

Each cell rule is one SQL expression, rendered for Spark SQL
(``selectExpr``) or DuckDB so both engines see identical inputs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import with_file_row_index
from ..operators.splits import TEXT

SPARK, DUCK = "spark", "duck"

# Header text of the raw wide table (messy on purpose: CJK, dots, brackets).
H_SEQUENCE = "Sequence（含难度片段）"
H_DIFF_PRED = "难度预测"
H_DIFF_SCORE = "Difficulty Score"
H_MW = "M.W."
H_QUANTITY = "Quantity delivered"
H_HPLC = "HPLC (%)"
CONDITION_HEADERS = ["Ultrapure water", "1X DPBS", "DMSO", "Saline", "Lot note"]
H_SOURCE = "Source"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def wide_cell_exprs() -> list[tuple[str, str]]:
    """(header, SQL expression) of every raw column, in column order.
    Columns referenced: doc_id, text, lang, source, n_chars, quality, toxic."""
    return [
        (H_SEQUENCE, "CASE WHEN doc_id % 50 = 7 THEN 'N/A' ELSE text END"),
        (H_DIFF_PRED, "CASE WHEN lang = 'es' THEN 'NULL' ELSE concat(' ', upper(lang), ' ') END"),
        (H_DIFF_SCORE, f"concat('~', {_s('n_chars % 97')}, '.', {_s('doc_id % 10')})"),
        (H_MW, f"concat({_s('n_chars')}, ' Da')"),
        (H_QUANTITY, "CASE doc_id % 6 "
                     f"WHEN 0 THEN concat({_s('doc_id % 9 + 1')}, '*2.0mg') "
                     f"WHEN 1 THEN concat('4*3.0mg+', {_s('doc_id % 5')}, 'mg') "
                     "WHEN 2 THEN '3 x 5 mg' "
                     f"WHEN 3 THEN concat({_s('doc_id % 900 + 100')}, ' ug') "
                     "WHEN 4 THEN '0.5 G' ELSE '-' END"),
        (H_HPLC, "CASE doc_id % 4 "
                 f"WHEN 0 THEN concat('>', {_s('90 + doc_id % 10')}, '.', {_s('doc_id % 7')}, '%') "
                 f"WHEN 1 THEN concat({_s('80 + doc_id % 19')}, '%') "
                 "WHEN 2 THEN 'n/a' ELSE 'abc' END"),
        ("Ultrapure water", "CASE WHEN quality IS NULL THEN NULL WHEN doc_id % 7 = 3 THEN '5' "
                            "WHEN quality = 1 THEN ' Soluble ' ELSE 'INSOLUBLE' END"),
        ("1X DPBS", "CASE lang WHEN 'en' THEN (CASE WHEN toxic = 1 THEN '难溶' WHEN toxic = 0 "
                    "THEN '可溶' ELSE NULL END) WHEN 'fr' THEN 'not soluble' "
                    "WHEN 'de' THEN 'not-soluble' ELSE 'not tested' END"),
        ("DMSO", "CASE WHEN toxic IS NULL THEN '' WHEN toxic = 1 THEN 'in-soluble' "
                 "ELSE 'slightly soluble' END"),
        ("Saline", "CAST(NULL AS STRING)"),
        ("Lot note", "CASE n_chars % 3 WHEN 0 THEN 'Soluble (lot A)' WHEN 1 THEN 'insoluble' "
                     "ELSE 'pending' END"),
        (H_SOURCE, "source"),
    ]


def _quote(name: str, engine: str) -> str:
    return "`" + name.replace("`", "``") + "`" if engine == SPARK else '"' + name.replace('"', '""') + '"'


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a thin scan over all cores before CPU-heavy text work.

    A Parquet file with one row group is one scan task; the regex work
    on whole texts would then run on a single core. Only scans with fewer
    partitions than the default parallelism are reshuffled (cheap next to
    the text processing); large multi-file inputs keep their scan splits."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def wide_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw wide table: 12 string columns + ``source_row_index`` (the row's
    position in ``documents``)."""
    docs = spread(with_file_row_index(read(spark, sf_dir, "documents")))
    labels = read(spark, sf_dir, "labels")
    d = docs.join(labels, "doc_id", "left")
    exprs = [f"{e} AS {_quote(h, SPARK)}" for h, e in wide_cell_exprs()]
    return d.selectExpr("source_row_index", *exprs)


def wide_raw_sql() -> str:
    cols = ",\n  ".join(f"{e} AS {_quote(h, DUCK)}" for h, e in wide_cell_exprs())
    return ("SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS source_row_index,\n  "
            f"{cols}\nFROM documents LEFT JOIN labels USING (doc_id)")


# ---------------------------------------------------------------------------
# Long observation table
# ---------------------------------------------------------------------------
def _letters(engine: str) -> str:
    """Whole-text sequence: upper-cased ASCII letters of the document."""
    g = ", 'g'" if engine == DUCK else ""
    return f"regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z]', ''{g})"


POS_WORDS = ["Soluble", "1.0", " POS ", "true", "1"]
NEG_WORDS = ["insoluble", "0", "non-soluble", "F", "0.0"]


def obs_exprs(engine: str) -> list[tuple[str, str]]:
    pos = " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(POS_WORDS))
    neg = " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(NEG_WORDS))
    return [
        ("record_id", "CAST(event_id AS STRING)"),
        ("sequence", _letters(engine)),
        ("solvent", "event_type"),
        ("label", "CAST(CASE WHEN value >= 20 THEN 1 ELSE 0 END AS INT)"),
        ("label_raw", f"CASE WHEN value >= 20 THEN (CASE event_id % 5 {pos} END) "
                      f"ELSE (CASE event_id % 5 {neg} END) END"),
        ("event_id", "event_id"),
    ]


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_id, sequence, solvent, label, label_raw, event_id: one row per
    event; the sequence is the letters of the user's document."""
    ev = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    # each document's sequence is computed once, then joined to its events
    docs = spread(read(spark, sf_dir, "documents")).selectExpr(
        "doc_id AS user_id", f"{_letters(SPARK)} AS sequence")
    d = ev.join(docs, "user_id", "left")
    exprs = [(n, "sequence" if n == "sequence" else e) for n, e in obs_exprs(SPARK)]
    return d.selectExpr(*[f"{e} AS {n}" for n, e in exprs])


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(_text, sequence): each document's letters, by its row position."""
    docs = spread(with_file_row_index(read(spark, sf_dir, "documents").select("text"), TEXT))
    return docs.selectExpr(TEXT, f"{_letters(SPARK)} AS sequence")


def narrow_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``obs`` without texts: record_id, solvent, label, and in ``_text`` the
    row position of the document whose letters are the sequence (a negative
    number where there is none, so that such rows do not share one key).
    Texts are fetched by :func:`texts` for the rows that are returned."""
    ev = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    docs = with_file_row_index(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("user_id")), TEXT)
    e = dict(obs_exprs(SPARK))
    return ev.join(docs, "user_id", "left").selectExpr(
        *[f"{e[n]} AS {n}" for n in ("record_id", "solvent", "label")], f"coalesce({TEXT}, -1 - abs(user_id)) AS {TEXT}")


def obs_sql() -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in obs_exprs(DUCK))
    return (f"SELECT {cols} FROM events e LEFT JOIN "
            f"(SELECT doc_id AS user_id, text FROM documents) d USING (user_id)")


# ---------------------------------------------------------------------------
# Scored records for metrics
# ---------------------------------------------------------------------------
SCORE_MODELS = ["majority_class", "sequence_logistic", "sequence_solvent_random_forest"]
SCORE_PROTOCOL = "pair-stratified"
N_SCORE_FOLDS = 5


def scores_exprs() -> list[tuple[str, str]]:
    """Over (obs row x model index m). Fold 4 is made single-class (all
    labels 1) and model 0 always scores 1.0 (constant predictor)."""
    k = "((event_id * 7919 + m * 104729) % 10007)"
    p = (f"CASE WHEN m = 0 THEN CAST(1.0 AS DOUBLE) ELSE "
         f"CAST((floor(CAST({k} * 60 AS DOUBLE) / 10007) + 20 * label) AS DOUBLE) / 100 END")
    return [
        ("protocol", f"'{SCORE_PROTOCOL}'"),
        ("fold", f"CAST(event_id % {N_SCORE_FOLDS} AS INT)"),
        ("model", "CASE m " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(SCORE_MODELS))
                  + " END"),
        ("record_id", "record_id"),
        ("y", f"CAST(CASE WHEN event_id % {N_SCORE_FOLDS} = 4 THEN 1 ELSE label END AS INT)"),
        ("p", p),
    ]


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = obs(spark, sf_dir).select("record_id", "label", "event_id")
    x = base.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(len(SCORE_MODELS) - 1))))
    s = x.selectExpr(*[f"{e} AS {n}" for n, e in scores_exprs()])
    return s.withColumn("y_pred", F.when(F.col("p") >= 0.5, 1).otherwise(0).cast("int"))


def scores_sql() -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in scores_exprs())
    inner = (f"SELECT {cols} FROM ({obs_sql()}) o, "
             f"(SELECT unnest(range({len(SCORE_MODELS)})) AS m) mm")
    return f"SELECT *, CAST(CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS INT) AS y_pred FROM ({inner}) s"
