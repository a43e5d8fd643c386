"""Metric, leaderboard, sort and top-k queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import qc
from . import duck as d
from . import fixtures as fx
from . import oracle as o
from .build import DatasetBuild
from .catalog import add

KEYS = ["protocol", "fold", "model"]
SC = f"sc AS ({fx.scores_sql()})"

METRIC_CTES = SC + """,
cc AS (SELECT protocol, fold, model,
  CAST(count_if(y = 1 AND y_pred = 1) AS BIGINT) AS tp, CAST(count_if(y = 0 AND y_pred = 1) AS BIGINT) AS fp,
  CAST(count_if(y = 0 AND y_pred = 0) AS BIGINT) AS tn, CAST(count_if(y = 1 AND y_pred = 0) AS BIGINT) AS fn,
  avg(pow(least(greatest(p, 0.0), 1.0) - y, 2)) AS brier FROM sc GROUP BY protocol, fold, model),
cd AS (SELECT *, CAST(tp AS DOUBLE) AS dtp, CAST(fp AS DOUBLE) AS dfp, CAST(tn AS DOUBLE) AS dtn,
  CAST(fn AS DOUBLE) AS dfn FROM cc),
cm AS (SELECT *, dtp + dfp + dtn + dfn AS n, dtp + dfn AS pos, dtn + dfp AS neg, dtp + dfp AS ppos,
  dtn + dfn AS pneg FROM cd),
thr AS (SELECT protocol, fold, model, tp, fp, tn, fn, brier,
  (dtp + dtn) / n AS accuracy,
  (coalesce(CASE WHEN pos = 0 THEN NULL ELSE dtp / pos END, 0.0) + coalesce(CASE WHEN neg = 0 THEN NULL ELSE dtn / neg END, 0.0))
    / ((CASE WHEN pos = 0 THEN 0.0 ELSE 1.0 END) + (CASE WHEN neg = 0 THEN 0.0 ELSE 1.0 END)) AS balanced_accuracy,
  CASE WHEN ppos = 0 THEN 0.0 ELSE dtp / ppos END AS precision,
  CASE WHEN pos = 0 THEN 0.0 ELSE dtp / pos END AS recall,
  CASE WHEN 2 * dtp + dfp + dfn = 0 THEN 0.0 ELSE 2.0 * dtp / (2.0 * dtp + dfp + dfn) END AS f1,
  CASE WHEN (n * n - (ppos * ppos + pneg * pneg)) * (n * n - (pos * pos + neg * neg)) = 0 THEN 0.0
    ELSE ((dtp + dtn) * n - (pos * ppos + neg * pneg)) / sqrt((n * n - (pos * pos + neg * neg)) * (n * n - (ppos * ppos + pneg * pneg))) END AS mcc,
  CASE WHEN (pos * pneg + neg * ppos) / n = 0 THEN NULL ELSE 1.0 - (dfp + dfn) / ((pos * pneg + neg * ppos) / n) END AS kappa
  FROM cm),
ps AS (SELECT protocol, fold, model, p AS s, CAST(count_if(y = 1) AS BIGINT) AS pos,
  CAST(count_if(y = 0) AS BIGINT) AS neg FROM sc GROUP BY protocol, fold, model, p),
cum AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY protocol, fold, model ORDER BY s ROWS BETWEEN
  UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
  sum(pos) OVER (PARTITION BY protocol, fold, model ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp_at,
  sum(neg) OVER (PARTITION BY protocol, fold, model ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp_at FROM ps),
rk AS (SELECT protocol, fold, model, sum(pos) AS P, sum(neg) AS N,
  sum(CAST(pos AS DOUBLE) * (CAST(neg_below AS DOUBLE) + CAST(neg AS DOUBLE) / 2.0)) AS auc_num,
  sum(CASE WHEN pos > 0 THEN CAST(pos AS DOUBLE) * (CAST(tp_at AS DOUBLE) / CAST(tp_at + fp_at AS DOUBLE)) ELSE 0.0 END) AS ap_num
  FROM cum GROUP BY protocol, fold, model),
mt AS (SELECT t.protocol, t.fold, t.model, tp, fp, tn, fn, accuracy, balanced_accuracy, precision, recall, f1, mcc, kappa,
  CASE WHEN P > 0 AND N > 0 THEN auc_num / (CAST(P AS DOUBLE) * CAST(N AS DOUBLE)) END AS roc_auc,
  CASE WHEN P > 0 AND N > 0 THEN ap_num / CAST(P AS DOUBLE) END AS average_precision, brier
  FROM thr t LEFT JOIN rk r ON t.protocol = r.protocol AND t.fold = r.fold AND t.model = r.model),
fr0 AS (SELECT protocol, model, fold, count(*) AS c, sum(y) AS sy FROM sc GROUP BY protocol, model, fold),
fr AS (SELECT protocol, model, fold, CAST(sum(c) OVER (PARTITION BY protocol, model) - c AS BIGINT) AS n_train,
  CAST(c AS BIGINT) AS n_test,
  CAST(sum(sy) OVER (PARTITION BY protocol, model) - sy AS DOUBLE) / (sum(c) OVER (PARTITION BY protocol, model) - c) AS train_positive_rate,
  CAST(sy AS DOUBLE) / c AS test_positive_rate FROM fr0),
res AS (SELECT m.protocol, m.fold, m.model, f.n_train, f.n_test, f.train_positive_rate, f.test_positive_rate,
  m.accuracy, m.balanced_accuracy, m.precision, m.recall, m.f1, m.mcc, m.kappa, m.roc_auc, m.average_precision, m.brier
  FROM mt m JOIN fr f ON m.protocol = f.protocol AND m.fold = f.fold AND m.model = f.model),
summ AS (SELECT protocol, model, count(DISTINCT fold) AS n_folds, avg(n_train) AS mean_n_train,
  avg(n_test) AS mean_n_test, avg(train_positive_rate) AS mean_train_positive_rate,
  avg(test_positive_rate) AS mean_test_positive_rate, """ + ", ".join(
    f"avg({m}) AS {m}_mean, stddev_samp({m}) AS {m}_std" for m in M.METRICS) + """
  FROM res GROUP BY protocol, model)
"""


def scored(spark, sf):
    return fx.scores(spark, sf)


def metric_table(spark, sf):
    return M.metric_table(scored(spark, sf), KEYS)


def fold_rates(spark, sf):
    """The scored rows of a fold are its test rows; its train rows are those of
    the other folds, copied per fold as counts, not as rows."""
    s = scored(spark, sf)
    per = s.groupBy("protocol", "model", "fold", "y").agg(F.count(F.lit(1)).alias("n"))
    other = per.select("protocol", "model", F.col("fold").alias("f"), "y", "n")
    train = other.join(per.select("protocol", "model", "fold").distinct(), ["protocol", "model"]).where(F.col("f") != F.col("fold"))
    return M.fold_rates(train, per, ["protocol", "model", "fold"], n="n")


def results(spark, sf):
    m = metric_table(spark, sf)
    r = fold_rates(spark, sf)
    return m.join(r, KEYS).select(*KEYS, "n_train", "n_test", "train_positive_rate",
                                  "test_positive_rate", *M.METRICS)


def summary(spark, sf):
    return M.leaderboard_summary(results(spark, sf))


W = "WITH " + METRIC_CTES
add("confusion_counts",
    lambda s, sf: M.confusion_counts(scored(s, sf), KEYS).select(*KEYS, "tp", "fp", "tn", "fn"),
    W + "SELECT protocol, fold, model, tp, fp, tn, fn FROM mt")
for m in M.METRICS:
    add(f"metric_{m}" if m not in ("roc_auc",) else "metric_roc_auc",
        (lambda mm: lambda s, sf: M.metric_table(scored(s, sf), KEYS, [mm]).select(*KEYS, mm))(m),
        W + f"SELECT protocol, fold, model, {m} FROM mt", [m])
add("fold_rates", fold_rates,
    W + "SELECT protocol, model, fold, n_train, n_test, train_positive_rate, test_positive_rate FROM fr",
    ["train_positive_rate", "test_positive_rate"])
SUMMARY_DOUBLES = (["mean_n_train", "mean_n_test", "mean_train_positive_rate", "mean_test_positive_rate"]
                   + [f"{m}_{k}" for m in M.METRICS for k in ("mean", "std")])
add("leaderboard_summary", summary, W + "SELECT * FROM summ", SUMMARY_DOUBLES)


def _order_sql():
    pc = " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(M.PROTOCOL_ORDER))
    mc = " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(M.MODEL_ORDER))
    return (f"CAST(CASE protocol {pc} ELSE 999 END AS INTEGER) AS protocol_order, "
            f"CAST(CASE model {mc} ELSE 999 END AS INTEGER) AS model_order")


add("leaderboard_order", lambda s, sf: M.leaderboard_order(summary(s, sf)),
    W + f"SELECT *, {_order_sql()} FROM summ", SUMMARY_DOUBLES)


def _fmt(m):
    return (f"CASE WHEN {m}_mean IS NULL OR isnan({m}_mean) THEN '--' WHEN {m}_std IS NULL OR "
            f"isnan({m}_std) OR {m}_std = 0 THEN printf('%.3f', {m}_mean) ELSE "
            f"printf('%.3f +/- %.3f', {m}_mean, {m}_std) END")


add("leaderboard_display", lambda s, sf: M.leaderboard_display(summary(s, sf)),
    W + f"SELECT protocol, model, {_order_sql()}, {_fmt('roc_auc')} AS auroc, {_fmt('f1')} AS f1, "
        f"{_fmt('mcc')} AS mcc, {_fmt('accuracy')} AS accuracy FROM summ")

# ---------------------------------------------------------------------------
# 2.8 sort / top-k / distinct / subset over the build tables
# ---------------------------------------------------------------------------
B = o.build_with
from .queries import DUP_SQL  # noqa: E402


def _dc(spark, sf):
    return DatasetBuild.from_tables(spark, sf).duplicate_conflicts()


add("sort_conflicts", lambda s, sf: qc.sort_conflicts(_dc(s, sf)), B("long") + DUP_SQL)
add("topk_examples",
    lambda s, sf: DatasetBuild.from_tables(s, sf).top_conflicts(30),
    B("long") + f"SELECT * FROM ({DUP_SQL}) t ORDER BY has_conflict DESC, has_duplicate DESC, "
                f"n_records DESC, sequence_clean, solvent_name LIMIT 30")


def _top(kind: str, src: str, order: str, subject: str, detail: str) -> str:
    return (f"SELECT '{kind}' AS kind, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position, CAST({subject} AS VARCHAR) AS subject, "
            f"{detail} AS detail FROM ({src}) t QUALIFY row_number() OVER (ORDER BY {order}) <= 30")


add("report_examples", lambda s, sf: DatasetBuild.from_tables(s, sf).report_examples(),
    B("long", "feats") + ", firsts AS (SELECT sequence_id AS sid, min(source_row_index) AS row FROM clean GROUP BY 1) "
    + " UNION ALL ".join("(" + q + ")" for q in (
        _top("noncanonical", "SELECT * FROM feats JOIN firsts ON sid = sequence_id WHERE NOT is_canonical_aa", "row", "sequence_id", "noncanonical_symbols"),
        _top("conflict", f"SELECT * FROM ({DUP_SQL}) g WHERE has_conflict = 1", "n_records DESC, sequence_clean, solvent_name", "solvent_name", "labels_observed"),
        _top("unknown_label", f"SELECT * FROM cells WHERE label_raw IS NOT NULL AND {d.normalize_label('label_raw')} IS NULL",
             "source_row_index, solvent_name", "source_row_index", "solvent_name || ': ' || label_raw"))))


def _sorted_distinct(spark, sf):
    return fx.obs(spark, sf).select("solvent").distinct().orderBy("solvent")


add("sorted_distinct", _sorted_distinct,
    f"SELECT DISTINCT solvent FROM ({fx.obs_sql()}) o ORDER BY solvent")

