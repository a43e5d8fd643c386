"""Binary classification metrics as grouped DataFrame aggregates.

Input: one row per scored record with group keys (e.g. protocol, fold,
model), the true label ``y`` (0/1), the predicted label ``y_pred`` and a
score ``p``. Output: one row per group.

* threshold metrics come from the four confusion counts (one
  aggregate);
* AUC (ties get half credit) and average precision (step sum over
  distinct thresholds) first collapse rows to distinct (group, score)
  pairs, then take running sums of positives/negatives over the score
  order (:func:`assaykit.operators.rows.running_sums`): ranges of
  (group, score) with sampled splitters, so neither a group with a third
  of all rows nor scores crowded in one spot are one task.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import running_sums

METRICS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "mcc", "kappa",
           "roc_auc", "average_precision", "brier"]
RANKING = ["roc_auc", "average_precision"]


def _d(c):
    return F.col(c).cast("double")


def confusion_counts(scored: DataFrame, keys: list[str]) -> DataFrame:
    y, yp = F.col("y"), F.col("y_pred")
    return scored.groupBy(*keys).agg(
        F.count_if((y == 1) & (yp == 1)).alias("tp"),
        F.count_if((y == 0) & (yp == 1)).alias("fp"),
        F.count_if((y == 0) & (yp == 0)).alias("tn"),
        F.count_if((y == 1) & (yp == 0)).alias("fn"),
        F.avg(F.pow(F.least(F.greatest(_d("p"), F.lit(0.0)), F.lit(1.0)) - _d("y"), 2)).alias("brier"))


def threshold_metrics(cc: DataFrame) -> DataFrame:
    """accuracy, balanced accuracy (mean recall over classes present in
    y), precision/recall/F1 (0 when undefined), MCC (0 when a marginal is
    empty) and Cohen's kappa (null when chance agreement is total)."""
    tp, fp, tn, fn = _d("tp"), _d("fp"), _d("tn"), _d("fn")
    n = tp + fp + tn + fn
    pos, neg = tp + fn, tn + fp            # true marginals
    ppos, pneg = tp + fp, tn + fn          # predicted marginals
    rec1 = F.try_divide(tp, pos)
    rec0 = F.try_divide(tn, neg)
    bal = F.try_divide(F.coalesce(rec1, F.lit(0.0)) + F.coalesce(rec0, F.lit(0.0)),
                       F.when(rec1.isNotNull(), 1.0).otherwise(0.0)
                       + F.when(rec0.isNotNull(), 1.0).otherwise(0.0))
    cov_ytyp = (tp + tn) * n - (pos * ppos + neg * pneg)
    cov_ypyp = n * n - (ppos * ppos + pneg * pneg)
    cov_ytyt = n * n - (pos * pos + neg * neg)
    mcc = F.when(cov_ypyp * cov_ytyt == 0, F.lit(0.0)).otherwise(
        cov_ytyp / F.sqrt(cov_ytyt * cov_ypyp))
    expected_off = F.try_divide(pos * pneg + neg * ppos, n)
    kappa = F.when(expected_off == 0, F.lit(None).cast("double")).otherwise(
        1.0 - F.try_divide(fp + fn, expected_off))
    return cc.select(
        "*",
        F.try_divide(tp + tn, n).alias("accuracy"),
        bal.alias("balanced_accuracy"),
        F.coalesce(F.try_divide(tp, ppos), F.lit(0.0)).alias("precision"),
        F.coalesce(rec1, F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        mcc.alias("mcc"),
        kappa.alias("kappa"))


def ranking_metrics(scored: DataFrame, keys: list[str]) -> DataFrame:
    """roc_auc and average_precision per group; null for one-class groups."""
    per_score = scored.groupBy(*keys, F.col("p").cast("double").alias("s")).agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    j = running_sums(per_score, keys, "s", ["pos", "neg"]).select(
        *keys, "s", "pos", "neg", F.col("neg_below"),
        (F.col("pos_total") - F.col("pos_below")).alias("tp_at"),
        (F.col("neg_total") - F.col("neg_below")).alias("fp_at"))
    g = j.groupBy(*keys).agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(_d("pos") * (_d("neg_below") + _d("neg") / 2.0)).alias("_auc_num"),
        F.sum(F.when(F.col("pos") > 0, _d("pos") * F.try_divide(_d("tp_at"), _d("tp_at") + _d("fp_at")))
              .otherwise(F.lit(0.0))).alias("_ap_num"))
    two = (F.col("P") > 0) & (F.col("N") > 0)
    return g.select(
        *keys,
        F.when(two, F.col("_auc_num") / (_d("P") * _d("N"))).alias("roc_auc"),
        F.when(two, F.col("_ap_num") / _d("P")).alias("average_precision"))


def metric_table(scored: DataFrame, keys: list[str], metrics: list[str] = METRICS) -> DataFrame:
    """The metrics asked for per group (plus the confusion counts); the
    ranking side is built only for those that rank."""
    out = threshold_metrics(confusion_counts(scored, keys))
    if set(metrics) & set(RANKING):
        out = out.join(ranking_metrics(scored, keys), keys, "left")
    return out.select(*keys, "tp", "fp", "tn", "fn", *metrics)


def fold_rates(train: DataFrame, test: DataFrame, keys: list[str], n: str | None = None) -> DataFrame:
    """n_train, n_test and the positive rate of each side per group. ``n``
    names a column of counts where a row stands for several records."""
    count = F.sum(n) if n else F.count(F.lit(1))
    positive = F.sum(_d("y") * F.col(n)) if n else F.sum(_d("y"))

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(count.cast("long").alias(f"n_{name}"),
                                     F.try_divide(positive, count).alias(f"{name}_positive_rate"))

    return side(train, "train").join(side(test, "test"), keys, "full")


def leaderboard_summary(results: DataFrame, keys=("protocol", "model")) -> DataFrame:
    """Per (protocol, model): folds, mean sizes and rates, mean and sample
    std of each metric over folds (nulls and NaN skipped; one fold -> null
    std)."""
    keys = list(keys)
    aggs = [F.countDistinct("fold").alias("n_folds"),
            F.avg("n_train").alias("mean_n_train"), F.avg("n_test").alias("mean_n_test"),
            F.avg("train_positive_rate").alias("mean_train_positive_rate"),
            F.avg("test_positive_rate").alias("mean_test_positive_rate")]
    for m in METRICS:
        v = F.when(F.isnan(_d(m)), F.lit(None)).otherwise(_d(m))
        aggs += [F.avg(v).alias(f"{m}_mean"), F.stddev_samp(v).alias(f"{m}_std")]
    return results.groupBy(*keys).agg(*aggs)


# ---------------------------------------------------------------------------
# Ordering and display of the leaderboard
# ---------------------------------------------------------------------------
# Display order of protocols and models.
PROTOCOL_ORDER = ["pair-stratified", "sequence-disjoint", "solvent-held-out"]
MODEL_ORDER = ["majority_class", "stratified_dummy", "sequence_logistic", "solvent_logistic",
               "sequence_solvent_logistic", "sequence_solvent_random_forest",
               "sequence_solvent_gradient_boosting"]


def _rank_of(col: str, names: list[str]):
    e = F.lit(999)
    for i, n in reversed(list(enumerate(names))):
        e = F.when(F.col(col) == n, F.lit(i)).otherwise(e)
    return e


def leaderboard_order(summary: DataFrame) -> DataFrame:
    return (summary.withColumn("protocol_order", _rank_of("protocol", PROTOCOL_ORDER))
            .withColumn("model_order", _rank_of("model", MODEL_ORDER))
            .orderBy("protocol_order", "model_order", "model"))


def format_mean_std(mean: str, std: str, decimals: int = 3):
    """'--' when null; 3 decimals; ' +/- std' only when std > 0."""
    m, s = F.col(mean), F.col(std)
    fm = F.format_string(f"%.{decimals}f", m)
    both = F.format_string(f"%.{decimals}f +/- %.{decimals}f", m, s)
    return (F.when(m.isNull() | F.isnan(m), F.lit("--"))
            .when(s.isNull() | F.isnan(s) | (s == 0), fm).otherwise(both))


def leaderboard_display(summary: DataFrame) -> DataFrame:
    return leaderboard_order(summary).select(
        "protocol", "model", "protocol_order", "model_order",
        format_mean_std("roc_auc_mean", "roc_auc_std").alias("auroc"),
        format_mean_std("f1_mean", "f1_std").alias("f1"),
        format_mean_std("mcc_mean", "mcc_std").alias("mcc"),
        format_mean_std("accuracy_mean", "accuracy_std").alias("accuracy"))
