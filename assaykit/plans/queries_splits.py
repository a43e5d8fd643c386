"""Split protocols, joins and split aggregates over the ``obs`` table."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as SP
from ..session import materialize
from . import fixtures as fx
from .catalog import add

SEED = 2026
K = 5


def records(spark, sf, with_keys=False):
    """The narrow records, written once for all steps that read them; ``with_keys``: as :func:`keyed` gives them."""
    rec = materialize(fx.narrow_obs(spark, sf), "records")
    return keyed(spark, sf, rec) if with_keys else rec


def keyed(spark, sf, rec):
    """The narrow records with the key and the digests of their sequences,
    which are computed once for each document."""
    seeds = [SEED, SEED + 1]
    return SP.with_keys(rec, materialize(SP.keyed_texts(fx.texts(spark, sf), seeds), "sequence_keys"), seeds)


# ---------------------------------------------------------------------------
# DuckDB rendering of the digest split rule
# ---------------------------------------------------------------------------
REC = f"rec AS (SELECT record_id, sequence, solvent, label FROM ({fx.obs_sql()}) o)"


def _dg(seed: int, col: str) -> str:
    return f"md5('{seed}|' || CAST({col} AS VARCHAR))"


def holdout_sql(src: str, id_col: str, strat: str, seed: int, out: str) -> str:
    """CTEs ending in ``out``(id, split) for a holdout over table ``src``."""
    return f""",
{out}_c AS (SELECT {strat} AS s0, count(*) AS n FROM {src} GROUP BY 1),
{out}_t AS (SELECT sum(n) AS tot, count(*) AS k, min(n) AS mn FROM {out}_c),
{out}_w AS (SELECT x.{id_col} AS id, CASE WHEN (SELECT k >= 2 AND mn >= 2 FROM {out}_t)
            THEN CAST(x.{strat} AS VARCHAR) ELSE '0' END AS s FROM {src} x),
{out}_c1 AS (SELECT s, count(*) AS n FROM {out}_w GROUP BY s),
{out}_nt AS (SELECT CAST((15 * sum(n) + 99) // 100 AS BIGINT) AS nt, sum(n) AS tot FROM {out}_c1),
{out}_a1 AS (SELECT s, n, (n * nt) // tot AS fl, (n * nt) % tot AS fr, nt FROM {out}_c1, {out}_nt),
{out}_a1r AS (SELECT s, n, fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, s) <=
              nt - sum(fl) OVER () THEN 1 ELSE 0 END AS alloc FROM {out}_a1),
{out}_r1 AS (SELECT w.id, w.s, row_number() OVER (PARTITION BY w.s ORDER BY {_dg(seed, 'w.id')}, w.id)
             AS r FROM {out}_w w),
{out}_t1 AS (SELECT r.id, r.s, r.r <= a.alloc AS is_test FROM {out}_r1 r JOIN {out}_a1r a USING (s)),
{out}_rest AS (SELECT id, s FROM {out}_t1 WHERE NOT is_test),
{out}_c2 AS (SELECT s, count(*) AS n FROM {out}_rest GROUP BY s),
{out}_f2 AS (SELECT (SELECT count(*) FROM {out}_c1) > 1 AND count(*) >= 2 AND min(n) >= 2 AS ok
             FROM {out}_c2),
{out}_rest2 AS (SELECT id, CASE WHEN (SELECT ok FROM {out}_f2) OR (SELECT count(*) FROM {out}_c1) = 1
                THEN s ELSE '0' END AS s FROM {out}_rest),
{out}_c3 AS (SELECT s, count(*) AS n FROM {out}_rest2 GROUP BY s),
{out}_nv AS (SELECT CAST((3 * sum(n) + 16) // 17 AS BIGINT) AS nv, sum(n) AS tot FROM {out}_c3),
{out}_a2 AS (SELECT s, (n * nv) // tot AS fl, (n * nv) % tot AS fr, nv FROM {out}_c3, {out}_nv),
{out}_a2r AS (SELECT s, fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, s) <=
              nv - sum(fl) OVER () THEN 1 ELSE 0 END AS alloc FROM {out}_a2),
{out}_r2 AS (SELECT x.id, x.s, row_number() OVER (PARTITION BY x.s ORDER BY {_dg(seed + 1, 'x.id')}, x.id)
             AS r FROM {out}_rest2 x),
{out} AS (SELECT id, 'test' AS split FROM {out}_t1 WHERE is_test
          UNION ALL SELECT r.id, CASE WHEN r.r <= a.alloc THEN 'val' ELSE 'train' END
          FROM {out}_r2 r JOIN {out}_a2r a USING (s))"""


def kfold_sql(src: str, id_col: str, strat: str, seed: int, out: str, k: int = K) -> str:
    """CTEs ending in ``out``(id, fold_id)."""
    return f""",
{out}_c AS (SELECT {strat} AS s0, count(*) AS n FROM {src} GROUP BY 1),
{out}_ok AS (SELECT count(*) >= 2 AND min(n) >= {k} AS ok FROM {out}_c),
{out}_w AS (SELECT x.{id_col} AS id, CASE WHEN (SELECT ok FROM {out}_ok)
            THEN CAST(x.{strat} AS VARCHAR) ELSE '0' END AS s FROM {src} x),
{out}_c1 AS (SELECT s, count(*) AS n FROM {out}_w GROUP BY s),
{out}_st AS (SELECT s, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND
             1 PRECEDING), 0) AS start FROM {out}_c1),
{out}_r AS (SELECT w.id, w.s, row_number() OVER (PARTITION BY w.s ORDER BY {_dg(seed, 'w.id')}, w.id)
            AS r FROM {out}_w w),
{out} AS (SELECT r.id, CAST((st.start + r.r - 1) % {k} AS INTEGER) AS fold_id
          FROM {out}_r r JOIN {out}_st st USING (s))"""


def kfold_expand(assign: str, k: int = K) -> str:
    return (f"SELECT a.id, f.fold, CASE WHEN a.fold_id = f.fold THEN 'test' WHEN a.fold_id = "
            f"(f.fold + 1) % {k} THEN 'val' ELSE 'train' END AS split FROM {assign} a, "
            f"(SELECT CAST(unnest(range({k})) AS INTEGER) AS fold) f")


GROUPS = ("grp AS (SELECT sequence, CASE WHEN count(DISTINCT label) > 1 THEN 'mixed' WHEN avg(label) "
          ">= 0.5 THEN 'positive' ELSE 'negative' END AS group_label FROM rec GROUP BY sequence)")
CTX = "record_id, fold, split, sequence, solvent, label"


def pair_holdout_sql():
    return ("WITH " + REC + holdout_sql("rec", "record_id", "label", SEED, "ph") +
            f" SELECT r.record_id, CAST(0 AS INTEGER) AS fold, h.split, r.sequence, r.solvent, r.label "
            f"FROM ph h JOIN rec r ON h.id = r.record_id")


def pair_kfold_sql():
    return ("WITH " + REC + kfold_sql("rec", "record_id", "label", SEED, "pk") +
            f", x AS ({kfold_expand('pk')}) SELECT r.record_id, x.fold, x.split, r.sequence, r.solvent, "
            f"r.label FROM x JOIN rec r ON x.id = r.record_id")


def group_holdout_sql():
    return ("WITH " + REC + ", " + GROUPS + holdout_sql("grp", "sequence", "group_label", SEED, "gh") +
            " SELECT r.record_id, CAST(0 AS INTEGER) AS fold, g.split, r.sequence, r.solvent, r.label "
            "FROM rec r JOIN gh g ON g.id = r.sequence")


def group_kfold_sql():
    return ("WITH " + REC + ", " + GROUPS + kfold_sql("grp", "sequence", "group_label", SEED, "gk") +
            f", x AS ({kfold_expand('gk')}) SELECT r.record_id, x.fold, x.split, r.sequence, r.solvent, "
            f"r.label FROM rec r JOIN x ON x.id = r.sequence")


def loco_sql():
    return ("WITH " + REC + ", conds AS (SELECT solvent, CAST(row_number() OVER (ORDER BY solvent) - 1 "
            "AS INTEGER) AS i FROM (SELECT DISTINCT solvent FROM rec)), nc AS (SELECT count(*) AS n "
            "FROM conds), folds AS (SELECT c.i AS fold, c.solvent AS t, v.solvent AS v FROM conds c "
            "JOIN conds v ON v.i = (c.i + 1) % (SELECT n FROM nc)) SELECT r.record_id, f.fold, CASE "
            "WHEN r.solvent = f.t THEN 'test' WHEN r.solvent = f.v THEN 'val' ELSE 'train' END AS split, "
            "f.t AS heldout_test_solvent, f.v AS heldout_val_solvent, r.sequence, r.solvent, r.label "
            "FROM rec r, folds f")


add("split_pair_holdout", lambda s, sf: SP.split_pair_holdout(records(s, sf), SEED, fx.texts(s, sf)), pair_holdout_sql())
add("split_pair_kfold", lambda s, sf: SP.split_pair_kfold(records(s, sf), SEED, K, fx.texts(s, sf)), pair_kfold_sql())
add("split_group_holdout", lambda s, sf: SP.split_group_holdout(records(s, sf, True), SEED, fx.texts(s, sf)), group_holdout_sql())
add("split_group_kfold", lambda s, sf: SP.split_group_kfold(records(s, sf, True), SEED, K, fx.texts(s, sf)), group_kfold_sql())
add("split_leave_one_condition_out", lambda s, sf: SP.split_leave_one_condition_out(SP.with_texts(records(s, sf), fx.texts(s, sf))),
    loco_sql())
add("split_fold_extract",
    lambda s, sf: SP.split_fold_extract(SP.split_leave_one_condition_out(SP.with_texts(records(s, sf), fx.texts(s, sf))), 0),
    f"SELECT * FROM ({loco_sql()}) t WHERE fold = 0")
add("union_folds",
    lambda s, sf: _union_folds(s, sf),
    pair_kfold_sql())


def _union_folds(spark, sf):
    """Stack per-fold tables (one projection per fold, then unionByName). The
    folds are of narrow rows, written once; the texts are joined to their union."""
    a = materialize(SP.pair_folds(records(spark, sf), SEED, K), "pair_folds")
    parts = []
    for i in range(K):
        split = (F.when(F.col("fold_id") == i, "test").when(F.col("fold_id") == (i + 1) % K, "val")
                 .otherwise("train"))
        parts.append(a.select("record_id", F.lit(i).cast("int").alias("fold"), split.alias("split"),
                              *SP.context(a)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return SP.with_texts(out, fx.texts(spark, sf)).select("record_id", "fold", "split", *SP.CONTEXT)


# ---------------------------------------------------------------------------
# Split aggregates
# ---------------------------------------------------------------------------
SUMMARY_SQL = ("SELECT fold, split, count(*) AS n_records, avg(CAST(label AS DOUBLE)) AS positive_rate, "
               "CAST(sum(label) AS BIGINT) AS n_positive, CAST(sum(1 - label) AS BIGINT) AS n_negative, "
               "count(DISTINCT sequence) AS n_unique_sequences, count(DISTINCT solvent) AS "
               "n_unique_solvents FROM ({}) t GROUP BY fold, split")
add("split_summary", lambda s, sf: SP.split_summary(SP.split_group_kfold(records(s, sf, True), SEED, K)),
    SUMMARY_SQL.format(group_kfold_sql()), ["positive_rate"])


def _glc(spark, sf):
    g = SP.group_label_class(records(spark, sf, True), SP.KEY, "label")
    return g.select(F.nullif(F.col(SP.KEY), F.lit("null")).alias("sequence_key"), "mean", "count", "nunique", "group_label")


add("group_label_class", _glc,
    "WITH " + REC + " SELECT sha1(sequence) AS sequence_key, avg(label) AS mean, count(label) AS count, "
    "count(DISTINCT label) AS nunique, CASE WHEN count(DISTINCT label) > 1 THEN 'mixed' WHEN "
    "avg(label) >= 0.5 THEN 'positive' ELSE 'negative' END AS group_label FROM rec GROUP BY sequence",
    ["mean"])


def _feasible(spark, sf):
    rec = records(spark, sf, True)
    rows = []
    for name, df, col in [("label", rec, "label"),
                          ("group_label", SP.group_label_class(rec, SP.KEY, "label"), "group_label"),
                          ("solvent", rec, "solvent")]:
        counts = SP.stratum_counts(df, col)
        rows.append((name, len(counts), min(n for _, n in counts),
                     SP.stratify_feasible(counts, 2), SP.stratify_feasible(counts, K)))
    return spark.createDataFrame(rows, "stratum string, n_classes long, min_count long, "
                                       "holdout_ok boolean, kfold_ok boolean")


def _feasible_sql():
    parts = []
    for name, src, col in [("label", "rec", "label"), ("group_label", "grp", "group_label"),
                           ("solvent", "rec", "solvent")]:
        parts.append(f"SELECT '{name}' AS stratum, count(*) AS n_classes, min(n) AS min_count, "
                     f"count(*) >= 2 AND min(n) >= 2 AS holdout_ok, count(*) >= 2 AND min(n) >= {K} "
                     f"AS kfold_ok FROM (SELECT {col}, count(*) AS n FROM {src} GROUP BY {col})")
    return "WITH " + REC + ", " + GROUPS + " " + " UNION ALL ".join(parts)


add("stratify_feasible", _feasible, _feasible_sql())


def _assign(spark, sf):
    rec = records(spark, sf)
    t = SP.split_pair_holdout(rec, SEED)
    ids = {k: t.where(F.col("split") == k).select("record_id") for k in ("train", "val", "test")}
    a = materialize(SP.assign_splits(rec, ids["train"], ids["val"], ids["test"]), "assignment")
    SP.require_covered(a)
    return a


add("assign_splits", _assign, "WITH x AS (" + pair_holdout_sql() + ") SELECT record_id, fold, split FROM x")

# ---------------------------------------------------------------------------
# 2.5 joins and membership
# ---------------------------------------------------------------------------


def _ctx(spark, sf):
    rec = records(spark, sf)
    t = SP.split_pair_holdout(rec, SEED).select("record_id", "fold", "split")
    return SP.with_texts(SP.add_context(t, rec), fx.texts(spark, sf)).select("record_id", "fold", "split", *SP.CONTEXT)


add("join_split_context", _ctx, pair_holdout_sql())


def _match(spark, sf):
    rec = records(spark, sf)
    t = SP.split_fold_extract(SP.split_leave_one_condition_out(rec), 0)
    return SP.match_split(t, rec).select("record_id", "split", "label")


add("match_split_to_data", _match,
    f"SELECT t.record_id, t.split, r.label FROM ({loco_sql()}) t JOIN ({fx.obs_sql()}) r "
    f"ON t.record_id = r.record_id WHERE t.fold = 0")


def _semi(spark, sf):
    rec = records(spark, sf, True)
    test_keys = SP.group_holdout_keys(rec, SEED).where(F.col("split") == "test").select("_seq_key")
    return SP._keyed(rec).join(test_keys, "_seq_key", "left_semi").select("record_id", "solvent", "label")


add("semi_join_groups", _semi,
    "WITH " + REC + ", " + GROUPS + holdout_sql("grp", "sequence", "group_label", SEED, "gh") +
    " SELECT record_id, solvent, label FROM rec WHERE sequence IN (SELECT id FROM gh WHERE split = 'test')")


def _anti(spark, sf):
    rec = records(spark, sf)
    held = SP.pair_holdout_ids(rec, SEED).where(F.col("split").isin("test", "val")).select("record_id")
    return rec.join(held, "record_id", "left_anti").select("record_id", "label")


add("anti_join_remainder", _anti,
    "WITH x AS (" + pair_holdout_sql() + ") SELECT record_id, label FROM x WHERE split = 'train'")


def _remainder(rec):
    return rec.select("record_id").exceptAll(SP.pair_holdout_ids(rec, SEED).where(F.col("split") != "train").select("record_id"))


add("set_difference",
    lambda s, sf: _remainder(records(s, sf)),
    "WITH x AS (" + pair_holdout_sql() + ") SELECT record_id FROM x WHERE split = 'train'")
