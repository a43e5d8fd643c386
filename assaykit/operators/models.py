"""Reference classifiers as ``pyspark.ml`` jobs.

Feature modes: ``sequence`` (54 numeric descriptors), ``condition``
(one-hot of the normalised condition; unseen conditions encode as all
zeros), ``both``; scaled for linear models, raw for trees. Every fit is
a distributed Spark job on the training rows of one fold; predictions of
all (protocol, fold, model) runs are unioned and scored in one grouped
metric pass (:func:`assaykit.operators.metrics.metric_table`).

Training rows may be distinct ones with a count ``n``, which every stage and
fit weighs as that many rows; the grid's are, and a forest's become so first.

The forest of a query or the grid scores its test rows while it grows
(:mod:`assaykit.operators.forest`). :class:`Forest` fits one that is kept, by
``pyspark.ml`` and for trees of few nodes, in parts of a few trees that run side by side: trees are
independent and votes are averaged by tree, so the parts' probabilities,
weighted by their trees, are those of one forest.

Numeric parity with other libraries is not a goal (different solvers);
the objective of the balanced logistic model is the same
(``regParam = 1/n`` with weights ``n / (2 n_class)``).
"""
from __future__ import annotations

import hashlib
import math
import threading
from collections.abc import Iterator
from concurrent.futures import Executor, ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import BASELINE_FEATURES
from ..session import materialize
from .forest import score_forest
from .ml_stages import ExactMedianImputer, PopulationScaler
from .rows import small_join

MODEL_NAMES = ["majority_class", "stratified_dummy", "sequence_logistic", "solvent_logistic",
               "sequence_solvent_logistic", "sequence_solvent_random_forest",
               "sequence_solvent_gradient_boosting"]


@dataclass
class ModelParams:
    seed: int = 2026
    logistic_max_iter: int = 5000
    forest_trees: int = 400
    forest_max_depth: int = 30          # Spark's cap; the source grows trees without limit
    forest_min_leaf: int = 2
    boosting_iters: int = 100
    boosting_depth: int = 3
    boosting_step: float = 0.1
    forest_part: int = 12               # trees of a forest fitted by one job


#: A fit is hundreds of jobs, each of which sends its statistics from every partition: as few as the rows ask for.
ROWS_A_PARTITION = 50_000


def imputer_stage(cols: list[str], weight: str | None = None) -> ExactMedianImputer:
    """Median imputation (a no-op when descriptors are never null)."""
    return ExactMedianImputer(inputCols=cols, outputCols=[f"{c}__imp" for c in cols], weightCol=weight)


def scaler_stage(cols: list[str], weight: str | None = None) -> PopulationScaler:
    return PopulationScaler(inputCols=[f"{c}__imp" for c in cols], outputCols=[f"{c}__std" for c in cols], weightCol=weight)


def feature_stages(mode: str, scaled: bool, cols: list[str] = BASELINE_FEATURES,
                   condition_col: str = "solvent_norm", imputer=None, scaler=None) -> list:
    """Stages producing the ``features`` vector for a mode. ``imputer`` and
    ``scaler`` may be fitted stages that several modes share."""
    stages = []
    parts = []
    if mode in ("sequence", "both"):
        stages.append(imputer or imputer_stage(cols))
        if scaled:
            stages.append(scaler or scaler_stage(cols))
        stages.append(VectorAssembler(inputCols=[f"{c}__{'std' if scaled else 'imp'}" for c in cols], outputCol="num"))
        parts.append("num")
    if mode in ("condition", "both"):
        stages.append(StringIndexer(inputCol=condition_col, outputCol="cond_idx", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        # The indexer's extra label for unseen conditions is the last one, which the encoder drops: all zeros.
        stages.append(OneHotEncoder(inputCol="cond_idx", outputCol="cond_oh", dropLast=True))
        parts.append("cond_oh")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return stages


def balanced_weights(train: DataFrame, label: str = "y") -> DataFrame:
    """(y, n_class, weight = n / (2 n_class)) from the training rows."""
    count = F.sum("n") if "n" in train.columns else F.count(F.lit(1))
    c = train.groupBy(label).agg(count.alias("n_class"))
    n = train.select(count).scalar()
    k = train.select(F.countDistinct(label)).scalar()
    return c.select(label, "n_class", (n / (k * F.col("n_class"))).cast("double").alias("weight"))


def with_weights(train: DataFrame, label: str = "y") -> DataFrame:
    w = balanced_weights(train, label)
    return train.join(F.broadcast(w.select(label, "weight")), label)  # one row per class


def positive(probability: str) -> Column:
    """The probability of label 1. Trained on label 0 alone, a model knows one
    class only and its vector has no place 1: the probability is 0."""
    return F.coalesce(F.get(vector_to_array(probability), F.lit(1)), F.lit(0.0))


def _p1(df: DataFrame) -> DataFrame:
    return df.withColumn("p", positive("probability")) \
             .withColumn("y_pred", F.col("prediction").cast("int"))


def hash01(seed: int, id_col: str):
    """Reproducible uniform [0, 1) draw per record."""
    h = F.md5(F.concat_ws("|", F.lit(f"dummy{seed}"), F.col(id_col).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / float(2 ** 32)


def predict_majority(train: DataFrame, test: DataFrame, label: str = "y") -> DataFrame:
    """Most frequent training label (lowest on ties); p is that label."""
    m = train.select(F.mode(label, deterministic=True)).scalar()
    return test.withColumn("y_pred", m.cast("int")).withColumn("p", m.cast("double"))


def predict_stratified_dummy(train: DataFrame, test: DataFrame, seed: int, id_col: str = "record_id",
                             label: str = "y") -> DataFrame:
    """Label drawn at the training positive rate; p is the drawn label."""
    rate = train.select(F.avg(F.col(label).cast("double"))).scalar()
    draw = F.when(hash01(seed, id_col) < rate, 1).otherwise(0)
    return test.withColumn("y_pred", draw.cast("int")).withColumn("p", draw.cast("double"))


def _logistic(train_n: int, p: ModelParams) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight",
                              regParam=1.0 / max(train_n, 1), elasticNetParam=0.0,
                              standardization=False, maxIter=p.logistic_max_iter, tol=1e-6)


def without_summary(model, spark):
    """The model as saved and loaded. A logistic model keeps its training
    summary, and with that the session, which is sent along when rows are
    scored: that fails once the session has observed a metric."""
    from ..session import scratch_path
    path = scratch_path(spark, "model")
    model.write().save(path)
    return type(model).load(path)


MODEL_MODES = {"sequence_logistic": ("sequence", True), "solvent_logistic": ("condition", True),
               "sequence_solvent_logistic": ("both", True),
               "sequence_solvent_random_forest": ("both", False),
               "sequence_solvent_gradient_boosting": ("both", False)}


def _forest(trees: int, seed: int, p: ModelParams) -> RandomForestClassifier:
    return RandomForestClassifier(featuresCol="features", labelCol="y", weightCol="weight", numTrees=trees,
                                  maxDepth=p.forest_max_depth, minInstancesPerNode=p.forest_min_leaf,
                                  featureSubsetStrategy="sqrt", seed=seed, maxMemoryInMB=1024)


def forest_parts(p: ModelParams) -> list[tuple[int, int]]:
    """(trees, seed) of the jobs that make up a forest."""
    sizes = [min(p.forest_part, p.forest_trees - at) for at in range(0, p.forest_trees, p.forest_part)]
    return [(n, p.seed + k) for k, n in enumerate(sizes)]


class Forest:
    """Fitted parts; the score is the mean vote of all their trees."""

    def __init__(self, parts: list):
        self.parts = parts

    @classmethod
    def fit(cls, train: DataFrame, p: ModelParams, pool: Executor) -> Forest:
        return cls([f.result() for f in [pool.submit(_forest(n, seed, p).fit, train) for n, seed in forest_parts(p)]])

    def transform(self, df: DataFrame) -> DataFrame:
        trees = sum(m.getNumTrees for m in self.parts)
        for k, m in enumerate(self.parts):
            df = m.copy().setRawPredictionCol("").setPredictionCol("").setProbabilityCol(f"_p{k}").transform(df)
        votes = sum((positive(f"_p{k}") * m.getNumTrees for k, m in enumerate(self.parts)), F.lit(0.0))
        p = votes / trees
        return df.withColumn("p", p).withColumn("y_pred", F.when(p > 0.5, 1).otherwise(0)).drop(*[f"_p{k}" for k in range(len(self.parts))])


def counted(train: DataFrame) -> DataFrame:
    """Training rows alike in vector and label as one, with their number
    ``n``: boosted trees draw no rows, so each weighs as its rows do, and the
    hundreds of passes of a fit read the distinct ones."""
    count = F.sum("n") if "n" in train.columns else F.count(F.lit(1))
    return train.groupBy("y", "features").agg(count.cast("double").alias("n"))


#: The name of a row's values in 128 bits: two values with one name would be one (chance about 10^-16 for 10^11 values).
NAME, VECTOR = ["_k1", "_k2"], ["_v1", "_v2"]
#: The 54 features as one array: as columns of a grouping or a hash they make code that the JVM does not compile.
PACK = "_x"


def packed(df: DataFrame) -> DataFrame:
    """``df`` with its features as one array."""
    return df.select(*[c for c in df.columns if c not in BASELINE_FEATURES], F.array(*[F.col(c).cast("double") for c in BASELINE_FEATURES]).alias(PACK))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c != PACK], *[F.get(PACK, F.lit(i)).alias(c) for i, c in enumerate(BASELINE_FEATURES)])


def named(df: DataFrame, cols: list[str], name: list[str]) -> DataFrame:
    """Packed rows with the ``name`` of their values in ``cols`` and their features; nulls are told apart by their places."""
    told = [*cols, PACK, *[F.col(c).isNull() for c in cols], F.transform(PACK, lambda x: x.isNull())]
    return df.withColumns({k: F.xxhash64(F.lit(i), *told) for i, k in enumerate(name)})


def _fewer(df: DataFrame, n: int) -> DataFrame:
    """Rows of an iterative fit in as few partitions as their number asks for."""
    return df.coalesce(max(1, math.ceil(n / ROWS_A_PARTITION)))


class Room:
    """Lets fits hold rows side by side up to a number of rows, or one fit alone."""

    def __init__(self, most: int):
        self.most, self.used, self.changed = most, 0, threading.Condition()

    @contextmanager
    def of(self, n: int) -> Iterator[None]:
        with self.changed:
            self.changed.wait_for(lambda: not self.used or self.used + n <= self.most)
            self.used += n
        try:
            yield
        finally:
            with self.changed:
                self.used -= n
                self.changed.notify_all()


#: Training vectors that iterative fits hold at a time, in memory or on the executors' disks (twice, about 1 KB in all).
HELD = Room(1_000_000)


class FoldFeatures:
    """Feature pipelines of one training set, each fitted once and shared by
    every model of that mode; medians and deviations are shared by the modes.
    Transformed training vectors are cached while an iterative fit reads them.
    Models may be fitted side by side."""

    def __init__(self, train: DataFrame, test: DataFrame):
        self.train, self.test = with_weights(train), test
        self.weight = "n" if "n" in train.columns else None
        self.rows, self.n = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)) if self.weight else F.count(F.lit(1))).first()
        self._imputer = self._scaler = None
        self._done: dict = {}
        self._one = threading.Lock()

    def _shared(self) -> dict:
        if self._imputer is None:
            self._imputer = imputer_stage(BASELINE_FEATURES, self.weight).fit(self.train)
            self._scaler = scaler_stage(BASELINE_FEATURES, self.weight).fit(self._imputer.transform(self.train))
        return {"imputer": self._imputer, "scaler": self._scaler}

    def get(self, mode: tuple):
        """The training vectors (with ``n``, ``weight`` that of all ``n`` rows) and the test rows with theirs."""
        with self._one:
            if mode not in self._done:
                told = self._shared() if mode[0] != "condition" else {}
                pm = Pipeline(stages=feature_stages(*mode, **told)).fit(self.train)
                own = ["y", (F.col("weight") * F.col("n")).alias("weight"), "n"] if self.weight else ["record_id", "y", "weight"]
                self._done[mode] = (_fewer(pm.transform(self.train).select(*own, "features"), self.rows), pm.transform(self.test))
            return self._done[mode]

    def fit(self, name: str, p: ModelParams, pool: Executor) -> DataFrame:
        """The test rows with y_pred and p of one model."""
        if name.endswith("random_forest"):
            return self._forest(p)
        tr, te = self.get(MODEL_MODES[name])
        with HELD.of(self.rows):
            boosted = not name.endswith("logistic")
            held = (counted(tr) if boosted else tr).cache()
            try:
                if not boosted:
                    return _p1(without_summary(_logistic(self.n, p).fit(held), tr.sparkSession).transform(te))
                model = GBTClassifier(featuresCol="features", labelCol="y", weightCol="n", maxIter=p.boosting_iters,
                                      maxDepth=p.boosting_depth, stepSize=p.boosting_step, seed=p.seed)
                return _p1(model.fit(_fewer(held, held.count())).transform(te))
            finally:
                held.unpersist()

    def _forest(self, p: ModelParams) -> DataFrame:
        """Fitted and scored on distinct rows, as its many passes read them;
        where rows are not distinct, such are written and test rows find their score by name."""
        train, test = self.train, self.test
        if self.weight:
            with self._one:
                imputer = self._shared()["imputer"]
        else:
            train, test = (packed(df).withColumn("first", F.monotonically_increasing_id()) for df in (train, test))
            n, first = F.count(F.lit(1)).alias("n"), F.min("first").alias("first")
            train = materialize(unpacked(train.groupBy("y", "weight", "solvent_norm", PACK).agg(n, first)), "forest_train")
            test = materialize(unpacked(named(test, ["solvent_norm"], VECTOR).groupBy(*VECTOR, "solvent_norm", PACK).agg(first)), "forest_test")
            imputer = imputer_stage(BASELINE_FEATURES, "n").fit(train)
        pm = Pipeline(stages=feature_stages("both", False, imputer=imputer)).fit(train)
        scored = score_forest(pm.transform(train), pm.transform(test), p.forest_trees, p.seed, p.forest_max_depth, p.forest_min_leaf)
        if self.weight:
            return scored
        scores = scored.select(*VECTOR, "p", "y_pred")
        return unpacked(named(packed(self.test), ["solvent_norm"], VECTOR).join(scores, VECTOR, "left").drop(*VECTOR))


#: Parts of forests that run side by side; most of a fit's jobs are short and leave cores idle.
PARALLEL_FITS = 8
#: A fit that fails, say as an executor was lost once too often, is tried again before it is an error row.
ATTEMPTS = 2


def fit_predict(name: str, train: DataFrame, test: DataFrame, p: ModelParams,
                id_col: str = "record_id") -> DataFrame:
    """Fit one model on ``train`` and return ``test`` with y_pred and p."""
    if name == "majority_class":
        return predict_majority(train, test)
    if name == "stratified_dummy":
        return predict_stratified_dummy(train, test, p.seed, id_col)
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return FoldFeatures(train, test).fit(name, p, pool)


PREDICTIONS = "protocol string, fold int, model string, record_id string, y int, y_pred int, p double"


class FitLedger:
    """Predictions of finished fits, one folder per (protocol, fold, model)
    below ``root`` in the shared folder. A run that was cut off starts again
    with the fits it lacks."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root

    @classmethod
    def of(cls, tagged: DataFrame, folds: list[tuple], params: ModelParams) -> FitLedger:
        """The ledger of these rows (names of all values, and assignments to the folds) and settings."""
        from ..session import shared_dir
        cols = sorted(tagged.columns)
        told = tagged.select(F.xxhash64(*[F.col(c) for c in cols]).alias("h")).agg(F.count("h"), F.bit_xor("h"), F.bit_xor(F.xxhash64("h", F.lit(1)))).first()
        key = hashlib.sha256(repr((cols, folds, asdict(params), tuple(told))).encode()).hexdigest()[:20]
        return cls(tagged.sparkSession, f"{shared_dir(tagged.sparkSession).rstrip('/')}/assaykit/fits-{key}")

    def _path(self, protocol: str, fold: int, model: str) -> str:
        return f"{self.root}/protocol={protocol}/fold={fold}/model={model}"

    def read(self, protocol: str, fold: int, model: str) -> DataFrame | None:
        """The written predictions, or None if the fit has not finished."""
        jvm = self.spark.sparkContext._jvm
        mark = jvm.org.apache.hadoop.fs.Path(self._path(protocol, fold, model) + "/_SUCCESS")
        if not mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
            return None
        return self.spark.read.schema(PREDICTIONS).parquet(self._path(protocol, fold, model))

    def write(self, protocol: str, fold: int, model: str, out: DataFrame) -> DataFrame:
        out.select(F.lit(protocol).alias("protocol"), F.lit(fold).cast("int").alias("fold"), F.lit(model).alias("model"), "record_id",
                   F.col("y").cast("int").alias("y"), F.col("y_pred").cast("int").alias("y_pred"), F.col("p").cast("double").alias("p")) \
           .write.mode("overwrite").option("compression", "zstd").parquet(self._path(protocol, fold, model))
        return self.read(protocol, fold, model)


#: A record's assignments to a fold are one number: how often to train, and from this on how often to test.
TEST = 2 ** 32
#: Scores of distinct rows that are broadcast to the records of their fold, in all fits at a time.
SCORED = Room(1_000_000)


def times(fold: Column) -> dict[str, Column]:
    """How often a fold's number says train and test."""
    known = F.when(fold >= 0, fold).otherwise(0)
    return {"train": known.bitwiseAND(TEST - 1), "test": F.shiftright(known, 32)}


def tagged_records(data: DataFrame, assignments: DataFrame) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The rows of ``data`` with an assignment, each once, with ``f{i}``, its
    assignments to the i-th of the (protocol, fold) in the list (-1: none).
    Assignments of a record are summed in each task before they are shuffled."""
    folds = sorted((str(r[0]), int(r[1])) for r in assignments.select("protocol", "fold").distinct().collect())
    code = F.when(F.col("split") == "train", 1).when(F.col("split") == "test", TEST).otherwise(0).cast("long")
    here = [(F.col("protocol") == p) & (F.col("fold") == f) for p, f in folds]
    sums = [F.coalesce(F.sum(F.when(x, code)), F.lit(-1)).alias(f"f{i}") for i, x in enumerate(here)]
    if not folds:
        return data.limit(0), folds
    return data.join(assignments.groupBy("record_id").agg(*sums), "record_id"), folds


def repeated(df: DataFrame, n: Column) -> DataFrame:
    """Each row ``n`` times."""
    return df.withColumn("_n", n).where("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), "_n"))).drop("_n")


def evaluate_grid(data: DataFrame, assignments: DataFrame, params: ModelParams | None = None,
                  models: list[str] | None = None, parallel_folds: int = 4,
                  ledger: FitLedger | None = None) -> tuple[DataFrame, list[tuple]]:
    """For every (protocol, fold) of ``assignments`` (record_id, protocol,
    fold, split) and every model: fit on train only, score test. A few folds
    run side by side, and in each of them its models.

    Returns the unioned predictions (protocol, fold, model, record_id, y,
    y_pred, p) and a list of error rows. Records are written once, narrow, with
    their assignments to all folds, and beside them the distinct rows of the
    other columns with their numbers in each fold: models are fitted and
    scored on these, and records find their score by name. Finished
    fits are in the ledger; those of a run before on the same rows and
    settings are not fitted again. The (protocol, fold) list is small
    (collected); each fit is a Spark job over that fold's distinct rows."""
    spark = data.sparkSession
    params = params or ModelParams()
    models = models or MODEL_NAMES
    values = ["y", "solvent_norm"]
    known = named(packed(data.select("record_id", *values, *BASELINE_FEATURES)), values, NAME)
    tagged, folds = tagged_records(known.select("record_id", "y", *NAME), assignments)
    tagged = materialize(tagged, "grid_records")
    if not folds:
        return spark.createDataFrame([], PREDICTIONS), []
    number = {pf: F.col(f"f{i}") for i, pf in enumerate(folds)}
    seen = tagged.agg(*[F.max(x >= 0) for x in number.values()]).first()
    folds = [pf for pf, any_row in zip(folds, seen) if any_row]
    if not folds:
        return spark.createDataFrame([], PREDICTIONS), []
    ledger = ledger or FitLedger.of(tagged, list(number), params)
    counts = tagged.groupBy(*NAME).agg(*[F.sum(n).alias(f"{split}{i}") for i, x in enumerate(number.values()) for split, n in times(x).items()])
    cells = materialize(unpacked(known.select(*NAME, *values, PACK).distinct().join(counts, NAME)), "grid_rows")
    n_cells = cells.count()
    parts = ThreadPoolExecutor(PARALLEL_FITS)  # of the forests of all folds

    def of_split(pf, split):
        """The records of a fold's split, and the distinct rows with their number ``n``."""
        records = repeated(tagged.select("record_id", "y", *NAME, times(number[pf])[split].alias("n")), F.col("n")).drop("n")
        n = F.col(f"{split}{list(number).index(pf)}")
        return records, cells.where(n > 0).select(*NAME, *values, *BASELINE_FEATURES, n.alias("n"))

    def run_model(proto, fold, m, features):
        """The written predictions of one fit, or its error."""
        records = {split: of_split((proto, fold), split)[0] for split in ("train", "test")}
        for left in reversed(range(ATTEMPTS)):
            try:
                if m not in MODEL_MODES:
                    return ledger.write(proto, fold, m, fit_predict(m, records["train"], records["test"], params)), None
                scores = features.fit(m, params, parts).select(*NAME, "y_pred", "p")
                # Written here, so that an error at scoring time is this model's own.
                with SCORED.of(n_cells):
                    return ledger.write(proto, fold, m, small_join(records["test"], scores, NAME, rows=n_cells, limit=SCORED.most)), None
            except Exception as e:  # one failing model leaves an error row and the rest
                if not left:
                    return None, (proto, fold, m, repr(e))

    def run_fold(pf):
        proto, fold = pf
        done = {m: ledger.read(proto, fold, m) for m in models}
        todo = [m for m in models if done[m] is None]
        errors = []
        if todo:
            train, test = (of_split(pf, split)[1] for split in ("train", "test"))
            if train.isEmpty() or test.isEmpty():
                return [], [(proto, fold, "__split__", "no train rows or no test rows among the records")]
            features = FoldFeatures(train, test.drop("n"))
            with ThreadPoolExecutor(len(todo)) as fits:
                for m, (rows, error) in zip(todo, fits.map(lambda m: run_model(proto, fold, m, features), todo)):
                    done[m] = rows
                    errors += [error] if error else []
        return [d for d in done.values() if d is not None], errors

    # folds are independent Spark jobs; a few run concurrently from the driver
    preds, errors = [], []
    with parts, ThreadPoolExecutor(max_workers=max(1, parallel_folds)) as pool:
        for p_list, e_list in pool.map(run_fold, folds):
            preds += p_list
            errors += e_list
    if not preds:
        return spark.createDataFrame([], PREDICTIONS), errors
    return _union(preds), errors


def grid_results(data: DataFrame, assignments: DataFrame, predictions: DataFrame, errors: list[tuple]) -> DataFrame:
    """One row per (protocol, fold, model): sizes and positive rates of the
    fold's train and test rows, the metrics, and ``error`` (null if it ran)."""
    from .metrics import METRICS, fold_rates, metric_table
    keys = ["protocol", "fold"]
    rows, folds = tagged_records(data.select("record_id", "y"), assignments)
    each = [F.struct(F.lit(p).alias("protocol"), F.lit(f).alias("fold"), *[n.alias(s) for s, n in times(F.col(f"f{i}")).items()]) for i, (p, f) in enumerate(folds)]
    # Counted by label first: a few rows for each fold.
    cast = "array<struct<protocol:string,fold:int,train:bigint,test:bigint>>"
    counted_rows = rows.select("y", F.explode(F.array(*each).cast(cast)).alias("x")).groupBy("y", "x.protocol", "x.fold").agg(F.sum("x.train").alias("train"), F.sum("x.test").alias("test"))
    counted_rows = materialize(counted_rows, "grid_sizes")
    rates = fold_rates(*[counted_rows.where(F.col(s) > 0).withColumnRenamed(s, "n") for s in ("train", "test")], keys, "n")
    scored = metric_table(predictions, [*keys, "model"]).withColumn("error", F.lit(None).cast("string"))
    failed = data.sparkSession.createDataFrame(errors, "protocol string, fold int, model string, error string")
    both = scored.unionByName(failed, allowMissingColumns=True)
    sizes = ["n_train", "n_test", "train_positive_rate", "test_positive_rate"]
    return both.join(rates, keys, "left").select(*keys, "model", *sizes, *METRICS, "error")


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out
