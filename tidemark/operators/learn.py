"""Learning operators on pyspark.ml: walk-forward models, calibration, stacking.

Walk-forward rows are written once, and each fold is a filter on their dates. Folds are fitted side by side: a boosting round or a gradient step is a short job, so one fold alone waits for
the driver most of the time.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.windows import sequences
from tidemark.operators.evaluate import auc, blend, scaled
from tidemark.operators.folds import fold_stats, spans
from tidemark.operators.scratch import materialise, scratch
from tidemark.plans.labels import validation_split

#: Folds that are fitted at a time, and rows of a training task where there are fewer than the session's partitions can share.
SIDE_BY_SIDE, TASK_ROWS = 4, 8_000


def probability(model, df: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.drop("probability", "rawPrediction", "prediction", "features")


@dataclass(frozen=True)
class Fold:
    """A fold's days and what its train rows hold: rows of each class, and the least and largest value of each column."""

    fold: int
    cut: datetime.date
    first: datetime.date
    last: datetime.date
    n_pos: int
    n_neg: int
    low: dict[str, float]
    high: dict[str, float]

    @property
    def weight(self) -> float:
        """What a positive weighs, so that both classes weigh the same."""
        return max(self.n_neg / max(self.n_pos, 1), 1e-6)

    def train(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("date") <= F.lit(self.cut))

    def test(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("date").between(F.lit(self.first), F.lit(self.last)))


def fold_list(rows: DataFrame, folds: DataFrame, columns: list[str] = ()) -> list[Fold]:
    """The folds that have train and test rows. Their statistics are one pass over the rows; what comes to the driver is a row per fold and role."""
    found = {(r["fold"], r["role"]): r for r in fold_stats(rows, folds, columns).collect()}
    out = []
    for fold, cut, first, last in spans(folds):
        if (fold, "train") in found and (fold, "test") in found:
            r = found[fold, "train"]
            out.append(Fold(fold, cut, first, last, r["n_pos"], r["n_neg"], {c: r[f"{c}_min"] for c in columns}, {c: r[f"{c}_max"] for c in columns}))
    return out


def side_by_side(spark: SparkSession, folds: list[Fold], fit: Callable[[Fold], object]) -> list:
    """fit of each fold, a few at a time, in threads that keep the session's job groups, tags and properties."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return list(pool.map(inheritable_thread_target(spark)(fit), folds))


def in_tasks(rows: DataFrame, n: int) -> DataFrame:
    """No more partitions than give each task some thousand rows, where there are few rows: an iteration costs one task a partition."""
    return rows.coalesce(max(1, math.ceil(n / TASK_ROWS))) if n < TASK_ROWS * rows.sparkSession.sparkContext.defaultParallelism else rows


def checkpoints(spark: SparkSession) -> None:
    """Boosting cuts its lineage every ten rounds, in the shared folder; without one its tasks grow with the rounds."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{scratch(spark)}/tidemark-rounds")


def fit_trees(train: DataFrame, fold: Fold, rounds: int = 300, validation: float | None = None):
    """Boosted trees on rows (date, label, features); Spark samples columns at each node and has no ridge term on leaves.

    validation: the share of the train days that are fitted on; the rest stop the rounds once they no longer improve. All rounds run without it.
    """
    rows = train.select("date", "features", F.col("label").cast("double").alias("label"), F.when(F.col("label") == 1, fold.weight).otherwise(1.0).alias("weight"))
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=4, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=5, seed=42)
    if validation is not None:
        rows = validation_split(rows, validation).withColumn("later", F.col("part") == "validation")
        trees = trees.setValidationIndicatorCol("later")
    checkpoints(train.sparkSession)
    return trees.fit(in_tasks(rows, fold.n_pos + fold.n_neg))


def out_of_fold(rows: DataFrame, folds: list[Fold], models: list, inputs: Callable[[DataFrame, Fold], DataFrame]) -> DataFrame:
    """(date, ticker, label, fold, p) of the test rows of all folds."""
    out = rows.where("false").select("date", "ticker", "label", F.lit(0).alias("fold"), F.lit(0.0).alias("p"))
    for fold, model in zip(folds, models, strict=True):
        out = out.unionByName(probability(model, inputs(fold.test(rows), fold)).select("date", "ticker", "label", F.lit(fold.fold).alias("fold"), "p"))
    return out


def walk_forward_trees(pooled: DataFrame, folds: DataFrame, columns: list[str], rounds: int = 300, validation: float | None = None) -> DataFrame:
    """(date, ticker, label, fold, p): each fold's model sees only rows before its purged cut. Folds without train or test rows are left out."""
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(pooled.select("date", "ticker", "label", *columns))
    rows = materialise(rows.select("date", "ticker", "label", "features").repartitionByRange("date"), "pool")  # files of neighbouring days: a fold opens its own
    known = fold_list(rows, folds)
    models = side_by_side(rows.sparkSession, known, lambda f: fit_trees(f.train(rows), f, rounds, validation))
    return out_of_fold(rows, known, models, lambda x, _: x)


def scaled_sequence(fold: Fold, columns: list[str]) -> Column:
    """The windows' features in units of the fold's train range, as one vector. Scaling is a line per column, so it is applied to ready windows."""
    low = F.array(*[F.lit(float(fold.low[c])) for c in columns])
    width = F.array(*[F.lit(float(fold.high[c] - fold.low[c]) or 1.0) for c in columns])
    flat = F.flatten(F.transform("sequence", lambda row: F.transform(row, lambda x, i: (x - F.get(low, i)) / F.get(width, i))))
    return array_to_vector(flat.cast("array<double>"))


def balanced(rows: DataFrame, weight: float, *key: str) -> DataFrame:
    """Rows with the rarer class repeated as often as it would weigh; the part of a whole time is drawn by a hash of the key. No row goes."""
    times = F.when(F.col("label") == 1, max(weight, 1.0)).otherwise(max(1 / weight, 1.0))
    drawn = F.pmod(F.xxhash64(F.lit(29), *key), F.lit(1 << 20)) / (1 << 20)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.floor(times) + (drawn < times - F.floor(times)).cast("int")).cast("int")))).drop("_copy")


def log_loss(model, rows: DataFrame, weight: float) -> float:
    """The mean loss of rows with label and features, a positive weighing as in training."""
    p = F.greatest(F.least(vector_to_array("probability")[1], F.lit(1 - 1e-15)), F.lit(1e-15))
    w = F.when(F.col("label") == 1, weight).otherwise(1.0)
    return model.transform(rows).agg(F.sum(-w * F.log(F.when(F.col("label") == 1, p).otherwise(1 - p))) / F.sum(w)).first()[0] or 0.0


@dataclass(frozen=True)
class Fitted:
    """The model of the best step, that step and the last one (from 1), and the validation loss of each."""

    model: object
    best: int
    losses: list[float]


def fit_stopping(step: Callable[[object], object], loss: Callable[[object], float], most: int, patience: int = 3, least_gain: float = 1e-4) -> Fitted:
    """Fits in steps, each from the weights of the one before, until so many steps in a row did not lessen the loss by the least gain; the best step's model is kept."""
    model, best, losses = None, 0, []
    kept = None
    while len(losses) < most and len(losses) - best < patience:
        model = step(model)
        losses.append(loss(model))
        if not best or losses[-1] < losses[best - 1] - least_gain:
            best, kept = len(losses), model
    return Fitted(kept, best, losses)


def fit_network(train: DataFrame, weight: float, n_features: int, iterations: int = 75, hidden: tuple[int, ...] = (16,), each: int = 5, share: float = 0.85, patience: int = 3, n: int | None = None) -> Fitted:
    """A perceptron on rows (date, ticker, label, features), stopped early.

    Fitted on the first share of the days; the later days give the loss that stops it (labelled by the split of plans.labels, so no later day than the train rows' is read). A step is `each` iterations from
    the weights of the last one. n: how many rows there are, where they are few.
    """
    rows = validation_split(train.withColumn("label", F.col("label").cast("double")), share)
    fit = balanced(rows.where("part = 'train'"), weight, "date", "ticker").select("label", "features")
    fit = (in_tasks(fit, n) if n else fit).persist()
    later = rows.where("part = 'validation'").select("label", "features")
    later = (in_tasks(later, n) if n else later).persist()

    def step(before):
        net = MultilayerPerceptronClassifier(layers=[n_features, *hidden, 2], maxIter=each, seed=42, tol=1e-9, blockSize=256)
        return (net if before is None else net.setInitialWeights(before.weights)).fit(fit)

    try:
        if later.isEmpty():
            return Fitted(MultilayerPerceptronClassifier(layers=[n_features, *hidden, 2], maxIter=iterations, seed=42, blockSize=256).fit(fit), 1, [])
        return fit_stopping(step, lambda m: log_loss(m, later, weight), max(1, iterations // each), patience)
    finally:
        fit.unpersist()
        later.unpersist()


def fit_line(train: DataFrame, weight: float, iterations: int = 50):
    """Logistic regression on rows (label, features): the plain model that the network is held against."""
    rows = train.select("features", F.col("label").cast("double").alias("label"), F.when(F.col("label") == 1, weight).otherwise(1.0).alias("weight"))
    return LogisticRegression(weightCol="weight", regParam=0.01, maxIter=iterations).fit(rows)


def fitted_sequences(pooled: DataFrame, folds: DataFrame, columns: list[str], length: int = 60, iterations: int = 75, hidden: tuple[int, ...] = (16,)) -> tuple[DataFrame, list[Fold], list[Fitted]]:
    """The windows, written once and unscaled; the folds; and their networks. A window belongs to its end date; the scale is the train rows' alone."""
    pooled = materialise(pooled.select("date", "ticker", "label", *columns), "pool")
    windows = materialise(sequences(pooled, columns, length).select("date", "ticker", "label", "sequence").repartitionByRange("date"), "windows")
    ranges = {f.fold: f for f in fold_list(pooled, folds, columns)}
    known = [Fold(f.fold, f.cut, f.first, f.last, f.n_pos, f.n_neg, ranges[f.fold].low, ranges[f.fold].high) for f in fold_list(windows, folds)]

    def fit(f: Fold) -> Fitted:
        train = f.train(windows).select("date", "ticker", "label", scaled_sequence(f, columns).alias("features"))
        return fit_network(train, f.weight, length * len(columns), iterations, hidden, n=f.n_pos + f.n_neg)

    return windows, known, side_by_side(windows.sparkSession, known, fit)


def walk_forward_sequences(pooled: DataFrame, folds: DataFrame, columns: list[str], length: int = 60, iterations: int = 75, hidden: tuple[int, ...] = (16,)) -> DataFrame:
    """(date, ticker, label, fold, p) of a second, different model: a perceptron on whole sequences of the last rows, stopped early."""
    windows, known, fitted = fitted_sequences(pooled, folds, columns, length, iterations, hidden)
    return out_of_fold(windows, known, [f.model for f in fitted], lambda x, f: x.withColumn("features", scaled_sequence(f, columns)))


def fit_logistic(rows: DataFrame, columns: list[str]):
    """Logistic regression with the ridge of a unit prior: a penalty of 1 / n per row."""
    n = max(1, rows.count())
    features = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    return LogisticRegression(regParam=1 / n, elasticNetParam=0.0, standardization=False).fit(features.withColumn("label", F.col("label").cast("double")))


def apply_logistic(model, rows: DataFrame, columns: list[str], name: str) -> DataFrame:
    return probability(model, VectorAssembler(inputCols=columns, outputCol="features").transform(rows), name)


def stacked(scores: DataFrame, last_fit_fold: int) -> DataFrame:
    """(date, ticker, label, fold, p1, p2) -> the later folds with calibrated scores c1 and c2, their blend, and the stacker's score. All is fitted on the earlier folds."""
    scores = materialise(scores, "scores")
    fit, rest = scores.where(F.col("fold") <= last_fit_fold), scores.where(F.col("fold") > last_fit_fold)
    for p, c in (("p1", "c1"), ("p2", "c2")):
        model = fit_logistic(fit, [p])
        fit, rest = apply_logistic(model, fit, [p], c), apply_logistic(model, rest, [p], c)
    meta = fit_logistic(fit, ["c1", "c2"])
    return apply_logistic(meta, rest, ["c1", "c2"], "stack").withColumn("blend", blend(F.col("c1"), F.col("c2")))


def ensemble_report(rows: DataFrame) -> DataFrame:
    """One row: AUC of both calibrated scores, blend and stack, the best single one, the stack's lift over it, and a verdict."""
    names = ["c1", "c2", "blend", "stack"]
    long = rows.select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("p")) for n in names])).alias("s")).select("label", "s.*")
    wide = auc(long, by=["name"]).agg(*[F.max(F.when(F.col("name") == n, F.col("auc"))).alias(f"auc_{n}") for n in names])
    best = F.greatest("auc_c1", "auc_c2")
    return wide.withColumn("best_single", best).withColumn("lift", F.col("auc_stack") - best).withColumn("verdict", F.when(F.col("lift") > 0, "stack").otherwise("single"))


__all__ = ["ensemble_report", "fit_line", "fit_network", "fit_trees", "fitted_sequences", "scaled", "stacked", "walk_forward_sequences", "walk_forward_trees"]
