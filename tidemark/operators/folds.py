"""Statistics of walk-forward folds without a copy of the rows for each fold: rows are aggregated once by the interval between fold bounds, and the intervals are merged."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluate import auc
from tidemark.plans.labels import PURGE_DAYS

_DAY = datetime.timedelta(days=1)


def spans(folds: DataFrame, purge_days: int = PURGE_DAYS) -> list[tuple[int, datetime.date, datetime.date, datetime.date]]:
    """(fold, last train day, first and last test day) of the parameter table, by fold."""
    cut = F.date_sub("train_end", purge_days)
    return [tuple(r) for r in folds.select("fold", cut, F.greatest("test_start", F.date_add(cut, 1)), "test_end").orderBy("fold").collect()]


def over_folds(df: DataFrame, folds: DataFrame, partial: dict[str, Column], merged: dict[str, Column], purge_days: int = PURGE_DAYS) -> DataFrame:
    """(fold, role, merged columns). partial: aggregates of rows, merged: aggregates of these. Rows without a date are in no fold; roles without rows have no row.

    Between two neighbouring bounds all rows have the same roles, so the rows shrink to one for each interval before any fold is looked at; merging
    takes a few hundred rows, whatever the table.
    """
    known = spans(folds, purge_days)
    bounds = sorted({d for _, cut, first, last in known for d in (cut + _DAY, first, last + _DAY)})
    number = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col("date"))) if bounds else F.lit(0)
    parts = df.where(F.col("date").isNotNull()).groupBy(number.alias("_interval")).agg(*[c.alias(k) for k, c in partial.items()])
    own = [(fold, "train", k) for fold, cut, _, _ in known for k in range(bounds.index(cut + _DAY) + 1)]
    own += [(fold, "test", k) for fold, _, first, last in known for k in range(bounds.index(first) + 1, bounds.index(last + _DAY) + 1)]
    roles = df.sparkSession.createDataFrame(own, "fold int, role string, _interval int")
    return parts.join(F.broadcast(roles), "_interval").groupBy("fold", "role").agg(*[c.alias(k) for k, c in merged.items()])  # roles: six rows at most for each two folds


def fold_stats(df: DataFrame, folds: DataFrame, columns: list[str] = (), purge_days: int = PURGE_DAYS) -> DataFrame:
    """(fold, role, n, n_pos, n_neg, and of each column _min and _max): one pass over the rows."""
    partial = {"n": F.count("*"), "n_pos": F.count_if(F.col("label") == 1), "n_neg": F.count_if(F.col("label") == 0)} | {f"{c}_{f.__name__}": f(c) for c in columns for f in (F.min, F.max)}
    merged = {k: F.sum(k) for k in ("n", "n_pos", "n_neg")} | {f"{c}_{f.__name__}": f(f"{c}_{f.__name__}") for c in columns for f in (F.min, F.max)}
    return over_folds(df, folds, partial, merged, purge_days)


def scaler_stats(df: DataFrame, folds: DataFrame, columns: list[str]) -> DataFrame:
    """Per fold the least and largest value of each column among its train rows."""
    return fold_stats(df, folds, columns).where("role = 'train'").drop("role", "n", "n_pos", "n_neg")


def class_balance(df: DataFrame, folds: DataFrame) -> DataFrame:
    """(fold, positive_weight): negatives over positives among the train rows."""
    return fold_stats(df, folds).where("role = 'train'").select("fold", (F.col("n_neg") / F.greatest("n_pos", F.lit(1))).alias("positive_weight"))


def fold_metrics(df: DataFrame, folds: DataFrame, scored: DataFrame, score: str = "p") -> DataFrame:
    """Per fold with train and test rows: their numbers, win rate of the test rows, AUC. scored: test rows with their fold and score."""
    of = lambda role, c: F.max(F.when(F.col("role") == role, c))
    n = fold_stats(df, folds).groupBy("fold").agg(of("train", F.col("n")).alias("train_rows"), of("test", F.col("n")).alias("test_rows"), of("test", F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("win_rate"))
    return n.where("train_rows > 0 and test_rows > 0").join(auc(scored, score, by=["fold"]), "fold", "left")
