"""Scores against outcomes: exact AUC, blending, regimes, selectivity, calibration inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranges import quantile_of, running

#: Winnings and losses per unit of risk, and the shares of the selectivity sweep.
PAYOFF = 3.0
TOP_PERCENTS = [100, 50, 25, 10, 5]


def auc(df: DataFrame, score: str = "p", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve by group; ties count one half; NULL with one class only.

    Rows are first counted by score, and scores dealt into ranges cut at sampled quantiles, so that no task sees all scores of a group, however close they lie.
    """
    by = by or []
    counts = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    won = running(counts, by, "_s", "n0").withColumn("_won", F.col("n1") * (F.col("_before") + F.col("n0") / 2))
    return won.groupBy(*by).agg(F.try_divide(F.sum("_won"), (F.sum("n1") * F.sum("n0")).cast("double")).alias("auc"))


def auc_spread(metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation of the folds' AUCs as rounded to four digits."""
    return metrics.agg(F.avg(F.round("auc", 4)).alias("auc_mean"), F.stddev_samp(F.round("auc", 4)).alias("auc_sd"))


def correlation(df: DataFrame, a: str, b: str, bound: float = 0.9) -> DataFrame:
    return df.agg(F.corr(a, b).alias("corr")).withColumn("verdict", F.when(F.col("corr") < bound, "diverse").otherwise("redundant"))


def blend(a: Column, b: Column, wa: float = 0.5, wb: float = 0.5) -> Column:
    return wa * a + wb * b


def agreement(a: Column, b: Column, threshold: float = 0.75) -> Column:
    return F.coalesce((a >= threshold) & (b >= threshold), F.lit(False)).cast("byte")


def blended(first: DataFrame, second: DataFrame, regimes: DataFrame | None = None) -> DataFrame:
    """Scores of two models on equal (date, ticker), whole rows only, with their blend and the day's regime. regimes: one row per date."""
    out = first.join(second, ["date", "ticker"]).na.drop("any").withColumn("blend", blend(F.col("p1"), F.col("p2")))
    return out if regimes is None else out.join(F.broadcast(regimes), "date", "left")


def value_at(p: Column, payoff: float = PAYOFF) -> Column:
    """Expected value of a trade with win rate p."""
    return p * (payoff + 1) - 1


def sweep(df: DataFrame, percents: list[int] | None = None, payoff: float = PAYOFF) -> DataFrame:
    """For all rows and for each of the regimes: trades with a blend in the top percents, their win rate and expected value. Ties at the cut are in.

    Cuts are exact quantiles, interpolated between two ranks. Rows are counted by blend, and blends dealt into ranges cut at sampled quantiles, so that no task sees all blends of a scope.
    """
    percents = percents or TOP_PERCENTS
    scopes = F.array(F.lit("ALL"), F.when(F.col("regime").isin("bull", "sideways", "bear"), F.col("regime")))
    counts = df.select(F.explode(F.array_compact(scopes)).alias("scope"), "blend", "label").groupBy("scope", "blend").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("won"))
    rows = running(counts, ["scope"], "blend", "n")
    cuts = [F.struct(F.lit(p).alias("top_pct"), quantile_of(1 - p / 100, "blend", "n").alias("cut")) for p in percents]
    found = rows.groupBy("scope").agg(F.array(*cuts).alias("c")).select("scope", F.inline("c"))
    kept = rows.join(F.broadcast(found), "scope").where("blend >= cut")  # four scopes times the percents
    out = kept.groupBy("scope", "top_pct").agg(F.sum("n").alias("trades"), (F.sum("won") / F.sum("n")).alias("win_rate"))
    return out.withColumn("ev", value_at(F.col("win_rate"), payoff))


def regime_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("regime", F.lit("none")).alias("regime")).agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("win_rate"))


def scaler_stats(assigned: DataFrame, columns: list[str]) -> DataFrame:
    """Per fold the least and largest value of each column among its train rows, in one pass."""
    train = assigned.where("role = 'train'")
    return train.groupBy("fold").agg(*[f(c).alias(f"{c}_{f.__name__}") for c in columns for f in (F.min, F.max)])


def scaled(rows: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of each fold's rows in units of its train range; rows outside it leave [0, 1]. A column without range is divided by 1. stats: a row per fold."""
    def unit(c: str) -> Column:
        width = F.col(f"{c}_max") - F.col(f"{c}_min")
        return ((F.col(c) - F.col(f"{c}_min")) / F.when(width == 0, 1.0).otherwise(width)).alias(c)

    other = [c for c in rows.columns if c not in columns]
    return rows.join(F.broadcast(stats), "fold").select(*other, *[unit(c) for c in columns])
