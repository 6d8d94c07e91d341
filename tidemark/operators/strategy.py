"""Selection per day, edge, and the risk of equity paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import top_per_day
from tidemark.operators.ranges import quantiles
from tidemark.operators.scratch import materialise


@dataclass(frozen=True)
class Config:
    """Trades per period, share of capital at risk in each, payoff, cost per unit of risk, capital, periods a year."""

    k: int = 5
    risk: float = 0.01
    reward_risk: float = 3.0
    cost: float = 0.001
    capital: float = 1000.0
    periods: int = 25


def edge(trades: DataFrame, cfg: Config) -> DataFrame:
    p = F.avg(F.col("label").cast("double"))
    return trades.agg(F.count("*").alias("trades"), p.alias("win_rate"), (p * cfg.reward_risk - (1 - p) - cfg.cost).alias("ev"))


def span(trades: DataFrame) -> DataFrame:
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    return trades.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), years.alias("years"), F.try_divide(F.count("*").cast("double"), years).alias("trades_per_year"))


def growth(prices: DataFrame, start: str, end: str) -> DataFrame:
    """Yearly growth between the first and the last close inside the bounds; the years are those of the bounds."""
    a, b = (F.lit(x).cast("date") for x in (start, end))
    rows = prices.where(F.col("date").between(a, b))
    ratio = F.try_divide(F.max_by("close", "date"), F.min_by("close", "date"))
    return rows.agg((F.pow(ratio, 365.25 / F.datediff(b, a)) - 1).alias("cagr"))


def realised(trades: DataFrame, cfg: Config) -> DataFrame:
    """Chosen trades as one path with a period per day."""
    return trades.groupBy("date").agg(F.count_if(F.col("label") == 1).alias("wins"), F.count("*").alias("trades")).withColumn("path", F.lit(0)).withColumnRenamed("date", "period")


def resampled(days: DataFrame, n_paths: int, seed: int) -> DataFrame:
    """Paths of as many periods as there are days, each with the wins and trades of a day drawn with replacement. days: one path with a row per day, so it is bounded by the
    calendar. The draws are hashes of their place, so any partitioning gives the same."""
    numbered = days.select(F.row_number().over(Window.orderBy("period")).alias("day"), "wins", "trades", F.count("*").over(Window.partitionBy()).alias("_n"))
    grid = numbered.select(F.col("day").alias("period"), "_n", F.explode(F.sequence(F.lit(1), F.lit(n_paths))).alias("path"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("path").cast("string"), F.col("period").cast("string"))), 1, 8), 16, 10).cast("bigint") % F.col("_n") + 1
    return grid.withColumn("day", drawn.cast("int")).join(F.broadcast(numbered.drop("_n")), "day").select("path", "period", "wins", "trades")


def equity(paths: DataFrame, cfg: Config) -> DataFrame:
    """(path, period, wins, trades) -> adds ret, equity, peak, drawdown. The peak starts at the capital."""
    w = Window.partitionBy("path").orderBy("period")
    won, lost = F.col("wins"), F.col("trades") - F.col("wins")
    ret = won * cfg.reward_risk * cfg.risk - lost * cfg.risk - F.col("trades") * cfg.cost * cfg.risk
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    alive = F.min(F.when(1 + F.col("ret") > 0, 1).otherwise(0)).over(upto) == 1  # a path that loses everything stays at nothing
    out = paths.withColumn("ret", ret)
    out = out.withColumn("equity", F.when(alive, cfg.capital * F.exp(F.sum(F.when(1 + F.col("ret") > 0, F.log1p("ret"))).over(upto))).otherwise(0.0))
    out = out.withColumn("peak", F.greatest(F.max("equity").over(upto), F.lit(cfg.capital)))
    return out.withColumn("drawdown", 1 - F.col("equity") / F.col("peak"))


def path_ends(curve: DataFrame, cfg: Config) -> DataFrame:
    """Per path: final equity, largest drawdown, whether it fell under half the capital, and its trades, wins, first and last period."""
    fell = F.max((F.col("equity") < cfg.capital / 2).cast("int"))
    return curve.groupBy("path").agg(F.max_by("equity", "period").alias("final"), F.max("drawdown").alias("worst"), fell.alias("ruined"), F.sum("trades").alias("trades"), F.sum("wins").alias("wins"), F.min("period").alias("first"), F.max("period").alias("last"))


def _stats() -> list[Column]:
    """Of a few paths, as a report has."""
    q = F.percentile("final", F.array(*[F.lit(x) for x in (0.05, 0.5, 0.95)]))
    return [F.count("*").alias("paths"), F.get(q, F.lit(1)).alias("median"), F.get(q, F.lit(0)).alias("p5"), F.get(q, F.lit(2)).alias("p95"), F.avg(F.col("ruined").cast("double")).alias("ruin"), F.percentile("worst", F.lit(0.5)).alias("median_drawdown")]


def path_stats(curve: DataFrame, cfg: Config) -> DataFrame:
    """One row: median and 5 / 95 % quantiles of the final equity, share of paths that fell under half the capital, median of the largest drawdowns. The quantiles are exact, over ranges of paths."""
    ends = materialise(path_ends(curve, cfg), "paths")
    finals = quantiles(ends, "final", {"median": 0.5, "p5": 0.05, "p95": 0.95})
    worst = quantiles(ends, "worst", {"median_drawdown": 0.5})
    rest = ends.agg(F.count("*").alias("paths"), F.avg(F.col("ruined").cast("double")).alias("ruin"))
    one = rest.crossJoin(F.broadcast(finals)).crossJoin(F.broadcast(worst))  # one row each
    return one.select("paths", "median", "p5", "p95", "ruin", "median_drawdown")


def report(scored: DataFrame, benchmark: DataFrame, start: str, end: str, cfg: Config, years: int = 5) -> DataFrame:
    """One row: edge and span of the chosen trades, statistics of their realised path, and the benchmark's growth over the years. The trades are read once: all
    but the benchmark comes out of their path."""
    ends = path_ends(equity(realised(top_per_day(scored, "blend", cfg.k), cfg), cfg), cfg)
    p, n = F.sum("wins") / F.sum("trades"), F.sum("trades")
    span_years = F.datediff(F.max("last"), F.min("first")) / 365.25
    found = ends.agg(n.alias("trades"), p.alias("win_rate"), (p * cfg.reward_risk - (1 - p) - cfg.cost).alias("ev"), F.min("first").alias("first_date"), F.max("last").alias("last_date"), span_years.alias("years"), F.try_divide(n.cast("double"), span_years).alias("trades_per_year"), *_stats())
    gain = growth(benchmark, start, end).withColumn("benchmark_gain", F.pow(1 + F.col("cagr"), years))
    return found.crossJoin(F.broadcast(gain))  # one row each
