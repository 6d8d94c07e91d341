"""Forward labels, purged folds, regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.blocks import block_series, in_blocks
from tidemark.functions.windows import carried, rolling, series

#: Take profit, stop loss, days held; calendar days purged before a fold's end; the regime's window and volatility bound.
TAKE, STOP, HOLD = 0.03, -0.01, 10
PURGE_DAYS = 14
REGIME_WINDOW, CALM = 200, 20.0


def barrier(take: float, stop: float, hold: int, w: WindowSpec) -> Column:
    """Over the next `hold` rows the first touch decides, 1 for take, 0 for stop, and 0 without any. NULL where fewer rows follow."""
    ahead = F.collect_list("close").over(w.rowsBetween(1, hold))
    first = F.get(F.filter(F.transform(ahead, lambda x: F.try_divide(x, F.col("close")) - 1), lambda r: (r <= stop) | (r >= take)), F.lit(0))
    return F.when(F.size(ahead) == hold, F.when(first <= stop, 0).when(first >= take, 1).otherwise(0))


def triple_barrier(df: DataFrame, take: float = TAKE, stop: float = STOP, hold: int = HOLD) -> DataFrame:
    """Adds label, by the next rows of the ticker."""
    return df.withColumn("label", barrier(take, stop, hold, series()))


def triple_barrier_in_blocks(df: DataFrame, days: int = 1461, take: float = TAKE, stop: float = STOP, hold: int = HOLD) -> DataFrame:
    """The same with each ticker's series cut into blocks of days that also hold the next rows."""
    return in_blocks(df, days, ahead=hold).withColumn("label", barrier(take, stop, hold, block_series())).where("_own").drop("_block", "_own")


def labelled(df: DataFrame, **barriers) -> DataFrame:
    """Only rows with a label, as a byte."""
    return triple_barrier(df, **barriers).where("label is not null").withColumn("label", F.col("label").cast("byte"))


def folds_table(spark: SparkSession, folds: list[tuple[str, str, str]]) -> DataFrame:
    """(fold, train_end, test_start, test_end) of an expanding walk forward."""
    return spark.createDataFrame([(i + 1, *f) for i, f in enumerate(folds)], "fold int, a string, b string, c string").select("fold", F.to_date("a").alias("train_end"), F.to_date("b").alias("test_start"), F.to_date("c").alias("test_end"))


def yearly_folds(first: int = 2013, last: int = 2024) -> list[tuple[str, str, str]]:
    """Train to the end of a year, test from April on for twelve months; one fold a year."""
    return [(f"{y}-12-31", f"{y + 1}-04-01", f"{y + 2}-03-31") for y in range(first, last + 1)]


def assigned(df: DataFrame, folds: DataFrame, purge_days: int = PURGE_DAYS) -> DataFrame:
    """Rows with each fold and role that they have: train up to the purged end, test between the bounds. The folds are a parameter table of a few rows."""
    f = folds.withColumn("cut", F.date_sub("train_end", purge_days))
    train, test = F.col("date") <= F.col("cut"), F.col("date").between(F.col("test_start"), F.col("test_end"))
    return df.join(F.broadcast(f), train | test).withColumn("role", F.when(train, "train").otherwise("test")).drop("cut", "train_end", "test_start", "test_end")


def tested(df: DataFrame, folds: DataFrame, purge_days: int = PURGE_DAYS) -> DataFrame:
    """Rows with the fold that tests them. Test spans hardly overlap, so rows are not multiplied as training rows would be."""
    f = folds.select("fold", F.greatest("test_start", F.date_add(F.date_sub("train_end", purge_days), 1)).alias("_first"), F.col("test_end").alias("_last"))
    return df.join(F.broadcast(f), F.col("date").between(F.col("_first"), F.col("_last"))).drop("_first", "_last")


def validation_split(df: DataFrame, share: float = 0.85) -> DataFrame:
    """Adds part: train up to the date that the share of rows does not exceed, else validation. By date, for all tickers alike."""
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    cut = df.agg(F.percentile(day, F.lit(share)).alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("part", F.when(day <= F.col("_cut"), "train").otherwise("validation")).drop("_cut")


def regimes(context: DataFrame) -> DataFrame:
    """(date, regime) on the index's own calendar: warmup until its mean is known, bear below it, else bull in calm and sideways otherwise."""
    w = Window.orderBy("date")  # one row per date: bounded by the calendar
    own = context.where("spy is not null").select("date", "spy", "vix").withColumn("vix", carried(F.col("vix"), w)).withColumn("mean", rolling(F.avg, [F.col("spy")], REGIME_WINDOW, w))
    rule = F.when(F.col("mean").isNull(), "warmup").when(F.col("spy") < F.col("mean"), "bear").when(F.col("vix") <= CALM, "bull").otherwise("sideways")
    return own.select("date", rule.alias("regime"))
