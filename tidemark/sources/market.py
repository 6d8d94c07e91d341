"""Readers and normalisers of universe, price and baseline data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import schemas

#: The symbols of the market context, and the start of history where nothing is stored.
BASELINE_SYMBOLS = {"SPY": "spy", "^VIX": "vix", "HYG": "hyg", "^TNX": "tnx"}
HISTORY_START = "2010-01-01"


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; all columns are text and missing ones empty."""
    return spark.read.schema(schemas.UNIVERSE).option("header", True).csv(path).na.fill("")


def normalise_universe(raw: DataFrame, ticker: str, name: str, sector: str, source: str = "sp500") -> DataFrame:
    """Three columns of a raw listing; dots in tickers become dashes."""
    return raw.select(F.trim(F.replace(F.col(ticker), F.lit("."), F.lit("-"))).alias("ticker"), F.trim(name).alias("company_name"), F.trim(sector).alias("sector"), F.lit(source).alias("source"))


def finite(x: Column) -> Column:
    """NaN becomes NULL."""
    return F.when(~F.isnan(x), x)


def normalise_prices(raw: DataFrame, key: str | None = None) -> DataFrame:
    """A vendor's frame with columns in any case, or named like "('Close', 'XYZ')", as date, open, high, low, close, volume.

    The first of equal names counts, and the last of those that differ in case only. The date is the first `date` or `datetime`, taken by its wall
    clock; without one the result is empty. Missing columns are NULL, rows without a close go, a missing volume is 0.
    """
    plain = [next((p.strip(" '\"") for p in c.strip("()").split(",") if p.strip(" '\"")), c) for c in raw.columns]
    places = {name: i for i, name in reversed([*enumerate(plain)])}  # by position, as Spark does not tell such names apart
    found = {name.lower(): i for name, i in sorted(places.items(), key=lambda x: x[1])}
    stamp = min((i for name, i in places.items() if name.lower() in ("date", "datetime")), default=None)
    rows = raw.toDF(*[f"_{i}" for i in range(len(plain))])
    pick = lambda n, t: F.col(f"_{found[n]}").cast(t) if n in found else F.lit(None).cast(t)
    keys = [F.col(f"_{raw.columns.index(key)}").alias(key)] if key else []
    day = F.substring(F.col(f"_{stamp}").cast("string"), 1, 10).try_cast("date") if stamp is not None else F.lit(None).cast("date")
    out = rows.select(*keys, day.alias("date"), *[finite(pick(n, "double")).alias(n) for n in ("open", "high", "low", "close")], F.coalesce(finite(pick("volume", "double")), F.lit(0.0)).cast("bigint").alias("volume"))
    return out.where(F.col("close").isNotNull() & F.col("date").isNotNull())


def stock(prices: DataFrame, ticker: str) -> DataFrame:
    return prices.where(F.col("ticker") == ticker).select("date", "open", "high", "low", "close", "volume").orderBy("date")


def baseline(baselines: DataFrame, symbol: str) -> DataFrame:
    return baselines.where(F.col("symbol") == symbol).select("date", "close").orderBy("date")


def baselines_wide(baselines: DataFrame) -> DataFrame:
    """One row per date with a column for each symbol of the market context."""
    return baselines.where(F.col("symbol").isin(*BASELINE_SYMBOLS)).groupBy("date").agg(*[F.max(F.when(F.col("symbol") == s, F.col("close"))).alias(c) for s, c in BASELINE_SYMBOLS.items()])


def ready_universe(stocks: DataFrame) -> DataFrame:
    return stocks.where("ml_ready").select("ticker")


def high_water(universe: DataFrame, stored: DataFrame, key: str = "ticker", start: str = HISTORY_START) -> DataFrame:
    """Each key's last stored date, or the start of history."""
    last = stored.groupBy(key).agg(F.max("date").alias("last_date"))
    return universe.select(key).join(last, key, "left").select(key, F.coalesce("last_date", F.lit(start).cast("date")).alias("last_date"))


def restricted(df: DataFrame, tickers: DataFrame | list[str]) -> DataFrame:
    """Rows of some tickers: a list, or a one-column table that stays on the cluster."""
    return df.where(F.col("ticker").isin(*tickers)) if isinstance(tickers, list) else df.join(tickers.select("ticker"), "ticker", "left_semi")


def between(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def orphans(prices: DataFrame, stocks: DataFrame) -> DataFrame:
    """Prices of tickers that the universe lacks."""
    return prices.join(stocks.select("ticker"), "ticker", "left_anti")
