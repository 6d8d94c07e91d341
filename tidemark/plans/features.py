"""The thirty features of each instrument and day, without look-ahead.

All windows share partition and order, so one exchange and one sort serve every layer: lags, exponential means and carried context
first, then returns, then rolling statistics of returns. Divisions by zero give NULL; rows with any NULL go in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.blocks import block_series, decayed, ends, handed_on, numbered, with_halo, with_neighbours
from tidemark.functions.windows import carried, change, pct_change, rolling, series, with_ewm
from tidemark.operators.scratch import materialise

#: The feature sets, and the small terms that keep denominators from zero.
LEAN = ["Daily_Return", "SPY_Return", "Beta_20", "NATR_14", "VWAP_Dist", "BB_Width", "Vol_Surge", "EMA_9_Dist"]
RETURNS = ["Daily_Return", "Mom_5", "Mom_10", "Mom_20"]
VOLATILITY = ["Vol_5", "Vol_10", "Vol_20"]
DISTANCES = ["SMA_5_Dist", "SMA_10_Dist", "SMA_20_Dist", "SMA_50_Dist", "SMA_100_Dist"]
EXPONENTIAL = ["EMA_9_Dist", "MACD_Norm"]
SCORES = ["ZScore_20", "ZScore_60"]
BANDS = ["BB_Width", "Boll_Pos"]
VOLUME = ["Vol_Surge", "VWAP_Dist"]
CONTEXT = ["SPY_Return", "Relative_Strength", "Market_Bullish", "Beta_20", "VIX_Level", "VIX_Change", "HYG_Return", "TNX_Change"]
WIDE = [*RETURNS, *VOLATILITY, *DISTANCES, *EXPONENTIAL, *SCORES, "RSI_14", *BANDS, "NATR_14", *VOLUME, *CONTEXT]
EPSILON, BETA_EPSILON = 1e-8, 1e-12
#: Rows that the longest window looks at.
REACH = 200
CONTEXT_COLUMNS = ["spy", "vix", "hyg", "tnx"]


def _rolled(w) -> dict[str, Column]:
    """Each rolling statistic that the features over an instrument's own bars need, once."""
    close, volume = F.col("close"), F.col("volume").cast("double")
    typical = (F.col("high") + F.col("low") + close) / 3
    up, down = (F.when(F.col("_d").isNotNull(), x) for x in (F.greatest("_d", F.lit(0.0)), -F.least("_d", F.lit(0.0))))
    out = {f"_mean_{n}": rolling(F.avg, [close], n, w) for n in (5, 10, 20, 50, 60, 100)}
    out |= {f"_sd_{n}": rolling(F.stddev_samp, [close], n, w) for n in (20, 60)}
    out |= {f"Vol_{n}": rolling(F.stddev_samp, [F.col("Daily_Return")], n, w) for n in (5, 10, 20)}
    out |= {"_gain": rolling(F.avg, [up], 14, w), "_loss": rolling(F.avg, [down], 14, w), "_true_range": rolling(F.avg, [F.col("_range")], 14, w)}
    out |= {"_traded": rolling(F.sum, [typical * volume], 20, w), "_volume": rolling(F.sum, [volume], 20, w)}
    return out | {f"Mom_{n}": pct_change(close, n, w) for n in (5, 10, 20)}


def _own() -> dict[str, Column]:
    """Features out of the rolling statistics."""
    close, mean, sd = F.col("close"), (lambda n: F.col(f"_mean_{n}")), (lambda n: F.col(f"_sd_{n}"))
    out: dict[str, Column] = {f"SMA_{n}_Dist": F.try_divide(close - mean(n), mean(n)) for n in (5, 10, 20, 50, 100)}
    out |= {f"ZScore_{n}": (close - mean(n)) / (sd(n) + EPSILON) for n in (20, 60)}
    out["RSI_14"] = 100 - 100 / (1 + F.col("_gain") / (F.col("_loss") + EPSILON))
    lower, upper = mean(20) - 2 * sd(20), mean(20) + 2 * sd(20)
    out |= {"BB_Width": F.try_divide(upper - lower, mean(20)), "Boll_Pos": (close - lower) / (upper - lower + EPSILON)}
    out["NATR_14"] = F.try_divide("_true_range", close) * 100
    out["Vol_Surge"] = F.try_divide(F.col("volume") * 20.0, F.col("_volume"))
    out["VWAP_Dist"] = F.try_divide(close, F.try_divide("_traded", "_volume")) - 1
    out |= {"EMA_9_Dist": F.try_divide(close, F.col("_e9")) - 1, "MACD_Norm": F.try_divide(F.col("_e12") - F.col("_e26"), close)}
    return out


#: Spans of the exponential means.
SPANS = {"_e9": 9, "_e12": 12, "_e26": 26}


def _own_over(df: DataFrame, w) -> DataFrame:
    """Bars with exponential means -> the features that need no market context."""
    close, previous = F.col("close"), F.lag("close").over(w)
    df = df.withColumns({"Daily_Return": pct_change(close, 1, w), "_d": change(close, w), "_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous))})
    return df.withColumns(_rolled(w)).withColumns(_own())


def own_features(bars: DataFrame, dealt: bool = False) -> DataFrame:
    """Bars with the features that need no market context. dealt: they come by ticker already, from a bucketed table.

    Windows cost far more per byte than a scan, so the one exchange keeps the session's number of shuffle partitions instead of being joined to larger ones by size.
    """
    n = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = _own_over(with_ewm(bars if dealt else bars.repartition(n, "ticker"), "close", SPANS), series())
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def with_context(df: DataFrame, context: DataFrame) -> DataFrame:
    """Adds the day's values of the market. context: one row per date (spy, vix, hyg, tnx), so its size is bounded by the calendar."""
    missing = [c for c in CONTEXT_COLUMNS if c not in context.columns]
    if missing:
        raise ValueError(f"market context lacks {missing}")
    return df.join(F.broadcast(context.select("date", *CONTEXT_COLUMNS)), "date", "left")


def _market_over(df: DataFrame, w, strict_regime: bool) -> DataFrame:
    """Rows with own features and carried values of the market -> the features of the market."""
    df = df.withColumns({"SPY_Return": pct_change(F.col("spy"), 1, w), "VIX_Change": pct_change(F.col("vix"), 1, w), "HYG_Return": pct_change(F.col("hyg"), 1, w), "TNX_Change": change(F.col("tnx"), w), "VIX_Level": F.col("vix")})
    own, market = F.col("Daily_Return"), F.col("SPY_Return")
    bullish = (F.col("spy") > rolling(F.avg, [F.col("spy")], REACH, w)).cast("int")
    beta = rolling(F.covar_samp, [own, market], 20, w) / (rolling(F.var_samp, [market], 20, w) + BETA_EPSILON)
    df = df.withColumns({"Relative_Strength": own - market, "Market_Bullish": bullish if strict_regime else F.coalesce(bullish, F.lit(0)), "Beta_20": beta})
    return df.drop(*CONTEXT_COLUMNS)


def market_context(df: DataFrame, context: DataFrame, strict_regime: bool = False) -> DataFrame:
    """Adds the features of the market. A value is carried forward over the instrument's own days. Until 200 of them are known the market counts as not bullish, or
    with strict_regime as unknown.
    """
    w = series()
    df = with_context(df, context).withColumns({c: carried(F.col(c), w) for c in CONTEXT_COLUMNS})
    return _market_over(df, w, strict_regime)


def feature_table(bars: DataFrame, context: DataFrame, ticker: str | None = None, strict_regime: bool = False, dealt: bool = False) -> DataFrame:
    """(ticker, date, bars, the thirty features), only whole rows. A single ticker's filter reaches the scan. dealt: as in own_features."""
    if ticker is not None:
        bars = bars.where(F.col("ticker") == ticker)
    out = market_context(own_features(bars, dealt), context, strict_regime)
    columns = ["ticker", "date", "open", "high", "low", "close", "volume", *WIDE]
    return out.select(*columns).na.drop("any")


def feature_table_in_blocks(bars: DataFrame, context: DataFrame, days: int = 1461, strict_regime: bool = False) -> DataFrame:
    """The same table with each instrument's series cut into blocks of days, for series too long for a task.

    Carried values and exponential means are first taken inside the blocks and handed on by a table of block ends; then each block gets the rows before it that its windows reach.
    Two exchanges by (ticker, block) instead of one by ticker; the halo costs 200 rows a block.
    """
    w, keep = block_series(), {m: 1 - 2 / (span + 1) for m, span in SPANS.items()}
    rows = numbered(with_context(bars.where("ticker is not null and date is not null"), context), days)
    rows = with_ewm(rows, "close", SPANS, ("ticker", "_block"), starts=False).withColumns({c: carried(F.col(c), w) for c in CONTEXT_COLUMNS})
    rows = materialise(rows, "blocks")
    last = [F.max_by(m, "date").alias(f"_end_{m}") for m in SPANS] + [F.max_by(c, "date").alias(f"_last_{c}") for c in CONTEXT_COLUMNS]
    table = with_neighbours(ends(rows, "ticker", F.min_by("close", "date").alias("_open"), *last), REACH, 0)
    table = handed_on(decayed(table, keep, "_open"), CONTEXT_COLUMNS).select("ticker", "_block", "_n", "_later", "_earlier", *[f"_in_{c}" for c in [*SPANS, *CONTEXT_COLUMNS]])
    rows = rows.join(table.hint("merge"), ["ticker", "_block"])
    rows = rows.withColumns({m: F.col(m) + F.pow(F.lit(q), F.col("_o") + 1) * F.col(f"_in_{m}") for m, q in keep.items()} | {c: F.coalesce(c, f"_in_{c}") for c in CONTEXT_COLUMNS})
    rows = with_halo(rows.drop(*[f"_in_{c}" for c in [*SPANS, *CONTEXT_COLUMNS]]), REACH, 0)
    out = _market_over(_own_over(rows, w), w, strict_regime).where("_own")
    return out.select("ticker", "date", "open", "high", "low", "close", "volume", *WIDE).na.drop("any")
