"""Window expressions over panels: one series per key, ordered by date."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(key: str = "ticker", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def rolling(agg: Callable[..., Column], columns: list[Column], n: int, w: WindowSpec) -> Column:
    """agg over the last n rows; NULL until all n have every column."""
    frame = w.rowsBetween(-(n - 1), 0)
    present = columns[0] if len(columns) == 1 else F.when(columns[1].isNotNull(), columns[0])
    return F.when(F.count(present).over(frame) == n, agg(*columns).over(frame))


def change(x: Column, w: WindowSpec) -> Column:
    return x - F.lag(x).over(w)


def pct_change(x: Column, n: int, w: WindowSpec) -> Column:
    return F.try_divide(x, F.lag(x, n).over(w)) - 1


def carried(x: Column, w: WindowSpec) -> Column:
    """The last value so far; never one from later rows."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def with_ewm(df: DataFrame, column: str, spans: dict[str, int], keys: tuple[str, ...] = ("ticker",), order: str = "date", starts: Column | bool = True) -> DataFrame:
    """Adds exponentially weighted means (weight 2 / (span + 1), started at the first value). starts: whether a series really starts with its first row; if not, that row weighs as any other.

    A running sum of x / q^i overflows on long series, so the sum restarts in each block of rows; a block takes over the
    end of the one before. What still older blocks weigh is below the precision of a double.
    """
    slowest = max(spans.values())
    block = 2 ** math.ceil(math.log2(40 * (slowest + 1) / 2))  # q^block < 1e-17, and q^-block stays finite for any span over 2
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_part", F.floor(F.col("_at") / block)).withColumn("_off", F.col("_at") % block)
    inside = Window.partitionBy(*keys, "_part").orderBy(order)
    before = Window.partitionBy(*keys).orderBy("_part").rangeBetween(-1, -1)
    for name, span in spans.items():
        alpha = 2 / (span + 1)
        q = F.lit(1 - alpha)
        weight = F.when((F.col("_at") == 0) & (F.lit(starts) if isinstance(starts, bool) else starts), 1.0).otherwise(alpha)
        df = df.withColumn("_loc", F.pow(q, F.col("_off")) * F.sum(weight * F.col(column) * F.pow(q, -F.col("_off"))).over(inside))
        df = df.withColumn("_end", F.last("_loc").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        df = df.withColumn(name, F.col("_loc") + F.coalesce(F.pow(q, F.col("_off") + 1) * F.max("_end").over(before), F.lit(0.0)))
    return df.drop("_at", "_part", "_off", "_loc", "_end")


def sequence_of(features: list[str], length: int, w: WindowSpec) -> Column:
    return F.collect_list(F.array(*[F.col(c).cast("float") for c in features])).over(w.rowsBetween(-(length - 1), 0))


def sequences(df: DataFrame, features: list[str], length: int, key: str = "ticker", order: str = "date") -> DataFrame:
    """Adds `sequence`, the last `length` rows of the features as an array of arrays, for series with more than `length` rows;
    a row's window ends at the row, and rows without a full window go."""
    out = df.withColumn("_n", F.count("*").over(Window.partitionBy(key))).withColumn("sequence", sequence_of(features, length, series(key, order)))
    return out.where((F.col("_n") > length) & (F.size("sequence") == length)).drop("_n")


def top_per_day(df: DataFrame, score: str, k: int, order: str = "date", tie: str = "ticker") -> DataFrame:
    """The k rows of the highest score of each day; ties go by the key."""
    rank = F.row_number().over(Window.partitionBy(order).orderBy(F.desc(score), tie))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)
