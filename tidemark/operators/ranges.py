"""Running totals and exact quantiles over values dealt into ranges cut at sampled quantiles: no task sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scratch import materialise


def running(counts: DataFrame, by: list[str], value: str, amount: str) -> DataFrame:
    """counts: rows of distinct (by, value). Adds _before, the amounts of smaller values of the group, and _all, those of the whole group.

    Rows are dealt out by sampled ranges of (by, value), as many as the session has shuffle partitions, and the written table keeps each row's range. A group's ranges start from the totals of
    its ranges before; both the join with the totals and the window lie in one exchange by group and range. A null group is a group; a null value is the smallest.
    """
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialise(counts.repartitionByRange(n, *by, value).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = rows.groupBy(*by, "_range").agg(F.sum(amount).alias("_t"))  # at most the ranges and the groups together
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    base = F.coalesce(F.sum("_t").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*[F.col(c).alias(f"_{c}_of") for c in by], F.col("_range").alias("_range_of"), base.alias("_base"), F.sum("_t").over(group).alias("_all"))
    same = F.col("_range") == F.col("_range_of")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}_of"))
    inside = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(totals.hint("merge"), same).withColumn("_before", F.col("_base") + F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return out.select(*counts.columns, "_before", "_all")


def at_rank(rank: Column, value: str, amount: str) -> Column:
    """Aggregate: the value at a rank from 0, out of rows with running totals."""
    return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col(amount)), F.col(value)))


def quantile_of(p: float, value: str, amount: str) -> Column:
    """Aggregate: the exact quantile, interpolated between two ranks, out of rows with running totals."""
    at = (F.col("_all") - 1) * p
    low, high, part = at_rank(F.floor(at), value, amount), at_rank(F.ceil(at), value, amount), F.max(at - F.floor(at))
    return low + (high - low) * part


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Per group an exact quantile of the non-null values for each name. Values are counted before they are dealt out."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    return running(counts, by, value, "_n").groupBy(*by).agg(*[quantile_of(p, value, "_n").alias(k) for k, p in shares.items()])
