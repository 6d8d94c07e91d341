"""Write operators: idempotent appends and upserts as whole new snapshots. Spark has no unique constraints; these functions keep keys unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first by a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def new_rows(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of the batch to append: whole keys that are not stored yet; of equal keys in the batch the first counts. Stored rows never change."""
    for k in keys:
        batch = batch.where(F.col(k).isNotNull())
    return first_of(batch, keys, order).join(stored.select(*keys), keys, "left_anti")


def append_if_absent(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return stored.unionByName(new_rows(stored, batch, keys, order).select(*stored.columns))


def replace_rows(stored: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Full-row upsert: a key's row in the batch (the first by the order) replaces the stored one."""
    newest = first_of(batch, keys, order)
    return stored.join(newest.select(*keys).hint("merge"), keys, "left_anti").select(*stored.columns).unionByName(newest.select(*stored.columns))


def upsert_universe(stored: DataFrame, listed: DataFrame, today: Column, position: str = "position") -> DataFrame:
    """Name, sector and source come from the listing (of a repeated ticker its last row), the other columns stay as stored; nothing is deleted."""
    newest = first_of(listed, ["ticker"], [F.desc(position)]).select("ticker", *[F.col(c).alias(f"_{c}") for c in ("company_name", "sector", "source")])
    out = stored.withColumn("_stored", F.lit(True)).join(newest.withColumn("_listed", F.lit(True)), "ticker", "full_outer")
    fresh = {c: F.when(F.col("_listed"), F.col(f"_{c}")).otherwise(F.col(c)) for c in ("company_name", "sector", "source")}
    kept = {"ml_ready": F.coalesce("ml_ready", F.lit(False)), "first_seen": F.when(F.col("_stored"), F.col("first_seen")).otherwise(today)}
    return out.select("ticker", *[(fresh | kept).get(c, F.col(c)).alias(c) for c in stored.columns if c != "ticker"])


def source_counts(stocks: DataFrame) -> DataFrame:
    """How many are listed and how many are on the watch list (any other source, none included)."""
    listed = F.coalesce(F.col("source") == "sp500", F.lit(False))
    return stocks.agg(F.count_if(listed).alias("sp500"), F.count_if(~listed).alias("watchlist"), F.count("*").alias("total"))


def touch(stocks: DataFrame, processed: DataFrame, today: Column) -> DataFrame:
    """last_updated becomes today for the processed tickers."""
    done = processed.select("ticker").distinct().withColumn("_done", F.lit(True))
    return stocks.join(done, "ticker", "left").withColumn("last_updated", F.when(F.col("_done"), today).otherwise(F.col("last_updated"))).drop("_done").select(*stocks.columns)


def history_flag(stocks: DataFrame, prices: DataFrame, least: int = 504) -> DataFrame:
    """ml_ready: at least so many stored prices; tickers without any are not."""
    n = prices.groupBy("ticker").agg(F.count("*").alias("_n"))
    return stocks.join(n, "ticker", "left").withColumn("ml_ready", F.coalesce("_n", F.lit(0)) >= least).drop("_n").select(*stocks.columns)


def incremental(universe: DataFrame, stored: DataFrame, landed: DataFrame, key: str, order: list[Column], broken: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One load for all keys: landed rows from each key's last stored day on, without the keys that have broken rows.

    Returns the rows to append, the quarantined rows, and per key (rows_added, failed).
    """
    from tidemark.sources.market import high_water

    bad = landed.where(broken)
    failed = bad.select(key).distinct()
    due = landed.join(high_water(universe, stored, key), key).where(F.col("date") >= F.col("last_date")).drop("last_date").join(failed, key, "left_anti")
    added = new_rows(stored, due, [key, "date"], order)
    report = universe.select(key).join(added.groupBy(key).agg(F.count("*").alias("rows_added")), key, "left").join(failed.withColumn("failed", F.lit(True)), key, "left")
    return added, bad, report.select(key, F.coalesce("rows_added", F.lit(0)).alias("rows_added"), F.coalesce("failed", F.lit(False)).alias("failed"))


def run_log_row(report: DataFrame, mode: str, started: str, seconds: float) -> DataFrame:
    """One row for the log of runs, out of the report of an incremental load."""
    errors = F.count_if("failed")
    return report.agg(
        F.lit(started).cast("timestamp").alias("run_at"), F.lit(mode).alias("mode"), (F.count("*") - errors).cast("int").alias("stocks_updated"), F.coalesce(F.sum("rows_added"), F.lit(0)).alias("rows_added"),
        errors.cast("int").alias("errors"), F.round(F.lit(float(seconds)), 1).alias("duration_sec"), F.when(errors == 0, "ok").otherwise("partial").alias("status"),
    )


def summary(stocks: DataFrame, prices: DataFrame, baselines: DataFrame) -> DataFrame:
    """One row: tickers, price rows, first and last day, ready tickers, baseline rows. Each table is read once; the sides that are broadcast have one row."""
    p = prices.agg(F.count_distinct("ticker").alias("tickers"), F.count("*").alias("price_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return p.crossJoin(F.broadcast(stocks.agg(F.count_if("ml_ready").alias("ready")))).crossJoin(F.broadcast(baselines.agg(F.count("*").alias("baseline_rows"))))


def write_scores(df: DataFrame, path: str, csv: bool = False) -> None:
    """Out-of-fold scores as Parquet, or as CSV with a header."""
    (df.write.mode("overwrite").option("header", True).csv if csv else df.write.mode("overwrite").parquet)(path)


def read_scores(spark: SparkSession, path: str, schema: str, csv: bool = False) -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if csv else reader.parquet(path)
