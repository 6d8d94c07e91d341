"""Incremental loading as a stream: files that land are appended once, whatever is delivered twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.writes import new_rows


def month_of(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


def append_stream(spark: SparkSession, landing: str, target: str, checkpoint: str, schema: str, keys: list[str], date: str = "date") -> None:
    """Take in all files that have landed since the last call. Late rows are new keys and are appended; keys that are stored stay as they are.

    The target is partitioned by `month` of the date, which is one of the keys: a batch is compared with the months that it touches, not with the whole target.
    """

    def load(batch: DataFrame, _: int) -> None:
        batch = batch.withColumn("month", month_of(date)).persist()  # read for its months and for its rows
        try:
            months = [r[0] for r in batch.select("month").where("month is not null").distinct().collect()]
            if months:
                stored = spark.read.schema(f"{schema}, month string").parquet(target).where(F.col("month").isin(months))
                order = [F.col(c) for c in batch.columns if c not in keys]
                new_rows(stored, batch, keys, order).write.mode("append").partitionBy("month").parquet(target)
        finally:
            batch.unpersist()

    source = spark.readStream.schema(schema).parquet(landing)
    source.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
