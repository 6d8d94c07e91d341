"""Windows of event time as a stream: late rows and repeated deliveries by rule, counts in a state store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, keys: list[str], by: list[str], width: str, delay: str, aggs: dict[str, Column]) -> DataFrame:
    """(start, by, aggs) of each window, streaming or not.

    In a stream an event of known keys counts once while the watermark (the latest time of the batches before, less the delay) has not passed it by the delay; a row behind
    the watermark is late and goes; a window comes out once the watermark reaches its end. State is kept for keys and windows ahead of the watermark only, so it is bounded by the delay and not
    by the stream. On a table each event counts once and all windows come out.
    """
    once = events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
    found = once.groupBy(F.window(time, width).alias("_w"), *by).agg(*[c.alias(k) for k, c in aggs.items()])
    return found.select(F.col("_w.start").alias("start"), *by, *aggs)


def count_windows(spark: SparkSession, landing: str, target: str, checkpoint: str, schema: str, time: str, keys: list[str], by: list[str], aggs: dict[str, Column], width: str = "1 day", delay: str = "1 day") -> None:
    """Take in all files that have landed since the last call and append the windows that are final. State and offsets stand in the checkpoint, and the sink commits a batch once, so a call that was killed is repeated."""
    events = spark.readStream.schema(schema).parquet(landing)
    found = windowed(events, time, keys, by, width, delay, aggs)
    found.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
