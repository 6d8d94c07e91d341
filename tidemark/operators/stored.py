"""Stored tables that are written in place: by partition, staged before they are swapped, and logged once for each run.

A run has an id. It stages the new content of the partitions that its batch touches, overwrites those partitions, and appends its row to the log. Each step can be repeated: a staged run is not computed
again (the table may be half swapped by then), a swap overwrites whole partitions with the same rows, and a logged run does nothing. So a run that is killed anywhere is
finished by calling it again. Runs on one table go one after another; readers meanwhile see some partitions of the run before.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.scratch import materialise, release, written
from tidemark.operators.writes import append_if_absent, replace_rows


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at a path; empty where nothing has been written yet."""
    return spark.read.schema(schema).parquet(f"{path}/data") if _exists(spark, f"{path}/data") else spark.createDataFrame([], schema)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/log")


def stage(stored: DataFrame, batch: DataFrame, path: str, keys: list[str], order: list[Column], by: str, how: str, run_id: str) -> None:
    """Write what the touched partitions will hold. The list of these partitions comes to the driver; it is as long as the batch has partitions, not rows.

    The batch is computed once: its partitions and its rows are taken from a copy.
    """
    others = written()
    batch = materialise(batch, "batch")
    touched = [r[0] for r in batch.select(by).distinct().collect()]
    merge = {"replace": replace_rows, "append": append_if_absent}[how]
    held = F.col(by).isin([t for t in touched if t is not None]) | (F.lit(None in touched) & F.col(by).isNull())
    content = merge(stored.where(held), batch, keys, order)
    content.write.mode("overwrite").partitionBy(by).parquet(f"{path}/stage/{run_id}")
    release(batch.sparkSession, others)


def swap(spark: SparkSession, path: str, schema: str, by: str, run_id: str) -> None:
    """Overwrite the partitions that are staged, and no other."""
    staged = spark.read.schema(schema).parquet(f"{path}/stage/{run_id}")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{path}/data")


def log_run(path: str, row: DataFrame, run_id: str) -> None:
    """The run's row of the log; written again it replaces itself."""
    row.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/log")


def write_run(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], order: list[Column], by: str, run_id: str, how: str = "replace", log: DataFrame | None = None) -> bool:
    """One run: rows of the batch replace stored ones of equal keys (how: replace) or are added where their keys are new (append). False where the run was logged already.

    by: the partition column, which follows from the keys, so that equal keys lie in one partition. Keys without a value are left out of an append and are one key of a replacement each.
    log: one row, by default the number of rows that the touched partitions hold after the run.
    """
    if not re.fullmatch(r"[\w-]+", run_id):
        raise ValueError("a run id has letters, digits, - and _ only")
    if _exists(spark, f"{path}/log/run_id={run_id}"):
        return False
    kinds = dict(batch.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in batch.columns)
    if not _exists(spark, f"{path}/stage/{run_id}/_SUCCESS"):
        stage(read_table(spark, path, schema), batch, path, keys, order, by, how, run_id)
    swap(spark, path, schema, by, run_id)
    row = log if log is not None else spark.read.schema(schema).parquet(f"{path}/stage/{run_id}").agg(F.count("*").alias("rows_held"))
    log_run(path, row, run_id)
    _remove(spark, f"{path}/stage/{run_id}")
    return True


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int, key: str = "ticker", order: str = "date") -> DataFrame:
    """A table dealt into buckets by key, one sorted file each: windows and joins by the key need no exchange, and a filter on one key reads one bucket."""
    df.repartition(buckets, key).sortWithinPartitions(key, order).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, order).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
