"""Scratch tables: lineage is cut by tables in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written by materialise and not yet removed.
_written: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, or a new local one where a local session has none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed by release."""
    path = f"{scratch(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The scratch tables there are; what a call of release may be told to keep."""
    return list(_written)


def release(spark: SparkSession, keep: list[str] | None = None) -> None:
    """Remove scratch tables but for those to keep: for when all that was derived from them has been written."""
    for path in [p for p in _written if p not in (keep or ())]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _written.remove(path)
