"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.scratch import materialise, release, scratch, written

__all__ = ["collapsed", "copied", "fold_of", "has_repeats", "marks_of", "materialise", "release", "salted_join", "sample_ids", "scratch", "second_hash", "slices", "small_batches", "table", "texts_of", "written"]

#: Bytes of an Arrow batch between the JVM and its workers, where the session sets none.
BATCH = 4 << 20
#: Bytes of text that a worker turns into Python objects at a time; one longer text is alone.
SLICE = 2 << 20
#: Keys with fewer rows than this are never split; at most HOT_KEYS keys are, so that their list has a proven bound.
FEW, HOT_KEYS = 256, 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5. A null id counts as fold 1, so it is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(1))


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session does: several copies of a batch are held, and ten thousand whole texts have no bound."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH))


def slices(batches: Iterator[pa.RecordBatch], column: str | int, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces whose texts (or lists of 8-byte numbers) take at most `most` bytes together. Pieces are views; no byte is copied."""
    for b in batches:
        x = b.column(column)
        size = pc.multiply(pc.list_value_length(x), 8) if pa.types.is_list(x.type) else pc.binary_length(x)
        ends = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, end - at)
            at = end


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], n: str, total: int, *spread: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """large join small, in which the keys are unique and column n says how many rows of large a key has; n is dropped.

    Keys with more than total / HOT_KEYS rows are split: their rows of large are dealt out by a hash of the columns `spread`, and
    their row of small is repeated for each part. There are at most HOT_KEYS such keys if large has `total` rows, so their list is broadcast.
    counted: (keys, n), where small itself is dear to compute twice.
    """
    most = max(FEW, total // HOT_KEYS)
    parts = F.when(F.col(n) > most, F.ceil(F.col(n) / most)).cast("int")
    hot = (counted if counted is not None else small).select(*keys, parts.alias("_parts")).where("_parts is not null")
    small = small.withColumn("_parts", parts).drop(n)
    dealt = large.join(F.broadcast(hot), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies.hint("merge"), [*keys, "_part"], how).drop("_part")


def second_hash(df: DataFrame, *columns: str | Column) -> Column:
    """A hash beside xxhash64 of the same columns, so that both together have 128 bits. Maps, which have no hash, go by their JSON."""
    kinds = dict(df.dtypes)
    return F.xxhash64(F.lit(1), *[F.to_json(F.struct(c)) if isinstance(c, str) and "map<" in kinds[c] else c for c in columns])


def has_repeats(rows: DataFrame, *keys: str) -> bool:
    """Whether any key has several rows. Counts are made before the shuffle, and only keys and counts are shuffled."""
    return not rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty()


def collapsed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key with the other columns of some row, and _copies, how many there are; so that what follows works once for rows that are given many times.

    Where no key is repeated the rows stay as they are, and their columns are not grouped (and so not sorted by key).
    """
    if not has_repeats(rows, *keys):
        return rows.withColumn("_copies", F.lit(1).cast("bigint"))
    return rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rows.columns if c not in keys], F.count("*").alias("_copies"))


def copied(rows: DataFrame, copies: str = "_copies") -> DataFrame:
    """As many rows as were collapsed into each."""
    return rows.withColumn(copies, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))).drop(copies)


def sample_ids(rows: DataFrame, n: int, seed: int = 17) -> DataFrame:
    """At most n distinct non-null `_id`s with what stands beside them, those of the smallest seeded hash: the same under any partitioning."""
    return rows.where(F.col("_id").isNotNull()).orderBy(F.xxhash64(F.lit(seed), F.col("_id")), "_id").limit(n)


def marks_of(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(_id, label, fold) of the ids with a 0/1 label; the larger label wins where an id has several."""
    return labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label")).withColumn("fold", fold_of("_id"))


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled ids with one whole text each. The sample has a fixed bound, so it is broadcast and no text is shuffled but the sample's."""
    own = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    beside = [c for c in ids.columns if c != "_id"]
    return own.join(F.broadcast(ids), "_id").groupBy("_id", *beside).agg(F.min("text").alias("text"))
