"""Long series in blocks of days, so that one key's series is many tasks.

A block holds its own rows and a halo: the last rows before it and the first rows after it, as many as the longest window reaches. Windows over (key, block) then give each
own row what windows over the key would. What reaches back without bound (carried values, exponential means) is handed from block to block by a table of block ends,
which has a row for each block and not for each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.windows import sequence_of


def block_of(order: Column, days: int) -> Column:
    return F.floor(F.datediff(order, F.lit("1970-01-01").cast("date")) / days).cast("int")


def block_series(key: str = "ticker", order: str = "date") -> WindowSpec:
    return Window.partitionBy(key, "_block").orderBy(order)


def numbered(df: DataFrame, days: int, key: str = "ticker", order: str = "date") -> DataFrame:
    """Adds _block and _o, the row's place in it from 0. One exchange by (key, block), with the session's number of partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("_block", block_of(F.col(order), days)).repartition(n, key, "_block").withColumn("_o", F.row_number().over(block_series(key, order)) - 1)


def ends(df: DataFrame, key: str = "ticker", *more: Column) -> DataFrame:
    """(key, _block, _n, more aggregates): a row for each block of numbered rows."""
    return df.groupBy(key, "_block").agg(F.count("*").alias("_n"), *more)


def with_neighbours(blocks: DataFrame, back: int, ahead: int, key: str = "ticker") -> DataFrame:
    """Adds to block ends _later and _earlier: the blocks within reach, with the number of rows in between."""
    w = Window.partitionBy(key).orderBy("_block")
    blocks = blocks.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    from_, to = F.struct("_block", (F.col("_upto") - F.col("_n")).alias("at")), F.struct("_block", F.col("_upto").alias("at"))
    later = F.collect_list(from_).over(w.rowsBetween(1, max(back, 1)))  # a block has a row at least, so no more are in reach
    earlier = F.collect_list(to).over(w.rowsBetween(-max(ahead, 1), -1))
    gap = lambda x, rows: F.struct(x["_block"].alias("block"), rows.alias("gap"))
    later = F.filter(F.transform(later, lambda x: gap(x, x["at"] - F.col("_upto"))), lambda x: x["gap"] < back)
    earlier = F.filter(F.transform(earlier, lambda x: gap(x, F.col("_upto") - F.col("_n") - x["at"])), lambda x: x["gap"] < ahead)
    return blocks.withColumns({"_later": later, "_earlier": earlier}).drop("_upto")


def with_halo(df: DataFrame, back: int, ahead: int, key: str = "ticker") -> DataFrame:
    """Rows with _block, _o, _n, _later and _earlier (joined from with_neighbours) -> each row once for its own block (_own) and once for each block whose halo it is in, dealt out by (key, block)."""
    own = F.array(F.struct(F.col("_block").alias("block"), F.lit(True).alias("own")))
    seen = lambda x: F.struct(x["block"].alias("block"), F.lit(False).alias("own"))
    after = F.transform(F.filter("_later", lambda x: x["gap"] + F.col("_n") - F.col("_o") <= back), seen)
    before = F.transform(F.filter("_earlier", lambda x: x["gap"] + F.col("_o") + 1 <= ahead), seen)
    out = df.withColumn("_at", F.explode(F.concat(own, after, before))).drop("_block", "_o", "_n", "_later", "_earlier")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return out.withColumns({"_block": F.col("_at.block"), "_own": F.col("_at.own")}).drop("_at").repartition(n, key, "_block")


def in_blocks(df: DataFrame, days: int, back: int = 0, ahead: int = 0, key: str = "ticker", order: str = "date") -> DataFrame:
    """Rows of df dealt out by blocks with their halo: adds _block and _own. Take windows over block_series, then keep `_own` rows. Rows without a key or day are left out."""
    rows = numbered(df.where(F.col(key).isNotNull() & F.col(order).isNotNull()), days, key, order)
    around = with_neighbours(ends(rows, key), back, ahead, key)
    return with_halo(rows.join(around.hint("merge"), [key, "_block"]), back, ahead, key)


def handed_on(blocks: DataFrame, carried: list[str], key: str = "ticker") -> DataFrame:
    """Adds to block ends _in_{c}: the last non-null value of c in the blocks before."""
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumns({f"_in_{c}": F.last(f"_last_{c}", ignorenulls=True).over(before) for c in carried})


def decayed(blocks: DataFrame, means: dict[str, float], first: str, key: str = "ticker") -> DataFrame:
    """Adds to block ends _in_{name}: the exponential mean at the end of the block before, out of the blocks' own sums (_end_{name}) and rows.

    means: name -> what a mean keeps from row to row. first: the column of a block's first value; a series starts as if that of its first block had always been the mean.
    """
    w = Window.partitionBy(key).orderBy("_block")
    chain = F.collect_list(F.struct("_n", *[f"_end_{m}" for m in means])).over(w.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumns({"_chain": chain, "_start": F.coalesce(F.first(first).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))})

    def folded(mean: str, keeps: float) -> Column:
        return F.aggregate("_chain", F.col("_start"), lambda total, b: total * F.pow(F.lit(keeps), b["_n"]) + F.coalesce(b[f"_end_{mean}"], F.lit(0.0)))

    return blocks.withColumns({f"_in_{m}": folded(m, q) for m, q in means.items()}).drop("_chain", "_start")


def sequences_in_blocks(df: DataFrame, features: list[str], length: int, days: int, key: str = "ticker", order: str = "date") -> DataFrame:
    """Like windows.sequences, with each series cut into blocks: what the last rows are comes with the halo, and whether the series is long enough from the block ends."""
    rows = numbered(df.where(F.col(key).isNotNull() & F.col(order).isNotNull()), days, key, order)
    around = with_neighbours(ends(rows, key), length - 1, 0, key).withColumn("_long", F.sum("_n").over(Window.partitionBy(key)) > length)
    rows = with_halo(rows.join(around.hint("merge"), [key, "_block"]), length - 1, 0, key).withColumn("sequence", sequence_of(features, length, block_series(key, order)))
    return rows.where(F.col("_own") & F.col("_long") & (F.size("sequence") == length)).drop("_own", "_long", "_block")
