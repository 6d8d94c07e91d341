"""Connected components, and exact splitting of large groups into pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, release, salted_join, written

#: Rows, and bytes divided by 1024, from which on batches are looked through for whole groups.
TOGETHER = 8000


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, root) of every vertex of the edges (a, b) of longs, root being the smallest vertex that it reaches.

    Alternating large and small stars: each round joins every vertex with its neighbourhood's smallest vertex, found by an
    aggregate, and hubs are split, so that no neighbourhood has to fit into one task. Each round's edges are written to the shared folder, and
    those of the round before removed.
    """

    def linked(e: DataFrame, n: int, bound: bool) -> DataFrame:
        """bound: small star (neighbours below, and the vertex itself); else large star (neighbours above)."""
        both = e if bound else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).withColumn("m", F.least("a", "m"))
        out = salted_join(both, least, ["a"], "_n", 2 * n, "b")
        if bound:
            return out.select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return out.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    spark, others = edges.sparkSession, written()
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        others_too = written()
        now = materialise(linked(linked(now, before[0], False), before[0], True), "edges")
        release(spark, [p for p in written() if p in others or p not in others_too])
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components have not settled")
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def classes_of(rows: DataFrame, key: list[str], order: list[str], **kept: Column) -> DataFrame:
    """One row for each class of equal rows (those with equal non-null key): the key, its number v, _n rows, the `_first` of them by the order, and the kept columns.

    Numbers are given out as the table is written, so they are unique whatever the number of classes.
    """
    some = rows.where(F.col(key[0]).isNotNull()).groupBy(*key).agg(F.count("*").alias("_n"), F.min(F.struct(F.col(order[0]).isNull().alias("_none"), *order)).alias("_first"), *[c.alias(k) for k, c in kept.items()])
    return materialise(some.withColumn("v", F.monotonically_increasing_id()), "classes")


def component_ids(rows: DataFrame, key: list[str], classes: DataFrame, edges: DataFrame, spread: str, more: list[str] | None = None) -> DataFrame:
    """Adds to rows the columns `more` of their class and the struct `_first` of the first row of their component, over the edges (a, b) between the numbers of the classes. Rows without a class get a null."""
    roots = connected_components(edges)
    rooted = materialise(classes.select(*key, "v", "_n", "_first", *(more or [])).join(roots.hint("merge"), "v", "left").withColumn("root", F.coalesce("root", "v")), "roots")
    first = rooted.groupBy("root").agg(F.min("_first").alias("_least"), F.count("*").alias("_m"))
    of_class = salted_join(rooted.drop("_first"), first, ["root"], "_m", rooted.count(), "v").select(*key, "_n", *(more or []), F.col("_least").alias("_first"))
    of_class = materialise(of_class, "components")
    some = rows.where(F.col(key[0]).isNotNull())
    total = of_class.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    out = salted_join(some, of_class, key, "_n", total, spread)
    return out.unionByName(rows.where(F.col(key[0]).isNull()), allowMissingColumns=True)


def cells(members: DataFrame, keys: list[str], most: int, vertex: str = "v", weight: Column | None = None, least: int = 1) -> DataFrame:
    """Groups of fewer than `least` rows are left out. Groups of more than `most` rows (or weight) become blocks of half as many, and every two blocks a cell: adds i, j (the cell) and own (the
    row's block). Each two rows of a group meet in a cell; both of one block only in the cell i = j counts. members must be a written table."""
    size = members.groupBy(*keys).agg(F.sum(weight if weight is not None else F.lit(1)).alias("_size"), F.count("*").alias("_rows")).where(F.col("_rows") >= least)
    out = salted_join(members, size, keys, "_rows", members.count(), vertex)
    n = F.when(F.col("_size") > most, F.ceil(F.col("_size") * 2 / most)).otherwise(1).cast("int")
    out = out.withColumn("_blocks", n).withColumn("own", F.pmod(F.xxhash64(vertex), F.col("_blocks")).cast("int"))
    return out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("i", F.least("own", "_other")).withColumn("j", F.greatest("own", "_other")).drop("_size", "_blocks", "_other")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups out of batches sorted by integer keys, with the borders of the groups in each. Small batches are taken together."""
    left: pa.Table | None = None
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for b in chain(batches, [None]):
        if b is not None and b.num_rows:
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
        if not held or (b is not None and rows < TOGETHER and size < TOGETHER << 10):
            continue
        t = pa.Table.from_batches(held)
        held, rows, size = [], 0, 0
        t = t if left is None else pa.concat_tables([left, t])
        k = np.column_stack([t.column(c).to_numpy() for c in keys])
        borders = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if len(borders):
            yield t.slice(0, borders[-1]), np.concatenate([[0], borders])
            t = t.slice(borders[-1])
        left = t
    if left is not None and left.num_rows:
        yield left, np.array([0, left.num_rows])


def forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each vertex to its component's first vertex, of a boolean adjacency matrix."""
    n, out = len(adjacent), []
    free = np.ones(n, bool)
    for s in range(n):
        if not free[s]:
            continue
        free[s] = False
        front = np.flatnonzero(adjacent[s] & free)
        while len(front):
            free[front] = False
            out += [(int(x), s) for x in front]
            front = np.flatnonzero(adjacent[front].any(0) & free)
    return out

