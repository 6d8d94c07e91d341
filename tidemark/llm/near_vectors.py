"""Near-duplicate embeddings by cross-polytope hashing.

A vector is normalised in double precision, padded to a power of two and rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the signed axis nearest to the result, among all axes or, for the last hash of a table, among the first few. A table joins
some hashes. A vector's home is its bucket; its probes are the home and the buckets with the second nearest axes. Two vectors are compared if the
home of one is among the probes of the other in any table, and linked if their cosine is at least the threshold. A pair that
meets in several buckets is counted in the least of them, so links are counted inside the buckets and no pair leaves its task: out come counts
and spanning edges. Buckets beyond a bound are split into cells of blocks that cover every pair.

Before a bucket sees vectors it sees sketches of 256 signs, and only members with a partner whose sketch is near enough go on, so that a vector is
sent to the buckets where it is likely to have links and not to all of its buckets. The bound on differing signs lies six standard deviations above what a pair at the threshold
has, so fewer than one such pair in a million is lost, against one in 200 by the buckets themselves.

A table has as many buckets as there are classes of equal vectors, or half as many, whatever their number, so the pairs compared grow little faster than
the vectors. The number of tables follows from the recall asked for and the chance that a pair just at the threshold meets in one table, which
is measured on random pairs (`tables_for`).

Equal vectors are one class, so a group of copies is compared once; each copy is linked with the others of its class.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are kept; vectors of different
lengths never link; repeated ids are rows of their own, each with its links; null ids never name a component unless all its ids are
null; an empty table gives no rows. Other columns are never read. Classes are told apart by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, salted_join, slices, small_batches, table
from tidemark.llm.graph import cells, classes_of, component_ids, forest, whole_groups

#: Signs of a sketch, the sides of random planes on which a vector lies; the columns of 64 that hold them.
SIGNS = 256
WORDS = [f"signs{k}" for k in range(SIGNS // 64)]
#: Members of a bucket up to which its pairs are listed together with those of other buckets, and pairs held at a time.
SMALL, PAIRS = 64, 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, also for components near the limits of a double."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def axes_for(n: int, d: int) -> list[int]:
    """How many axes each hash of a table looks at, for a table of about n buckets: all of them, and for the last a power of two."""
    width = 1 << max(1, (d - 1).bit_length())
    bits, full = max(1, (max(n, 2) - 1).bit_length() - 1), width.bit_length()
    return [width] * (bits // full) + ([1 << (bits % full - 1)] if bits % full else [])


def mix(code: np.ndarray, axis: np.ndarray | int) -> np.ndarray:
    x = (code ^ np.uint64(axis) if np.isscalar(axis) else code ^ axis.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def bucket_codes(x: np.ndarray, tables: int, axes: list[int], seed: int = 7) -> np.ndarray:
    """[row, table, probe] bucket codes of unit rows, the home first."""
    n, d = x.shape
    hashes = len(axes)
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    rng = np.random.default_rng([seed, width])
    out = np.zeros((n, tables, hashes + 2), np.int64)
    rows = np.arange(n)
    for t in range(tables):
        best, second, gap = [], [], []
        for k in range(hashes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width)) / np.sqrt(width)
            y = np.column_stack([y[:, : axes[k]], -y[:, : axes[k]]])  # the signed axes
            top = np.argpartition(-y, 1, axis=1)[:, :2]
            swap = y[rows, top[:, 0]] < y[rows, top[:, 1]]
            top[swap] = top[swap][:, ::-1]
            best.append(top[:, 0])
            second.append(top[:, 1])
            gap.append(y[rows, top[:, 0]] - y[rows, top[:, 1]])
        nearest = np.argsort(np.array(gap), axis=0, kind="stable")  # hashes whose second axis is closest come first
        swaps = [np.zeros((hashes, n), bool)]
        for k in range(hashes):
            s = np.zeros((hashes, n), bool)
            s[nearest[k], rows] = True
            swaps.append(s)
        both = np.zeros((hashes, n), bool)
        both[nearest[0], rows] = both[nearest[min(1, hashes - 1)], rows] = True
        swaps.append(both)
        for p, s in enumerate(swaps):
            code = mix(mix(np.zeros(n, np.uint64), d), t + 1)
            for k in range(hashes):
                code = mix(code, np.where(s[k], second[k], best[k]) + 1)
            out[:, t, p] = code.view(np.int64)
    return out


def tables_for(axes: list[int], d: int, cosine: float, recall: float, pairs: int = 2000) -> int:
    """Tables that find a pair at the threshold with the chance `recall`, by the share of random such pairs that meet in a table."""
    rng, pairs = np.random.default_rng(11), max(64, min(pairs, (1 << 22) // d))  # bounded memory for long vectors
    a, e = unit(rng.normal(size=(pairs, d))), rng.normal(size=(pairs, d))
    e = unit(e - (e * a).sum(1, keepdims=True) * a) if d > 1 else a
    b = unit(cosine * a + np.sqrt(max(0.0, 1 - cosine * cosine)) * e)
    x, y = bucket_codes(a, 4, axes), bucket_codes(b, 4, axes)
    met = ((y == x[:, :, :1]).any(2) | (x == y[:, :, :1]).any(2)).mean()
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(1 - min(max(met, 1e-3), 1 - 1e-9)))))


def integers(x: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column whose lists all have one length, as a matrix."""
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy().reshape(-1, width)


def numbers(x: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column whose lists all have one length, as a matrix of doubles."""
    return integers(x, width).astype(np.float64, copy=False)


def sketches(x: np.ndarray, seed: int = 13) -> np.ndarray:
    """[row, word] numbers of 64 signs each."""
    planes = np.random.default_rng([seed, x.shape[1]]).normal(size=(x.shape[1], SIGNS))
    return np.packbits(x @ planes > 0, axis=1).view(np.int64)


def most_differing(cosine: float) -> int:
    """Signs in which a pair at this cosine may differ: each does with the chance angle / pi."""
    p = np.arccos(np.clip(cosine, -1.0, 1.0)) / np.pi
    return int(np.ceil(SIGNS * p + 6 * np.sqrt(SIGNS * p * (1 - p))))


def _codes(tables: int, axes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in slices(batches, "vector"):
            lengths = pc.list_value_length(whole.column("vector"))
            for d in pc.unique(lengths).to_pylist():
                b = whole.filter(pc.equal(lengths, d))
                u = unit(numbers(b.column("vector"), d))
                codes = bucket_codes(u, tables, axes).reshape(len(u), -1)
                lists = pa.ListArray.from_arrays(np.arange(len(u) + 1, dtype=np.int32) * codes.shape[1], codes.ravel())
                signs = [pa.array(np.ascontiguousarray(s)) for s in sketches(u).T]
                yield pa.RecordBatch.from_arrays([b.column("v"), b.column("n"), b.column("vector"), lists, *signs], ["v", "n", "vector", "codes", *WORDS])

    return run


def meeting_bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least bucket in which pairs of vectors with codes [pair, table, probe] meet, home in probes."""
    never = np.iinfo(np.int64).max
    ab = np.where((b == a[:, :, :1]).any(2), a[:, :, 0], never)
    ba = np.where((a == b[:, :, :1]).any(2), b[:, :, 0], never)
    return np.minimum(ab, ba).min(1)


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the numbers below n that each reaches over the edges."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if (now == label).all():
            break
        label = now
    return label


def pairs_in(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows inside groups of rows [begin, end), some rows at a time."""
    row = np.concatenate([np.zeros(0, np.int64), *(np.arange(s, e) for s, e in zip(begin, end, strict=True))])
    after = np.repeat(end, end - begin) - row - 1
    total = np.cumsum(after)
    at = 0
    while at < len(row):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        n = after[at:stop]
        p = np.repeat(row[at:stop], n)
        q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        yield p, q
        at = stop


def near_pairs(x: np.ndarray, begin: np.ndarray, end: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those pairs with at least this cosine."""
    for p, q in pairs_in(begin, end):
        near = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
        yield p[near], q[near]


def _likely(most: int):
    """Members of the cells, with sketches -> those with a partner in their cell whose sketch differs in at most so many signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, begin in whole_groups(batches, ["bucket", "i", "j"]):
            i, j, own, home = (t.column(c).to_numpy() for c in ("i", "j", "own", "home"))
            words = [t.column(c).to_numpy().view(np.uint64) for c in WORDS]  # bits of a negative number would be counted without its sign
            likely = np.zeros(t.num_rows, bool)
            for p, q in pairs_in(begin, np.append(begin[1:], t.num_rows)):
                near = sum(np.bitwise_count(x[p] ^ x[q]).astype(np.int16) for x in words) <= most
                p, q = p[near], q[near]
                fits = (home[p] | home[q]) & ((i[p] == j[p]) | (own[p] != own[q]))
                likely[p[fits]] = likely[q[fits]] = True
            yield from t.select(["bucket", "i", "j", "own", "v"]).filter(pa.array(likely)).combine_chunks().to_batches()

    return run


def _count(cosine: float, tables: int):
    def links_of(t: pa.Table, d: int) -> pa.RecordBatch:
        bucket, i, j, own, v, n = (t.column(c).to_numpy() for c in ("bucket", "i", "j", "own", "v", "n"))
        x, codes = unit(numbers(t.column("vector"), d)), integers(t.column("codes"), len(t.column("codes")[0])).reshape(len(v), tables, -1)
        begin = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        end = np.append(begin[1:], len(v))
        home = (codes[:, :, 0] == bucket[:, None]).any(1)
        links, some = np.zeros(len(v), np.int64), end - begin <= SMALL
        ends_a, ends_b = [], []

        def counted(p: np.ndarray, q: np.ndarray) -> None:
            for at in range(0, len(p), PAIRS):
                a, b = p[at : at + PAIRS], q[at : at + PAIRS]
                first = meeting_bucket(codes[a], codes[b]) == bucket[a]
                np.add.at(links, a[first], n[b[first]])
                np.add.at(links, b[first], n[a[first]])

        for p, q in near_pairs(x, begin[some], end[some], cosine):
            fits = (home[p] | home[q]) & ((i[p] == j[p]) | (own[p] != own[q]))
            counted(p[fits], q[fits])
            ends_a.append(p[fits])
            ends_b.append(q[fits])
        label = least_reached(len(v), *(np.concatenate([np.zeros(0, np.int64), *e]) for e in (ends_a, ends_b)))
        a = np.flatnonzero(label != np.arange(len(v)))
        edges_a, edges_b = [a], [label[a]]
        for s, e in zip(begin[~some], end[~some], strict=True):
            near = np.triu(x[s:e] @ x[s:e].T >= cosine, 1) & (home[s:e, None] | home[None, s:e])
            if i[s] != j[s]:
                near &= own[s:e, None] != own[None, s:e]
            p, q = np.nonzero(near)
            counted(p + s, q + s)
            tree = np.array(forest(near | near.T), np.int64).reshape(-1, 2) + s
            edges_a.append(tree[:, 0])
            edges_b.append(tree[:, 1])
        linked, a, b = np.flatnonzero(links), np.concatenate(edges_a), np.concatenate(edges_b)
        of_edges = pa.array(np.concatenate([v[linked], v[b]]), mask=np.arange(len(linked) + len(b)) < len(linked))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([v[linked], v[a]])), of_edges, pa.array(np.concatenate([links[linked], np.zeros(len(a), np.int64)]))], ["a", "b", "n_links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in whole_groups(batches, ["bucket", "i", "j"]):
            lengths = pc.list_value_length(t.column("vector"))
            for d in pc.unique(lengths).to_pylist():
                yield links_of(t.filter(pc.equal(lengths, d)), d)

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.995, most_bucket: int = 3000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: id, n_links, component_id (the smallest id reachable over links, itself included), kept (id = component_id). A pair at the threshold is found with
    the chance `recall` (in the commonest length of vectors; shorter ones more surely, longer ones a little less), closer ones more surely."""
    small_batches(vectors.sparkSession)
    x = F.col(vector_col).cast("array<double>")
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    fine = F.coalesce(x.isNotNull() & F.forall(x, finite) & F.exists(x, lambda e: e != 0), F.lit(False))
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"  # floats stay floats on their way
    rows = vectors.select(F.col(id_col).alias("id"), F.when(fine, F.col(vector_col).cast(kind)).alias("vector"))
    rows = rows.withColumns({f"class{k}": F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(k), F.col("vector"))) for k in (0, 1)}).withColumn("row", F.xxhash64("id"))
    key = ["class0", "class1"]
    classes = classes_of(rows, key, ["id"], vector=F.first("vector"))
    n, d = classes.agg(F.count("*"), F.coalesce(F.mode(F.size("vector"), True), F.lit(1))).first()
    axes = axes_for(n, d)
    tables = tables_for(axes, d, cosine, recall)
    coded = materialise(classes.select("v", F.col("_n").alias("n"), "vector").mapInArrow(_codes(tables, axes), f"v bigint, n bigint, vector {kind}, codes array<bigint>, {', '.join(f'{c} bigint' for c in WORDS)}"), "vectors")

    posts = coded.select("v", F.explode(F.array_distinct("codes")).alias("bucket"), F.expr(f"transform(sequence(0, {tables - 1}), t -> codes[t * {len(axes) + 2}])").alias("homes"))
    posts = posts.select("v", "bucket", F.array_contains("homes", F.col("bucket")).alias("home"))
    meeting = posts.groupBy("bucket").agg(F.count("*").alias("_m"), F.max("home").alias("_home")).where("_m > 1 and _home")
    together = materialise(salted_join(posts, meeting.drop("_home"), ["bucket"], "_m", n * tables * (len(axes) + 2), "v"), "buckets")
    dealt = lambda rows: rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "v")
    placed = cells(together, ["bucket"], most_bucket).join(coded.select("v", *WORDS).hint("merge"), "v").select("bucket", "i", "j", "own", "v", "home", *WORDS)
    likely = dealt(placed).mapInArrow(_likely(most_differing(cosine)), "bucket bigint, i int, j int, own int, v bigint")
    full = dealt(likely.join(coded.select("v", "n", "vector", "codes").hint("merge"), "v").select("bucket", "i", "j", "own", "v", "n", "vector", "codes"))
    found = materialise(full.mapInArrow(_count(cosine, tables), "a bigint, b bigint, n_links bigint"), "links")

    links = found.where("b is null").groupBy(F.col("a").alias("v")).agg(F.sum("n_links").alias("_links"))
    counts = classes.drop("vector").join(links.hint("merge"), "v", "left").withColumn("_links", F.coalesce("_links", F.lit(0)) + F.col("_n") - 1)
    out = component_ids(rows.drop("vector"), key, counts, found.where("b is not null").select("a", "b"), "row", ["_links"])
    out = out.withColumn("component_id", F.when(F.col("class0").isNull(), F.col("id")).otherwise(F.col("_first.id")))
    return out.select(F.col("id").alias(id_col), F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
