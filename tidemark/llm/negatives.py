"""Hard negatives by an inverted multi-index.

Two codebooks, one for each half of the dimensions, cut the rows into cells. Rows sorted by cell are packed into shards of a bounded size. For an anchor and a shard, a heap walks the cells in the
order of the sum of two half bounds (inner product with the code, plus the anchor's norm times the code's radius in the shard), and the walk stops once every window of scores is certified: the next
bound is below what the window still takes. All results are exact; codebooks decide the work only.

Anchors are a stated query set: they meet the shards in blocks. What a block sends out is bounded by floors: an anchor searches its own shard first, and elsewhere only scores that reach
the last place found there count. A pass finds each anchor's positives, the next one, whose windows follow from their scores, the negatives.

Defined cases: rows with a null id or label, or a null vector, or any null or non-finite component take no part; of rows with one id the one of the smallest
(label, vector) stays; shorter vectors count as padded with zeros; scores are 64-bit integers (components beyond them saturate, sums wrap); ties go by id; a positive without a negative in its
window has no row; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, slices, small_batches, table

#: Rows and bytes of a shard, anchors of a block; rows and bytes of the sample that the codebooks are fitted on; codes of a half at most; rows scored at a time.
SHARD, SHARD_BYTES, BLOCK, SAMPLE, SAMPLE_BYTES, CODES, STEP = 4096, 4 << 20, 1024, 8192, 32 << 20, 128, 256
#: The least share of a positive's score, in hundredths, and how many places a window has.
SHARE, PLACES = 80, 5


def whole_rows(rows: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(id, label, v) of the rows that take part; v holds floor(256 x) of each component."""
    own = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    own = own.where("id is not null and label is not null and v is not null").where(F.forall("v", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))))
    return own.withColumn("v", F.transform("v", lambda e: F.floor(e * 256)))


def _padded(x: pa.Array, dim: int) -> np.ndarray:
    """Integer lists as rows of a matrix of dim columns."""
    n = np.diff(x.offsets.to_numpy())
    flat = x.values.slice(x.offsets[0].as_py(), int(n.sum())).to_numpy(zero_copy_only=False)
    if len(n) and (n == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(n), dim), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n] or [np.zeros(0, int)])] = flat
    return out


def codebook(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres of k-means on sampled rows; those without rows move to random rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=len(centres))])
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for s in range(0, len(x), 4096):
        out[s : s + 4096] = np.argmin((centres**2).sum(1) - 2 * x[s : s + 4096] @ centres.T, axis=1)
    return out


def _coded(books: tuple[np.ndarray, np.ndarray], dim: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "v"):
            x = _padded(b.column("v"), dim).astype(np.float64)
            codes = [pa.array(nearest(x[:, h], c).astype(np.int32)) for h, c in zip((slice(0, dim // 2), slice(dim // 2, dim)), books, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *codes], [*b.schema.names, "c0", "c1"])

    return run


def _shards(dim: int) -> Callable:
    """Packs rows sorted by cell into shards: `part` is that of the partition, `place` is the shard's own number. Components take as few bytes as hold them all."""
    most = max(1, min(SHARD, SHARD_BYTES // (8 * max(dim, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def packed(t: pa.Table) -> pa.RecordBatch:
            nonlocal number
            x = _padded(t.column("v").combine_chunks(), dim)
            kind = next(k for k in (np.int16, np.int32, np.int64) if k is np.int64 or not x.size or (x.min() >= np.iinfo(k).min and x.max() <= np.iinfo(k).max))
            data = [np.asarray(t.column(c).to_numpy(), np.int64).tobytes() for c in ("id", "label", "c0", "c1", "asks")] + [x.astype(kind).tobytes()]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([part << 32 | number], pa.int64()), *[pa.array([d], pa.binary()) for d in data]], ["part", "place", *_PACKED])

        for b in slices(batches, "v"):
            held.append(b)
            n += b.num_rows
            while n >= most:
                t = pa.Table.from_batches(held)
                yield packed(t.slice(0, most))
                held, n = t.slice(most).to_batches(), n - most
        if n:
            yield packed(pa.Table.from_batches(held))

    return run


_PACKED = ["ids", "labels", "c0", "c1", "asks", "x"]


def _unpacked(one: dict[str, bytes], dim: int) -> tuple[np.ndarray, ...]:
    ids, labels, c0, c1, asks = (np.frombuffer(one[c], np.int64) for c in _PACKED[:5])
    size = len(one["x"]) // max(1, len(ids) * dim)
    return ids, labels, c0, c1, asks, np.frombuffer(one["x"], {2: np.int16, 4: np.int32}.get(size, np.int64)).reshape(len(ids), dim).astype(np.int64)


def _anchors(dim: int) -> Callable:
    """(place, id, label, v) of the rows of the shards that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, labels, _, _, asks, x = _unpacked({c: b.column(c)[k].as_py() for c in _PACKED}, dim)
                at = np.flatnonzero(asks)
                if len(at):
                    place = b.column("place")[k].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([place] * len(at), pa.int64()), pa.array(ids[at]), pa.array(labels[at]), pa.array(list(x[at]), pa.list_(pa.int64()))], ["place", "id", "label", "v"])

    return run


class Shard:
    """Rows of some cells, their codes, and each code's radius among them."""

    def __init__(self, one: dict[str, bytes], books: tuple[np.ndarray, np.ndarray], dim: int):
        self.ids, self.labels, *codes, _, self.x = _unpacked(one, dim)
        self.real, self.halves = self.x.astype(np.float64), (slice(0, dim // 2), slice(dim // 2, dim))
        self.largest = float(np.abs(self.real).max(initial=0))
        self.centres, self.radii, own = [], [], []
        for half, code, book in zip(self.halves, codes, books, strict=True):
            used, at = np.unique(code, return_inverse=True)
            far = np.zeros(len(used))
            np.maximum.at(far, at, np.sqrt(((self.real[:, half] - book[code]) ** 2).sum(1)))
            self.centres.append(book[used])
            self.radii.append(far)
            own.append(at)
        cell = own[0] * len(self.radii[1]) + own[1]  # rows are sorted by cell
        begins = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])).tolist()
        self.cells = {int(cell[s]): (s, e) for s, e in zip(begins, [*begins[1:], len(cell)], strict=True)}

    def bounds(self, anchors: np.ndarray) -> list[np.ndarray]:
        """For each half the bound of each code (columns) for each anchor, with room for rounding."""
        out = []
        for half, centres, radii in zip(self.halves, self.centres, self.radii, strict=True):
            a = anchors[:, half].astype(np.float64)
            lengths, code_lengths = np.sqrt((a**2).sum(1)), np.sqrt((centres**2).sum(1))
            out.append(a @ centres.T + lengths[:, None] * radii + lengths[:, None] * (code_lengths + radii) * 1e-9 + 1e-6)
        return out

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact: doubles where all sums stay below 2^53, else integers."""
        if self.largest * float(np.abs(anchor.astype(np.float64)).max(initial=0)) * max(len(anchor), 1) < 2**53:
            return (self.real[rows] @ anchor.astype(np.float64)).astype(np.int64)
        return self.x[rows] @ anchor


class Windows:
    """What an anchor looks for: scores from low to high, at least the floor; the best `places` of each window so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, floor: np.ndarray, places: int):
        self.high, self.places = high, places
        self.least = np.maximum(low, floor)  # scores below no longer matter
        self.best: list[list[tuple[int, int]]] = [[] for _ in high]  # (-score, id), sorted
        self.open = low <= high

    def stop(self) -> float:
        """The walk is over once no cell's bound reaches this."""
        return float(self.least[self.open].min()) if self.open.any() else float("inf")

    def take(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for w in np.flatnonzero(self.open):
            fit = np.flatnonzero((scores >= self.least[w]) & (scores <= self.high[w]))
            if len(fit):
                if len(fit) > self.places:
                    fit = fit[np.lexsort((ids[fit], -scores[fit]))[: self.places]]
                self.best[w] = sorted(self.best[w] + [(-s, i) for s, i in zip(scores[fit].tolist(), ids[fit].tolist(), strict=True)])[: self.places]
                if len(self.best[w]) == self.places:
                    self.least[w] = max(self.least[w], -self.best[w][-1][0])


def walk(shard: Shard, bounds: tuple[np.ndarray, np.ndarray], anchor: int, label: int, vector: np.ndarray, windows: Windows, same: bool) -> int:
    """Visits cells by the summed bounds of their halves until all windows are certified; returns how many cells were visited.

    A cell enters the heap once both neighbours before it have left it, so cells leave in the order of their sums and the heap has one cell a row at most.
    """
    orders = [np.argsort(-b, kind="stable") for b in bounds]
    first, second = bounds[0][orders[0]].tolist(), bounds[1][orders[1]].tolist()
    wide, visited, stop = len(second), 0, windows.stop()
    heap, left = [(-(first[0] + second[0]), 0, 0)], set()
    while heap and -heap[0][0] >= stop:
        rows, n = [], 0
        while heap and n < STEP and -heap[0][0] >= stop:
            _, i, j = heapq.heappop(heap)
            left.add((i, j))
            if i + 1 < len(first) and (j == 0 or (i + 1, j - 1) in left):
                heapq.heappush(heap, (-(first[i + 1] + second[j]), i + 1, j))
            if j + 1 < wide and (i == 0 or (i - 1, j + 1) in left):
                heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
            cell = shard.cells.get(int(orders[0][i]) * wide + int(orders[1][j]))
            if cell is not None:
                rows.append(np.arange(*cell))
                n += cell[1] - cell[0]
                visited += 1
        at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        at = at[((shard.labels[at] == label) == same) & (shard.ids[at] != anchor)]
        if len(at):
            windows.take(shard.scores(at, vector), shard.ids[at])
            stop = windows.stop()
    return visited


def _search(books: tuple[np.ndarray, np.ndarray], dim: int, same: bool, places: int) -> Callable:
    """(anchor, window, id, score): the best of each window of each anchor among the rows of a shard. An input row is a shard and a block of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, shard = None, None
        for b in batches:
            for k in range(b.num_rows):
                if place != b.column("place")[k].as_py():
                    place, shard = b.column("place")[k].as_py(), Shard({c: b.column(c)[k].as_py() for c in _PACKED}, books, dim)
                block = b.column("anchors")[k].values
                ids, labels, vectors, wanted = block.field("id").to_pylist(), block.field("label").to_pylist(), _padded(block.field("v"), dim), block.field("windows")
                bounds = shard.bounds(vectors)
                found: list[tuple[int, int, int, int]] = []
                for i, (anchor, label) in enumerate(zip(ids, labels, strict=True)):
                    w = wanted[i].as_py()
                    windows = Windows(*[np.array([x[c] for x in w], np.int64) for c in ("low", "high", "floor")], places)
                    walk(shard, (bounds[0][i], bounds[1][i]), anchor, label, vectors[i], windows, same)
                    found += [(anchor, w[j]["window"], row, -score) for j, best in enumerate(windows.best) for score, row in best]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["anchor", "window", "id", "score"])

    return run


class Index:
    """Shards of the rows (id, label, v, asks), packed in a written table. The codebooks have at most 2 x CODES rows, so tasks carry them along.

    Fitted on a bounded sample of rows (those of the smallest hashes); every row is indexed.
    """

    def __init__(self, rows: DataFrame):
        small_batches(rows.sparkSession)
        rows = materialise(rows.groupBy("id").agg(F.min(F.struct("label", "v", "asks")).alias("r")).select("id", "r.*"), "vectors")
        n, self.dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
        most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(self.dim, 1))))
        sample = rows.orderBy(F.xxhash64(F.lit(11), "id"), "id").select("v").limit(most).toArrow().column("v").combine_chunks()
        x = _padded(sample, self.dim).astype(np.float64) if n else np.zeros((1, self.dim))
        k = int(np.clip(np.sqrt(n / 32), 1, CODES))
        self.books = tuple(codebook(h, k) for h in (x[:, : self.dim // 2], x[:, self.dim // 2 :]))
        coded = rows.mapInArrow(_coded(self.books, self.dim), "id bigint, label bigint, v array<bigint>, asks boolean, c0 int, c1 int")
        dealt = coded.repartitionByRange(max(1, -(-n // SHARD)), "c0", "c1", F.xxhash64("id")).sortWithinPartitions("c0", "c1", "id")  # a hot cell is cut by id
        self.shards = materialise(dealt.mapInArrow(_shards(self.dim), "part bigint, place bigint, " + ", ".join(f"{c} binary" for c in _PACKED)), "shards")
        self.parts = self.shards.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]

    def anchors(self) -> DataFrame:
        """(place, id, label, v) of the rows that ask, with their own shard."""
        return materialise(self.shards.mapInArrow(_anchors(self.dim), "place bigint, id bigint, label bigint, v array<bigint>"), "anchors")

    def _visit(self, blocks: DataFrame, on: str, same: bool, places: int) -> DataFrame:
        pairs = blocks.join(self.shards.hint("merge"), on).select("place", *_PACKED, "anchors")
        return pairs.mapInArrow(_search(self.books, self.dim, same, places), "anchor bigint, window bigint, id bigint, score bigint")

    def search(self, anchors: DataFrame, same: bool, places: int = PLACES) -> DataFrame:
        """anchors: (place, id, label, v, windows), windows being structs (window, low, high). Per anchor and window the `places` best rows of the same label (or of the others) with a score in it."""
        one = F.struct("id", "label", "v", "windows")
        open_ = F.transform("windows", lambda w: F.struct(w["window"].alias("window"), w["low"].alias("low"), w["high"].alias("high"), w["low"].alias("floor")))
        at_home = anchors.withColumn("windows", open_).groupBy("place").agg(F.collect_list(one).alias("anchors"))  # at most a shard's rows
        seen = self._visit(at_home, "place", same, places)
        full = seen.groupBy("anchor", "window").agg(F.min("score").alias("floor"), F.count("*").alias("_n")).where(F.col("_n") == places)
        floors = full.groupBy(F.col("anchor").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("window", "floor"))).alias("floors"))
        floored = F.transform("windows", lambda w: F.struct(w["window"].alias("window"), w["low"].alias("low"), w["high"].alias("high"), F.coalesce(F.try_element_at("floors", w["window"]), w["low"]).alias("floor")))
        asked = materialise(anchors.join(floors.hint("merge"), "id", "left").withColumn("windows", floored).select("id", "label", "v", "windows"), "asked")
        n = max(1, -(-asked.count() // BLOCK))
        blocks = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("_block")).agg(F.collect_list(one).alias("anchors"))
        everywhere = blocks.select("anchors", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.parts).cast("bigint"))).alias("part"))
        found = self._visit(everywhere, "part", same, places)
        rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= places)


def mine(rows: DataFrame, asks: Column, share: int = SHARE, places: int = PLACES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, label, v); asks: the condition of an anchor.

    Positives are the `places` best other rows of the anchor's label. The negatives of a positive are the best `places` rows of other labels that score at least share % of it and not more.
    """
    index = Index(rows.withColumn("asks", F.coalesce(asks, F.lit(False))))
    anchors = index.anchors()
    far = 1 << 62
    all_ = F.array(F.struct(F.lit(0).cast("bigint").alias("window"), F.lit(-far).alias("low"), F.lit(far).alias("high")))
    positives = materialise(index.search(anchors.withColumn("windows", all_), True, places).select("anchor", F.col("rank").cast("bigint").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    low = F.ceil(F.col("positive_score").cast("decimal(20,0)") * share / 100).cast("bigint")
    windows = positives.groupBy(F.col("anchor").alias("id")).agg(F.collect_list(F.struct("window", low.alias("low"), F.col("positive_score").alias("high"))).alias("windows"))
    negatives = index.search(anchors.join(windows.hint("merge"), "id"), False, places)
    out = negatives.join(positives.hint("merge"), ["anchor", "window"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; where it is divisible by 7, the label moves on by one."""
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(whole_rows(rows), F.col("id") % 100 == 0)


NEGATIVES_SQL = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, b.id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor AS anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
