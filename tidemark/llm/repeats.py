"""Removal of repeated strings of `least` bytes or more, by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if a string of `least` bytes that covers it also starts earlier: in a row of a smaller id, or earlier in the same row.

1. Each window of `least` bytes has an anchor, the position of the least hash of its GRAM-byte strings. Equal windows have equal anchors, so
   windows are dealt out by their anchor's hash: a segment is a run of windows with one anchor. Equal segments are settled by
   their hashes, within a task before the shuffle and then among tasks: all but the first go. Anchors with a single
   segment have no other match. The segments of frequent anchors are dealt out one by one for that.
2. The different segments of one anchor meet in a block: their concatenation's Burrows-Wheeler transform is searched breadth first by backward
   extension. Level by level the intervals of all strings of length 1, 2, ... give the borders with a common prefix of that length less one;
   the search stops at `least`. Suffixes without a border between them share `least` bytes or more; all but the first go.
3. Anchors with more than most_segments different segments (short frequent lines in many contexts) are dealt out again before that: their windows are
   split into parts by the anchor's place in the window, and the bytes that a part's windows share are its key. Parts that still are too many
   under one key are dealt out by single windows.

Texts are shuffled once, by row; the other shuffles carry hashes and the segments of steps 2 and 3. Segments are told apart by two hashes of 64 bits, of the
anchor's bytes and of their own; within one anchor the latter alone tells them apart.

Defined cases: null text counts as empty; a null id counts as the largest; rows with equal ids come in the order of a hash; repeated rows
(equal id and text) are one document and all get its result; a text of any length is hashed in overlapping pieces of a megabyte; an empty
table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import P, powers
from tidemark.llm.common import FEW, HOT_KEYS, collapsed, copied, materialise, release, salted_join, second_hash, slices, small_batches, table, written
from tidemark.llm.graph import whole_groups

GRAM = 32
#: Bits of a key that hold a position; the hash has the rest.
PLACE = 28
#: Bytes hashed at a time, windows of a task that are compared before the shuffle, bytes of segments in a block.
STEP, FLUSH, BLOCK = 1 << 20, 8 << 20, 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Polynomial hashes of any parts of some bytes; equal parts have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def segments(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Runs of window starts with one anchor in concatenated texts that end at `ends`: text number, first start, count,
    the anchor's hash, the segment's hash."""
    starts = np.concatenate([[0], ends[:-1]])
    n = len(data) - least + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    hashes = Hashes(data)
    width = least - GRAM + 1
    grams = mixed((hashes.sums[GRAM:] - hashes.sums[:-GRAM]) * hashes.down[: len(data) - GRAM + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    low = (grams >> np.uint64(PLACE) << np.uint64(PLACE)) | (np.uint64((1 << PLACE) - 1) - place)  # ties: the last
    w = 1
    while 2 * w <= width:
        low = np.minimum(low[:-w], low[w:])
        w *= 2
    if w < width:
        low = np.minimum(low[: len(low) - (width - w)], low[width - w :])
    anchor = ((1 << PLACE) - 1 - (low[:n] & np.uint64((1 << PLACE) - 1)).astype(np.int64)).astype(np.int64)
    inside = np.zeros(n + 1, np.int8)
    fits = ends - starts >= least
    np.add.at(inside, starts[fits], 1)
    np.add.at(inside, ends[fits] - least + 1, -1)
    ok = np.cumsum(inside[:-1]) > 0
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
    first_of_text = starts[fits]
    new[first_of_text] = True
    first = np.flatnonzero(new)
    stop = ok & np.concatenate([~ok[1:] | new[1:], [True]])
    count = np.flatnonzero(stop) - first + 1
    a = grams[anchor[first]]
    h = mixed(hashes.of(first, first + count - 1 + least) + count.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return np.searchsorted(ends, first, side="right"), first, count, a, h


def ranges_of(row: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of starts, joined where they touch; they come sorted by row and start."""
    if not len(row):
        return row, start, count
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > start[:-1] + count[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(row) - 1]])
    return row[first], start[first], start[last] + count[last] - start[first]


def _first_pass(least: int):
    """Rows (k, doc, text) -> segments that no equal one in this task precedes (gone false), and ranges of starts that go (gone true)."""
    names = ("a", "h", "doc", "k", "start", "n", "gone")

    def flush(docs: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        docs = sorted(docs, key=lambda x: x[:2])
        pieces = [(i, at, data[at : at + STEP + least - 1]) for i, (*_, data) in enumerate(docs) for at in range(0, len(data) - least + 1, STEP)]  # each window is in one piece
        parts: list[tuple] = []
        at = 0
        while at < len(pieces):
            group, size, begin = [], 0, at
            while at < len(pieces) and (not group or size + len(pieces[at][2]) <= STEP):
                group.append(pieces[at][2])
                size += len(pieces[at][2])
                at += 1
            ends = np.cumsum([len(x) for x in group])
            piece, first, count, a, h = segments(np.frombuffer(b"".join(group), np.uint8), ends, least)
            of, offset = (np.array(x, np.int64)[piece] for x in ([p[0] for p in pieces[begin:at]], [p[1] for p in pieces[begin:at]]))
            parts.append((of, first - np.concatenate([[0], ends])[piece] + offset, count, a, h))
        text, start, count, a, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(mixed(a + h * np.uint64(3)), kind="stable")  # by text and start among equal ones
        a_, h_ = a[order], h[order]
        new = np.concatenate([[True], (a_[1:] != a_[:-1]) | (h_[1:] != h_[:-1])]) if len(a_) else np.zeros(0, bool)
        leader = order[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(a_) else order
        key = np.array([(d, k) for d, k, _ in docs], np.int64).reshape(-1, 2)
        same = (key[text[order]] == key[text[leader]]).all(1) & (start[order] == start[leader])  # repeated rows
        gone = np.ones(len(text), bool)
        gone[order[new | same]] = False
        r_text, r_start, r_count = ranges_of(text[gone], start[gone], count[gone])
        spread = mixed(r_text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + r_start.astype(np.uint64))
        both = lambda x, y, kind: pa.array(np.concatenate([x[~gone], y]).view(kind) if x.dtype == np.uint64 else np.concatenate([x[~gone], y]).astype(kind))
        texts = np.concatenate([text[~gone], r_text])
        return pa.RecordBatch.from_arrays([both(a, spread, np.int64), both(h, spread, np.int64), pa.array(key[texts, 0]), pa.array(key[texts, 1]), both(start, r_start, np.int32), both(count, r_count, np.int32), pa.array(np.arange(len(texts)) >= (~gone).sum())], [*names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in slices(batches, "_text"):
            for k, d, t in zip(*(b.column(c).to_pylist() for c in ("_k", "_doc", "_text")), strict=True):
                data = t.encode()
                if len(data) >= least:
                    held.append((d, k, data))
                    size += len(data)
                if size >= FLUSH:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def suffix_array(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of t in the order of their first `depth` symbols at least, and each one's place in that order."""
    bits = max(1, int(t.max()).bit_length())
    w = 1
    key = t.astype(np.uint64)
    while 2 * w * bits <= 64:
        key = (key << np.uint64(w * bits)) | np.concatenate([key[w:], np.zeros(min(w, len(key)), np.uint64)])[: len(key)]
        w *= 2
    while True:
        sa = np.argsort(key, kind="stable")
        sorted_key = key[sa]
        rank = np.empty(len(t), np.int64)
        rank[sa] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        if w >= depth or rank[sa[-1]] == len(t) - 1:
            place = np.empty(len(t), np.int64)
            place[sa] = np.arange(len(t))
            return sa, place
        beyond = np.zeros(len(t), np.int64)
        beyond[: len(t) - w] = rank[w:] + 1
        key = rank.astype(np.uint64) * np.uint64(len(t) + 1) + beyond.astype(np.uint64)
        w *= 2


def borders(t: np.ndarray, n_ends: int, sa: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
    """border[i]: suffixes i - 1 and i of the suffix array share fewer than `least` symbols.

    Symbols under n_ends are the texts' unique ends. Level l holds intervals of strings of length l; extending each
    backward by the symbols of its transform gives those of length l + 1. A border not yet known after such an interval has a common
    prefix of exactly l, and only intervals that find one are extended further.
    """
    n = len(t)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    counts = np.bincount(t)
    right = np.cumsum(counts[counts > 0]) - 1
    left = np.concatenate([[0], right[:-1] + 1])
    before = np.concatenate([[-1], np.arange(n - 1)])  # the place before each
    for _ in range(least):
        fresh = ~known[right + 1]
        left, right = left[fresh], right[fresh]
        known[right + 1] = True
        if not len(left):
            break
        single = left == right
        # one suffix: its transform has one symbol
        prev = before[sa[left[single]]]
        prev = prev[prev >= 0]
        one = place[prev[t[prev] >= n_ends]]
        many_l, many_r = left[~single], right[~single]
        size = many_r - many_l + 1
        total = int(size.sum())
        at = np.repeat(many_l - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else many_l, size) + np.arange(total)
        group = np.repeat(np.arange(len(size)), size)
        prev = before[sa[at]]
        ok = prev >= 0
        ok[ok] = t[prev[ok]] >= n_ends
        prev, group = prev[ok], group[ok]
        spot = place[prev]
        order = np.argsort(spot)
        spot, group, symbol = spot[order], group[order], t[prev[order]]
        new = np.concatenate([[True], (spot[1:] != spot[:-1] + 1) | (group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1])]) if len(spot) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(spot) - 1]]) if len(first) else first
        left, right = np.concatenate([one, spot[first]]), np.concatenate([one, spot[last]])
    return known[:n]


def block_repeats(parts: list[bytes], order: np.ndarray, start: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, offset) of the windows that also start earlier; part p is of the row order[p] and begins there at start[p]."""
    m = len(parts)
    length = np.array([len(x) for x in parts], np.int64)
    begin = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    t = np.zeros(int(length.sum()) + m, np.int64)
    is_end = np.zeros(len(t), bool)
    is_end[begin + length] = True
    t[~is_end] = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64) + m
    t[is_end] = np.arange(m)
    sa, place = suffix_array(t, least + 1)
    part = np.repeat(np.arange(m), length + 1)
    group = np.cumsum(borders(t, m, sa, place, least))
    offset = np.arange(len(t)) - begin[part]
    full = offset + least <= length[part]
    where = sa[full[sa]]
    group = group[full[sa]]
    key = (order[part[where]].astype(np.int64) << 32) + start[part[where]] + offset[where]
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    if not len(new):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.repeat(np.minimum.reduceat(key, new), np.diff(np.concatenate([new, [len(key)]])))
    late = np.sort(where[key > first])
    return part[late], offset[late]


def _cut_segments(least: int):
    """Texts with the places of their open segments -> the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", 1 << 18):
            out: dict[str, list] = {c: [] for c in ("a", "doc", "k", "start", "part")}
            for text, found in zip(b.column("_text"), b.column("found"), strict=True):
                data = text.as_py().encode()
                for x in found.as_py():
                    for c, v in (("a", x["a"]), ("doc", x["doc"]), ("k", x["k"]), ("start", x["start"]), ("part", data[x["start"] : x["start"] + x["n"] - 1 + least])):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[c], kind) for c, kind in (("a", pa.int64()), ("doc", pa.int64()), ("k", pa.int64()), ("start", pa.int32()), ("part", pa.binary()))], [*out])

    return run


def _search_blocks(least: int):
    """Segments sorted by anchor -> ranges of starts that go."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        doc, k, start = (t.column(c).to_numpy() for c in ("doc", "k", "start"))
        parts = t.column("part").to_pylist()
        _, order = np.unique(np.stack([doc, k], 1), axis=0, return_inverse=True)
        part, offset = block_repeats(parts, order.ravel(), start.astype(np.int64), least)
        p, s, n = ranges_of(part, offset, np.ones(len(part), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(k[p]), pa.array((start[p] + s).astype(np.int32)), pa.array(n.astype(np.int32))], ["k", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for t, begins in whole_groups(batches, ["a"]):
            lengths = np.concatenate([[0], np.cumsum(pc.binary_length(t.column("part")).to_numpy().astype(np.int64))])
            at = 0
            for e in [*begins[1:], t.num_rows]:  # blocks end between anchors
                if size + lengths[e] - lengths[at] >= BLOCK:
                    yield solve(pa.concat_tables([*held, t.slice(at, e - at)]))
                    held, size, at = [], 0, e
            if at < t.num_rows:
                held.append(t.slice(at))
                size += int(lengths[-1] - lengths[at])
        if held:
            yield solve(pa.concat_tables(held))

    return run


def anchor_place(part: np.ndarray, least: int) -> int:
    """Where the anchor of a segment's windows stands in it."""
    hashes = Hashes(part[:least])
    grams = mixed((hashes.sums[GRAM:] - hashes.sums[:-GRAM]) * hashes.down[: least - GRAM + 1])
    top = grams >> np.uint64(PLACE)
    return int(np.flatnonzero(top == top.min())[-1])


def _split(least: int, size: int):
    """Segments -> their windows in parts of at most `size`, by the anchor's place in the window. The windows of a part share a core of least - size + 1 bytes,
    whose hash is the part's new key, so parts meet only if they agree in more bytes. Equal parts are settled within a batch."""
    names = ("a", "h", "doc", "k", "start", "n", "gone", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in names}
            for doc, k, start, raw in zip(*(b.column(c).to_pylist() for c in ("doc", "k", "start", "part")), strict=True):
                part = np.frombuffer(raw, np.uint8)
                hashes, place = Hashes(part), anchor_place(part, least)
                last = len(part) - least
                for t in range((place - last) // size, place // size + 1):
                    s, e = max(0, place - (t * size + size - 1)), min(last, place - t * size)
                    core = (max(place - t * size, 0), place - min(t * size + size - 1, least - GRAM) + least)
                    ends = np.array([[core[0], core[1]], [s, e + least]])
                    x = hashes.of(ends[:, 0], ends[:, 1])
                    key = mixed(x + np.array([(t + 1) * 64 + size, (e - s + 1) * 8192 + size], np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64)
                    for c, v in zip(names, (int(key[0]), int(key[1]), doc, k, start + s, e - s + 1, False, raw[s : e + least] if size > 1 else b""), strict=True):
                        out[c].append(v)
            first: dict[tuple[int, int], tuple] = {}
            keys = [*zip(out["a"], out["h"], strict=True)]
            places = [*zip(out["doc"], out["k"], out["start"], strict=True)]
            for x, y in zip(keys, places, strict=True):
                first[x] = min(y, first.get(x, y))
            out["gone"] = [y > first[x] for x, y in zip(keys, places, strict=True)]
            out["part"] = [b"" if g else x for g, x in zip(out["gone"], out["part"], strict=True)]
            out["a"] = [hash((y, 1)) % (1 << 62) if g else x for x, y, g in zip(out["a"], places, out["gone"], strict=True)]  # settled: anywhere
            kinds = dict.fromkeys(("a", "h", "doc", "k"), pa.int64()) | {"start": pa.int32(), "n": pa.int32(), "gone": pa.bool_(), "part": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], kinds[c]) for c in names], [*names])

    return run


def without(data: bytes, found: list, least: int) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    if not found:
        return data, 0, 0
    edge = np.zeros(len(data) + 1, np.int64)
    start = np.array([x["start"] for x in found])
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + [x["n"] - 1 + least for x in found], len(data)), -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum())


#: Segments with their bytes, and the number of windows of a part in step 3.
SEGMENT = "a bigint, doc bigint, k bigint, start int, part binary"
SPLIT = 17


def frequent(found: DataFrame) -> DataFrame:
    """The anchors with more than 1 / HOT_KEYS of a written table's rows, about: a sketch of bounded size counts them. It only balances tasks; no result depends on it."""
    most = max(FEW, found.count() // HOT_KEYS)
    top = found.agg(F.expr(f"approx_top_k(a, {HOT_KEYS}, {4 * HOT_KEYS})").alias("top")).select(F.explode("top").alias("x"))
    return top.where(F.col("x.count") > most).select(F.col("x.item").alias("a"), F.lit(True).alias("_hot"))


def settle(found: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Of equal segments all but the first are gone. Anchors come to tasks whole, and those with one segment drop out, except for the few in `hot`: their
    segments are dealt out one by one. Without hot, all are. One exchange and one sort serve both windows."""
    deal = F.col("h") if hot is None else F.when(F.col("_hot"), F.col("h"))
    rows = (found if hot is None else found.join(F.broadcast(hot), "a", "left")).withColumn("_deal", deal)
    by_segment = Window.partitionBy("a", "_deal", "h").orderBy("doc", "k", "start")
    ranked = rows.repartition("a", "_deal").sortWithinPartitions("a", "_deal", "h", "doc", "k", "start").withColumn("_rank", F.rank().over(by_segment)).withColumn("gone", F.col("gone") | (F.col("_rank") > 1))
    if hot is not None:
        by_anchor = Window.partitionBy("a", "_deal")
        ranked = ranked.withColumn("_several", F.col("_hot").isNotNull() | (F.min("h").over(by_anchor) != F.max("h").over(by_anchor))).where("gone or _several").drop("_several", "_hot")
    return ranked.drop("_rank", "_deal")


def _search(docs: DataFrame, carried: list[str], least: int, most_segments: int, id_col: str, text_col: str, digests: bool) -> DataFrame:
    """Struct _id of the carried columns, n_bytes, n_removed, n_spans, _last (the remaining text, or its digest) of each row."""
    small_batches(docs.sparkSession)
    text = F.coalesce(text_col, F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("bigint"), F.lit(2**63 - 1)).alias("_doc")
    keyed = docs.select(F.xxhash64(F.col(id_col), text).alias("_k"), second_hash(docs, *carried, text).alias("_c"), F.struct(*[F.col(c) for c in carried]).alias("_id"), doc, text.alias("_text"))
    keyed = collapsed(keyed, ["_k", "_c"])  # rows that are equal in all that is carried are searched once
    found = keyed.select("_k", "_doc", "_text").mapInArrow(_first_pass(least), "a bigint, h bigint, doc bigint, k bigint, start int, n int, gone boolean")
    keyed = keyed.select("_k", F.struct("_id", "_copies").alias("_id"), "_text")
    others = written()
    found = materialise(found, "segments")
    first_table = [p for p in written() if p not in others]
    settled = materialise(settle(found, frequent(found)).drop("h"), "repeats")
    release(docs.sparkSession, [p for p in written() if p not in first_table])

    def few_and_many(open_: DataFrame, total: int) -> DataFrame:
        """The segments of anchors with several, with hot for those of anchors with too many."""
        size = open_.groupBy("a").agg(F.count("*").alias("_n")).where("_n > 1").withColumn("hot", F.when(F.col("_n") > most_segments, True))
        return salted_join(open_, size, ["a"], "_n", total, "k", "start")

    n = settled.where("not gone").count()
    places = few_and_many(settled.where("not gone"), n).groupBy("k").agg(F.collect_list(F.struct("a", "doc", "k", "start", "n", "hot")).alias("found"))
    rows = keyed.repartition("_k")  # all branches take the same columns of it, so Spark reuses the exchange

    def cut(hot: bool) -> DataFrame:
        own = places.select(F.col("k").alias("_k"), F.filter("found", lambda x: x["hot"].isNotNull() if hot else x["hot"].isNull()).alias("found")).where(F.size("found") > 0)
        return rows.join(own.hint("shuffle_hash"), "_k").select("_id", "_text", "found").mapInArrow(_cut_segments(least), SEGMENT)

    split = "a bigint, h bigint, doc bigint, k bigint, start int, n int, gone boolean, part binary"
    parts = settle(cut(True).mapInArrow(_split(least, SPLIT), split))
    parted = few_and_many(parts.where("not gone").select("a", "doc", "k", "start", "part"), n * (least // SPLIT + 2))
    windows = settle(parted.where("hot").select("doc", "k", "start", "part").mapInArrow(_split(least, 1), split))
    few = cut(False).unionByName(parted.where("hot is null").drop("hot"))
    searched = few.repartition("a").sortWithinPartitions("a").mapInArrow(_search_blocks(least), "k bigint, start int, n int")
    goes = [x.where("gone").select("k", "start", "n") for x in (settled, parts, windows)] + [searched]
    gone = goes[0]
    for x in goes[1:]:
        gone = gone.unionByName(x)
    gone = gone.groupBy(F.col("k").alias("_k")).agg(F.collect_list(F.struct("start", "n")).alias("found"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text"):
            data = [t.encode() for t in b.column("_text").to_pylist()]
            out = [without(d, f, least) for d, f in zip(data, b.column("found").to_pylist(), strict=True)]
            last = [hashlib.sha256(x).hexdigest() if digests else x.decode("utf-8", "ignore") for x, *_ in out]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array([len(d) for d in data], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array(last, pa.string())], ["_id", "n_bytes", "n_removed", "n_spans", "_last"])

    kind = keyed.schema["_id"].dataType.simpleString()
    out = rows.join(gone.hint("shuffle_hash"), "_k", "left").select("_id", "_k", "_text", "found").drop("_k").mapInArrow(finish, f"_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, _last string")
    return copied(out.select(F.col("_id._id").alias("_id"), "n_bytes", "n_removed", "n_spans", "_last", F.col("_id._copies").alias("_copies")))


def remove_repeats(docs: DataFrame, least: int = 100, most_segments: int = 5000, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_text) of each row; with digests kept_sha256, the lowercase hex sha256 of the remaining bytes, instead of the
    text. Bytes of characters that were cut through do not appear in kept_text."""
    out = _search(docs, [id_col], least, most_segments, id_col, text_col, digests)
    return out.select(F.col("_id")[id_col].alias(id_col), "n_bytes", "n_removed", "n_spans", F.col("_last").alias("kept_sha256" if digests else "kept_text"))


def rewrite(docs: DataFrame, least: int = 100, most_segments: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all their columns and the remaining text; rows that lost bytes and have no word left go. A null text stays null."""
    out = _search(docs.withColumn("_was_null", F.col(text_col).isNull()), [c for c in docs.columns if c != text_col] + ["_was_null"], least, most_segments, id_col, text_col, False)
    out = out.where((F.col("n_removed") == 0) | (F.trim(F.translate("_last", "\t\n\x0b\x0c\r", "     ")) != ""))
    text = F.when(~F.col("_id")["_was_null"], F.col("_last"))
    return out.select(*[text.alias(c) if c == text_col else F.col("_id")[c].alias(c) for c in docs.columns])


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digests=True)
