"""MinHash near-duplicates by a signature-coordinate inverted join.

Texts become sets of hashed word shingles; rows with equal sets are one class. A class is posted under the pairs (coordinate,
value) of its signature. A pair of classes is a candidate if it collides under at least `matches` of the `coordinates`. By prefix filtering,
such a pair shares a posting list even if each class is posted only under its coordinates - matches + 1 rarest pairs; pairs that no
other class has come first in that order and are skipped, so that most texts are posted nowhere. The members of such a list
are then merged with each other (`merged`): the short posting lists of a signature are merged and their collisions counted, and the long ones are
skipped into only for members that can still reach the match threshold. Lists and components beyond a bound are split into cells of
blocks that cover every pair. Connected candidates are then compared on their full sets: a link needs 100 * intersection >=
100 * similarity * union. Only spanning edges leave a cell, never all pairs.

Candidates are found with a probability that depends on the similarity s: at least `matches` of `coordinates` Bernoulli(s) draws; at s = 0.8 the
defaults (16 of 32) miss fewer than 1 in 10,000. What is found is exact. A class is named by 128 bits of hash of its full set and the set's size.

Defined cases: null or blank text has the empty set and links with nothing; with fewer words than a shingle the whole sequence is the one
shingle; a text of any length is one set, held by one task at a time; equal ids with different texts are judged as two rows; repeated rows get
equal results; null ids never name a component unless all its ids are null; an empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import has_repeats, materialise, salted_join, slices, small_batches, table
from tidemark.llm.graph import cells, classes_of, component_ids, connected_components, whole_groups

#: Words whose hashes a worker remembers, and elements of sets in a batch that leaves it.
KNOWN, ELEMENTS = 50_000, 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of hashed shingles of `width` words; words are runs of anything but ASCII white space, A-Z lower-cased."""

    def __init__(self, width: int):
        rng = np.random.default_rng(41)
        self.width, self.known = width, {}
        self.factors = rng.integers(1, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def set_of(self, text: str | None) -> np.ndarray:
        words, known = (text or "").encode().lower().split(), self.known
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > KNOWN:
            known.clear()
        x = np.array([known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words], np.uint64)
        k = min(self.width, len(x))
        h = np.full(len(x) - k + 1, k, np.uint64)
        for i in range(k):
            h += x[i : len(x) - k + 1 + i] * self.factors[i]
        return np.unique(mixed(h))


def class_of(s: np.ndarray) -> bytes | None:
    """The 128-bit name of a set; None for the empty set."""
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def signature(s: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        least = np.minimum(least, ((s[at : at + 4096, None] ^ seeds[None, :]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(8)).min(0))
    return mixed(least).astype(np.uint32).view(np.int32)


def _sign(width: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seeds = Shingler(width), np.random.default_rng(43).integers(0, 1 << 64, coordinates, dtype=np.uint64)
        for b in slices(batches, "text"):
            size, name, sig = [], [], []
            for t in b.column("text"):
                s = shingler.set_of(t.as_py())
                size.append(len(s))
                name.append(class_of(s))
                sig.append(signature(s, seeds) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array(size, pa.int64()), pa.array(name, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], ["id", "row", "n_shingles", "class", "sig"])

    return run


def merged(sig: np.ndarray, group: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (row, row) of the pairs of rows of one group (0, 1, ...; rows come sorted by it) that collide under at least `matches` coordinates.

    One signature of each group is merged at a time, that of a row already reached if there is one. Its coordinates - matches + 1 shortest posting
    lists are merged and the collisions of each row counted; a pair that is sought must have one. Its longer lists are then looked into row by row, and a row
    that can't reach the threshold with the lists still to come is skipped. Rows reached leave the lists, so a group of near copies is merged once.
    """
    n, width = sig.shape
    lists, size = np.empty((n, width), np.int64), 0
    for k in range(width):
        _, x = np.unique((group.astype(np.int64) << 32) + sig[:, k].view(np.uint32), return_inverse=True)
        lists[:, k] = x.ravel() + size
        size = int(lists[:, k].max()) + 1
    order = np.argsort(np.bincount(lists.ravel(), minlength=size)[lists], axis=1, kind="stable")
    short = width - matches + 1
    free, waiting, root = np.ones(n, bool), np.zeros(n, bool), np.arange(n)
    left = np.bincount(group)
    query_of = np.zeros(len(left), np.int64)
    members = starts = None
    indexed = 2 * n + 1
    alive = np.arange(n)
    a, b = [], []
    while True:
        alive = alive[(free[alive] | waiting[alive]) & (left[group[alive]] > 0)]
        if not len(alive):
            break
        if 2 * np.count_nonzero(free) < indexed:
            rows = np.flatnonzero(free)
            indexed = len(rows)
            flat = lists[rows].ravel()
            by_list = np.argsort(flat, kind="stable")
            members, starts = np.repeat(rows, width)[by_list], np.searchsorted(flat[by_list], np.arange(size + 1))
        g = group[alive]
        q = np.minimum.reduceat(np.where(waiting[alive], 0, n) + alive, np.flatnonzero(np.append(True, g[1:] != g[:-1]))) % n
        new = q[free[q]]
        free[new] = waiting[q] = False
        left[group[new]] -= 1
        query_of[group[q]] = q
        t = np.take_along_axis(lists[q], order[q, :short], 1).ravel()
        length = starts[t + 1] - starts[t]
        x = members[np.repeat(starts[t] - np.cumsum(length) + length, length) + np.arange(length.sum())]
        hits = np.bincount(x[free[x]], minlength=n)
        x = np.flatnonzero(hits)
        hits, own = hits[x], query_of[group[x]]
        for k in range(short, width):
            can = hits + width - k >= matches
            if not can.all():
                x, hits, own = x[can], hits[can], own[can]
            if not len(x):
                break
            at = order[own, k]
            hits += lists[x, at] == lists[own, at]
        found = hits >= matches
        x, own = x[found], own[found]
        root[x] = root[own]
        free[x], waiting[x] = False, True
        left -= np.bincount(group[x], minlength=len(left))
        a.append(x)
        b.append(root[x])
    return np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])


def _candidates(matches: int, width: int):
    """Per cell of a posting list: spanning edges of the pairs that agree in enough coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, borders in whole_groups(batches, ["token", "i", "j"]):
            v, sig = t.column("v").to_numpy(), t.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, width)
            group = np.repeat(np.arange(len(borders)), np.diff([*borders, len(v)]))
            a, b = merged(sig, group, matches)
            yield pa.RecordBatch.from_arrays([pa.array(v[a]), pa.array(v[b])], ["a", "b"])

    return run


def linked_sets(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges from each set to its component's first set, of the sets linked by 100 * intersection >= percent * union. Exact: a set is
    compared with every other one that is not yet in its component."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(element, kind="stable")
    holders, start = owner[order], np.searchsorted(element[order], np.arange(element.max() + 2))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    root = np.arange(n)
    for i in range(n - 1):
        if (root == root[i]).all():
            break
        own = element[begin[i] : begin[i + 1]]
        common = np.bincount(np.concatenate([holders[start[x] : start[x + 1]] for x in own]), minlength=n)
        for r in np.unique(root[(100 * common >= percent * (sizes[i] + sizes - common)) & (root != root[i])]):
            root[root == r] = min(r, root[i])
            root[root == root[i]] = min(r, root[i])
    return [(x, int(root[x])) for x in range(n) if root[x] != x]


def _shingle_cells(width: int):
    """Texts of candidates -> their sets, one row for each cell that the class belongs to."""
    kinds = {"root": pa.int64(), "i": pa.int32(), "j": pa.int32(), "v": pa.int64(), "set": pa.list_(pa.int64())}
    pack = lambda out: pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for k, x in out.items()], [*out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for b in slices(batches, "text"):
            out: dict[str, list] = {k: [] for k in kinds}
            size = 0
            for text, v, root, places in zip(*(b.column(c) for c in ("text", "v", "root", "places")), strict=True):
                s = shingler.set_of(text.as_py()).view(np.int64)
                for p in places.as_py():
                    for k, x in (("root", root.as_py()), ("i", p["i"]), ("j", p["j"]), ("v", v.as_py()), ("set", s)):
                        out[k].append(x)
                    size += len(s)
                    if size > ELEMENTS:
                        yield pack(out)
                        out, size = {k: [] for k in kinds}, 0
            yield pack(out)

    return run


def _links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, borders in whole_groups(batches, ["root", "i", "j"]):
            v, sets = t.column("v").to_numpy(), t.column("set").combine_chunks()
            flat, offsets = sets.flatten().to_numpy(), sets.offsets.to_numpy() - sets.offsets[0].as_py()
            a, b = [], []
            for s, e in zip(borders, [*borders[1:], len(v)], strict=True):
                if e - s > 1:
                    for x, y in linked_sets([flat[offsets[k] : offsets[k + 1]] for k in range(s, e)], percent):
                        a.append(v[s + x])
                        b.append(v[s + y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _judged(docs: DataFrame, width: int, similarity: float, coordinates: int, matches: int, most_list: int, most_elements: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, row (a hash of id and text), n_shingles, class and `_first`, the id and hash of its component's first row (both null for the empty set)."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = materialise(own.mapInArrow(_sign(width, coordinates), f"id {kind}, row bigint, n_shingles bigint, class binary, sig array<int>"), "signatures")
    classes = classes_of(rows, ["class", "n_shingles"], ["id", "row"], sig=F.first("sig"))

    tokens = classes.select("v", F.posexplode("sig").alias("at", "value")).select("v", (F.shiftleft(F.col("at").cast("bigint"), 32).bitwiseOR(F.col("value").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("token"))
    frequent = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").withColumn("_rows", F.col("n"))
    shared = salted_join(tokens, frequent, ["token"], "_rows", coordinates * classes.count(), "v").groupBy("v").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("shared")).where(F.size("shared") >= matches)
    prefix = shared.select("v", F.expr(f"transform(slice(shared, 1, size(shared) - {matches - 1}), x -> x.token)").alias("prefix"))
    posts = materialise(prefix.join(classes.select("v", "sig").hint("merge"), "v").select("v", "sig", F.explode("prefix").alias("token")), "posts")
    placed = cells(posts, ["token"], most_list, least=2)
    sorted_cells = placed.select("token", "i", "j", "v", "sig").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "v")
    candidates = connected_components(sorted_cells.mapInArrow(_candidates(matches, coordinates), "a bigint, b bigint"))

    members = materialise(candidates.join(classes.select("v", F.col("_first.row").alias("row"), "n_shingles").hint("merge"), "v"), "members")
    places = cells(members, ["root"], most_elements, weight=F.col("n_shingles")).groupBy("row", "v", "root").agg(F.collect_list(F.struct("i", "j")).alias("places"))
    given = own.select("row", "text")
    if has_repeats(rows, "row"):  # a set is compared once, however often its row is given
        given = given.groupBy("row").agg(F.first("text").alias("text"))
    texts = given.join(places.hint("shuffle_hash"), "row").select("text", "v", "root", "places")
    sets = texts.mapInArrow(_shingle_cells(width), "root bigint, i int, j int, v bigint, set array<bigint>").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "v")
    links = sets.mapInArrow(_links(round(100 * similarity)), "a bigint, b bigint")
    return component_ids(rows.drop("sig"), ["class", "n_shingles"], classes, links, "row")


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, coordinates: int = 32, matches: int = 16, most_list: int = 3000, most_elements: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable over links, itself included), kept (id = component_id)."""
    out = _judged(docs, width, similarity, coordinates, matches, most_list, most_elements, id_col, text_col)
    out = out.withColumn("component_id", F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("_first.id")))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, coordinates: int = 32, matches: int = 16, most_list: int = 3000, most_elements: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all its columns: that of the smallest id and, of rows with that id, of the least hash of id and text. Of repeated rows
    (equal id and text) one stays, also of those with the empty set, which otherwise all stay."""
    judged = _judged(docs, width, similarity, coordinates, matches, most_list, most_elements, id_col, text_col)
    stays = judged.where(F.col("class").isNull() | (F.col("row") == F.col("_first.row"))).select("row").distinct()
    name, more = [f"_row{i}" for i in range(len(docs.columns) + 2) if f"_row{i}" not in docs.columns][:2]
    rows = docs.withColumns({name: F.xxhash64(F.col(id_col), F.col(text_col)), more: F.xxhash64(F.lit(1), F.col(id_col), F.col(text_col))})  # rows are told apart by both
    return rows.join(stays.withColumnRenamed("row", name).hint("shuffle_hash"), name, "left_semi").dropDuplicates([name, more]).drop(name, more)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)
