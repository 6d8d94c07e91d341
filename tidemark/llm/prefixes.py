"""A prefix trie of conversations, grown as a burst trie.

Containers hold what conversations have below a head of the trie. A container with too many turns bursts: its common prefix becomes a chain of trie nodes, and its members go to
smaller containers by their next turn's id. What remains fits into a task, is sorted, and is swept into nodes; totals of subtrees go up the heads, round by round.

Defined cases: a null role or text is empty; rows with a null conv_id take no part; turns go by (turn, null first), ties by the turn's hash, and repeated rows are turns of their own; an empty table has
no node, not even the root; extra columns are not read. Equal conversations are one class from the start. A turn is told by 128 bits of its role and text, a class by 128 bits of its turns.
Conversations are arrays of 24 bytes a turn: the texts are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, salted_join, slices, small_batches, table

#: Turns below its head from which on a container with several classes bursts; and the largest number of turns that a conversation lends to others.
MOST_TURNS = 50_000
HEAD = 8
_NODES = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_EMPTY = hashlib.sha256().hexdigest()


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): a conversation's turns in order, each an id and the bytes of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    name = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.where("conv_id is not null").select("conv_id", F.struct("turn", name.alias("id"), F.octet_length(text).cast("bigint").alias("bytes")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"))).alias("path"))


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, path) with the first h turns of conversation c - c % 5 in place of one's own; h = crc32(c) % 9. At most eight turns of a base are joined to at most five conversations (nine around 0)."""
    own = own.withColumns({"_h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int"), "_base": F.col("conv_id") - F.col("conv_id") % 5})
    bases = own.where("conv_id = _base").select("_base", F.slice("path", 1, HEAD).alias("_head"))
    both = own.join(bases.hint("merge"), "_base", "left").withColumn("_head", F.coalesce("_head", F.slice("path", 1, 0)))
    rest = F.when(F.size("path") > F.col("_h"), F.slice("path", F.col("_h") + 1, F.greatest(F.size("path") - F.col("_h"), F.lit(1)))).otherwise(F.slice("path", 1, 0))
    return both.select("conv_id", F.concat(F.slice("_head", F.lit(1), F.col("_h")), rest).alias("path"))


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each class's ids, out of rows sorted by class and id."""
    key, digest = None, None
    for b in batches:
        out: list[tuple] = []
        for k0, k1, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key == (k0, k1):
                digest.update(b",%d" % conv)
            else:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (k0, k1), hashlib.sha256(b"%d" % conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["k0", "k1", "ends"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], ["k0", "k1", "ends"])


def classes_of_paths(rows: DataFrame) -> DataFrame:
    """(path, n, conv, ends) of the distinct paths: members, smallest member, digest of all. Only ids of classes with several members go through one task each, in order."""
    keyed = materialise(rows.withColumns({f"k{i}": F.xxhash64(F.lit(i), "path") for i in (0, 1)}), "paths")
    classes = keyed.groupBy("k0", "k1").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"), F.first("path").alias("path"))
    many = classes.where("n > 1").select("k0", "k1", F.col("n").alias("_n"))
    members = keyed.select("k0", "k1", "conv_id").join(many.hint("shuffle_hash"), ["k0", "k1"]).drop("_n")
    digests = members.repartition("k0", "k1").sortWithinPartitions("k0", "k1", "conv_id").mapInArrow(_end_digests, "k0 bigint, k1 bigint, ends string")
    own = F.sha2(F.col("conv").cast("string"), 256)
    return classes.join(digests.hint("merge"), ["k0", "k1"], "left").select("path", "n", "conv", F.coalesce("ends", own).alias("ends"))


def _shared(low: Column, high: Column) -> Column:
    """How many turns two paths share at their start."""
    differs = F.array_position(F.zip_with(low, high, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.least(F.size(low), F.size(high))).cast("bigint")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole containers, out of rows sorted by container and path."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent", "top"]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.bool_()]

    def nodes(members: list[tuple], head: int, parent: bytes | None, parent_conv: int | None) -> list[list]:
        """members: (ids, bytes, n, conv, ends), sorted by ids."""
        found: list[list] = []  # [conv, depth, index of the parent, n_convs, n_children, n_leaves, saved, ends, bytes], parents first
        stack: list[int] = []  # open nodes, from the depth of the head on
        before: list[bytes] = []
        for ids, sizes, n, conv, ends in members:
            same = head
            if stack:
                most = min(len(ids), len(before))
                while same < most and ids[same] == before[same]:
                    same += 1
                del stack[same - head + 1 :]
                first = same + 1
            else:
                first = head
            for depth in range(first, len(ids) + 1):
                found.append([conv, depth, stack[-1] if stack else -1, 0, 0, 0, 0, _EMPTY, sizes[depth - 1] if depth else 0])
                stack.append(len(found) - 1)
            end = found[stack[-1]]
            end[0], end[3], end[7] = min(end[0], conv), end[3] + n, ends
            before = ids
        for x in reversed(found):
            x[5] = x[5] or 1
            x[6] += (x[3] - 1) * x[8]
            if x[2] >= 0:
                above = found[x[2]]
                above[0], above[3], above[4], above[5], above[6] = min(above[0], x[0]), above[3] + x[3], above[4] + 1, above[5] + x[5], above[6] + x[6]
        for x in found:
            top = x[2] < 0
            x[8:] = [parent if top else None, top]
            x[2] = parent_conv if top else found[x[2]][0]
        return found

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    at, members, out = None, [], []
    for b in slices(batches, "path"):
        turns = b.column("path")
        offsets = turns.offsets.to_pylist()
        ids, sizes = turns.values.field("id").to_pylist(), turns.values.field("bytes").to_pylist()
        columns = [b.column(c).to_pylist() for c in ("cid", "depth", "parent", "parent_conv", "n", "conv", "ends")]
        for i, (cid, depth, parent, parent_conv, n, conv, ends) in enumerate(zip(*columns, strict=True)):
            if at is None or at[0] != cid:
                if at is not None:
                    out += nodes(members, *at[1:])
                at, members = (cid, depth, parent, parent_conv), []
            members.append((ids[offsets[i] : offsets[i + 1]], sizes[offsets[i] : offsets[i + 1]], n, conv, ends))
            if len(out) >= 20_000:
                yield batch(out)
                out = []
    if at is not None:
        out += nodes(members, *at[1:])
    if out:
        yield batch(out)


def trie(rows: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """The nodes of the trie of (conv_id, path): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Each round bursts all oversized containers at the end of their common prefix, so that a long shared prefix takes one round and not one for each turn. Rows of a container are counted
    before the shuffle, and those of hot ones dealt out (common.salted_join).
    """
    spark = rows.sparkSession
    small_batches(spark)
    no = F.lit(None)
    now = classes_of_paths(rows).select(F.unhex(F.lit("")).alias("cid"), F.lit(0).cast("bigint").alias("depth"), no.cast("binary").alias("parent"), no.cast("bigint").alias("parent_conv"), "path", "n", "conv", "ends")
    now = materialise(now, "container")
    ready, heads = [], []
    while True:
        stats = now.groupBy("cid").agg(F.count("*").alias("_m"), F.sum(F.size("path") - F.col("depth")).alias("_turns"), F.min("path").alias("_low"), F.max("path").alias("_high"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv"), *[F.first(c).alias(c) for c in ("depth", "parent", "parent_conv")])
        big = stats.where((F.col("_m") > 1) & (F.col("_turns") > most_turns)).withColumn("end", _shared(F.col("_low"), F.col("_high")))
        big = materialise(big.withColumn("sizes", F.expr("transform(slice(_low, 1, cast(end as int)), t -> t.bytes)")).drop("_low", "_high", "_turns"), "heads")
        if big.isEmpty():
            ready.append(now)
            break
        burst = salted_join(now, big.select("cid", "_m", F.col("end").alias("_end"), F.col("conv").alias("_conv")), ["cid"], "_m", now.count(), "conv", how="left")
        below = F.unhex(F.md5(F.concat("cid", F.expr("path[cast(_end as int)].id"))))
        state = F.when(F.col("_end").isNull(), 0).when(F.size("path") == F.col("_end"), 1).otherwise(2).alias("_state")  # stays, ends at the head, goes down
        moves = F.col("_state") == 2
        put = lambda new, old: F.when(moves, new).otherwise(F.col(old)).alias(old)
        burst = burst.withColumn("_state", state).select(put(below, "cid"), put(F.col("_end") + 1, "depth"), put(F.col("cid"), "parent"), put(F.col("_conv"), "parent_conv"), "path", "n", "conv", "ends", "_state")
        burst = materialise(burst, "container")
        ready.append(burst.where("_state = 0").drop("_state"))
        heads.append((big, burst.where("_state = 1").select("cid", "ends")))
        now = burst.where("_state = 2").drop("_state")

    contained = ready[0]
    for x in ready[1:]:
        contained = contained.unionByName(x)
    contained = contained.repartition("cid").sortWithinPartitions("cid", "path").select("cid", "depth", "parent", "parent_conv", "path", "n", "conv", "ends")
    swept = materialise(contained.mapInArrow(_sweep, f"{_NODES}, parent binary, top boolean"), "nodes")
    columns = [c.split()[0] for c in _NODES.split(", ")]
    out = swept.select(*columns)
    total = [F.sum(c).alias(c) for c in ("children", "n_leaves", "saved_tokens")]
    sums = swept.where("top and parent is not null").select(F.col("parent").alias("cid"), F.lit(1).cast("bigint").alias("children"), "n_leaves", "saved_tokens")
    if heads:
        sums = materialise(sums.groupBy("cid").agg(*total), "sums")
    for big, ended in reversed(heads):
        here = big.join(sums.groupBy("cid").agg(*total).hint("merge"), "cid").join(ended.hint("merge"), "cid", "left")
        steps = here.withColumn("d", F.explode(F.sequence("depth", "end"))).withColumn("_saved", (F.col("n_convs") - 1) * F.coalesce(F.get("sizes", (F.col("d") - 1).cast("int")), F.lit(0)))
        below = F.sum("_saved").over(Window.partitionBy("cid").orderBy(F.desc("d")))
        chain = steps.withColumn("saved_tokens", F.col("saved_tokens") + below)
        last = F.col("d") == F.col("end")
        chain = chain.select("cid", "parent", (F.col("d") == F.col("depth")).alias("top"), "conv", F.col("d").alias("depth"), F.when(F.col("d") == F.col("depth"), F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"), "n_convs", F.when(last, F.col("children")).otherwise(1).alias("n_children"), "n_leaves", "saved_tokens", F.when(last, F.coalesce("ends", F.lit(_EMPTY))).otherwise(_EMPTY).alias("ends_sha256"))
        chain = materialise(chain, "chain")
        out = out.unionByName(chain.withColumn("conv_id", F.col("conv")).select(*columns))
        sums = sums.unionByName(chain.where("top and parent is not null").select(F.col("parent").alias("cid"), F.lit(1).cast("bigint").alias("children"), "n_leaves", "saved_tokens"))
    return out


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(paths(table(spark, sf_dir, "conversations"))))


PREFIXES_SQL = """
WITH t AS (SELECT conv_id AS c, turn, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(x ORDER BY turn NULLS FIRST, x) AS s FROM t GROUP BY c),
tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(3988292384, a // 2) ELSE a // 2 END)) AS v),
h AS (SELECT c, s, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda z: ascii(z)::BIGINT)), lambda a, z: xor(a // 256, v[(xor(a, z) % 256 + 1)::BIGINT])), 4294967295) % 9 AS h FROM own, tab),
r AS (SELECT h.c, list_concat(coalesce(b.s, [])[1:h.h], h.s[h.h + 1:]) AS s FROM h LEFT JOIN own b ON b.c = h.c - h.c % 5),
p AS (SELECT c, d, len(s) AS l, md5(s[1:d]::VARCHAR) AS k, md5(s[1:greatest(d - 1, 0)]::VARCHAR) AS up, CASE WHEN d = 0 THEN 0 ELSE strlen(s[d].text) END AS bytes FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (SELECT k, d, min(up) AS up, min(c) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (l = d), '')) AS ends FROM p GROUP BY k, d),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS m FROM n WHERE d > 0 GROUP BY ALL),
above AS (SELECT DISTINCT q.k, q.d, p.k AS ak, p.d AS ad FROM p q JOIN p ON p.c = q.c AND p.d <= q.d),
sums AS (SELECT ak, ad, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (m IS NULL) AS leaves FROM above JOIN n USING (k, d) LEFT JOIN kids USING (k, d) GROUP BY ak, ad)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(m, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n LEFT JOIN n u ON u.k = n.up AND u.d = n.d - 1 LEFT JOIN kids ON kids.k = n.k AND kids.d = n.d JOIN sums ON ak = n.k AND ad = n.d"""
