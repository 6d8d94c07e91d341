import hashlib
import random
import zlib

import pytest
from tidemark.llm import prefixes


def plain_trie(conversations):
    """{id: turns} -> rows of the nodes."""
    nodes, kids = {}, {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
            if d:
                kids.setdefault(tuple(turns[: d - 1]), set()).add(tuple(turns[:d]))
    rows = []
    for k, members in nodes.items():
        below = [x for x in nodes if x[: len(k)] == k]
        saved = sum((len(nodes[x]) - 1) * len((x[-1][1] if x else "").encode()) for x in below)
        ends = ",".join(str(c) for c in sorted(c for c in members if len(conversations[c]) == len(k)))
        rows.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(kids.get(k, ())), sum(x not in kids for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def plain_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def rows_of(own, spark):
    rows = [(c, i, r, t, 7, b"x") for c, turns in own.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, path binary").repartition(3)


def compare(got, own):
    key = lambda r: (r[1], r[0], r[3], r[7])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_trie(own), key=key)


@pytest.mark.parametrize("most", [1, 12, 50_000])
def test_against_plain(spark, most):
    rng = random.Random(most)
    turn = lambda: (rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "", "ccc"]))
    shared = [turn() for _ in range(9)]
    own = {c: [turn() for _ in range(rng.randrange(1, 12))] for c in range(60)}
    own |= {c: shared[: rng.randrange(1, 10)] + [turn() for _ in range(rng.randrange(3))] for c in range(100, 150)}
    own |= {c: shared for c in range(200, 230)}
    df = rows_of(own, spark)
    compare(prefixes.trie(prefixes.paths(df), most), own)
    if most == 12:
        compare(prefixes.trie(prefixes.rebuilt(prefixes.paths(df)), most), plain_rebuilt(own))


def test_a_long_shared_prefix_is_one_burst(spark):
    long = [("user", f"turn {i}") for i in range(300)]
    own = {1: [*long, ("user", "x")], 2: [*long, ("user", "y")], 3: long, 4: long[:40]}
    compare(prefixes.trie(prefixes.paths(rows_of(own, spark)), 20), own)


def test_edge_cases(spark):
    df = spark.createDataFrame([(5, None, None, None), (5, 0, "user", "a"), (6, 0, "user", "a"), (6, 0, "user", "a"), (None, 0, "user", "gone"), (7, 0, "", "long" * 50_000)], "conv_id long, turn long, role string, text string")
    got = prefixes.trie(prefixes.paths(df))
    compare(got, {5: [("", ""), ("user", "a")], 6: [("user", "a"), ("user", "a")], 7: [("", "long" * 50_000)]})
    assert prefixes.trie(prefixes.paths(df.limit(0))).count() == 0
    turnless = spark.createDataFrame([(3, [])], prefixes.paths(df).schema)
    assert [tuple(r)[:6] for r in prefixes.trie(prefixes.paths(df).where("conv_id = 7").unionByName(turnless)).orderBy("depth").collect()] == [(3, 0, None, 2, 1, 1), (7, 1, 3, 1, 0, 1)]
