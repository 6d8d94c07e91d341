import random
import re

import numpy as np
import pytest
from tidemark.llm import near_texts
from tidemark.llm.common import salted_join, slices
from tidemark.llm.graph import connected_components


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize("bounds", [{}, {"most_list": 4, "most_elements": 600}])
def test_components_against_brute_force(docs, no_docs, bounds):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for width in (4,) if bounds else (4, 5):
        got = near_texts.near_duplicates(docs, width=width, **bounds).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, width, 80)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    if not bounds:
        assert near_texts.near_duplicates(no_docs).count() == 0


def test_groups_of_near_copies(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(4):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for k in range(30):
            words = list(base)
            for _ in range(k % 5):
                words[rng.randrange(120)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_texts.near_duplicates(df, width=4, most_list=10).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 4, 80)
    kept = near_texts.keep_one(df.withColumn("class", df.doc_id), width=4)
    assert kept.columns == ["doc_id", "text", "class"]
    assert {r.doc_id for r in kept.collect()} == {c for *_, c in brute(rows, 4, 80)}


def test_null_ids_and_texts(spark):
    long = " ".join(f"x{i}" for i in range(40))
    rows = [(None, long), (5, long), (3, long + " y"), (None, None), (7, None), (8, "")]
    got = near_texts.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(None, 3, False), (5, 3, False), (3, 3, True), (None, None, True), (7, 7, True), (8, 8, True)}


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(9, 9)]
    got = {r.v: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a)
        root.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in touched}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_merging_against_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(1, 12, rng.integers(1, 6))
        group = np.repeat(np.arange(len(sizes)), sizes)
        n, matches = len(group), int(rng.integers(1, 9))
        sig = rng.integers(-1, 2, (n, 8)).astype(np.int32)
        a, b = near_texts.merged(sig, group, matches)
        assert len(a) < n
        roots = []
        for edges in (zip(a, b, strict=True), [(i, j) for i in range(n) for j in range(i) if group[i] == group[j] and (sig[i] == sig[j]).sum() >= matches]):
            root, edges = list(range(n)), [*edges]
            for _ in range(n):
                for x, y in edges:
                    root[x] = root[y] = min(root[x], root[y])
            roots.append(root)
        assert roots[0] == roots[1]


def test_one_row_of_each_component_stays(spark):
    long, other = " ".join(f"x{i}" for i in range(40)), " ".join(f"z{i}" for i in range(30))
    rows = [(5, long, 1), (5, long, 1), (5, other, 2), (1, other, 3), (7, long + " y", 4), (None, long, 5), (8, None, 6), (8, None, 6), (9, " ", 7)]
    kept = near_texts.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _row0 int"))
    assert kept.columns == ["doc_id", "text", "_row0"]
    assert sorted((r.doc_id, r._row0) for r in kept.collect()) == [(1, 3), (5, 1), (8, 6), (9, 7)]
    nulls = spark.createDataFrame([(None, other), (None, other), (None, other + " w")], "doc_id long, text string")
    assert near_texts.keep_one(nulls).count() == 1 and near_texts.keep_one(nulls.limit(0)).count() == 0


def test_hot_keys_are_split(spark, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "FEW", 10)
    large = spark.range(3000).selectExpr("id", "if(id < 2000, -1, id % 50) AS k")
    small = large.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 AS twice")
    out = salted_join(large, small, ["k"], "n", 3000, "id")
    assert sorted((r.id, r.k, r.twice) for r in out.collect()) == sorted((r.id, r.k, 2 * r.k) for r in large.collect())
    assert out.columns == ["k", "id", "twice"]


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa

    texts = ["a" * 50, None, "", "b" * 5000, *["c" * 90] * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = [*slices(iter([batch, batch.slice(0, 0)]), "text", 1000)]
    assert [x for b in got for x in b.column("text").to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len(x or "") for x in b.column("text").to_pylist()) <= 1000 for b in got)
