import hashlib
import random

import numpy as np
import pytest
from tidemark.llm import repeats


def brute(rows, least):
    """(n_bytes, n_removed, n_spans, sha256) by id, for distinct ids."""
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - least + 1):
            w = data[s : s + least]
            if w in seen:
                gone[s : s + least] = True
            seen.add(w)
        left = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[i] = (len(data), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(data) else 0, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize("most_segments", [20_000, 2])
def test_against_brute_force(docs, no_docs, most_segments):
    source = {r.doc_id: r.text for r in docs.collect()}
    got = repeats.remove_repeats(docs, most_segments=most_segments, digests=True).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(source, 100)
    if most_segments > 2:
        assert repeats.remove_repeats(no_docs).count() == 0


def test_partial_overlaps(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    pool = [word(n) for n in (99, 100, 101, 130, 160, 250, 60, 45, 700)]
    rows = {i: "".join(rng.choice(pool) if rng.random() < 0.6 else word(rng.randint(1, 90)) for _ in range(rng.randint(1, 9))) for i in range(120)}
    rows[200], rows[201] = "ab" * 300, "é" * 180 + "ab" * 70
    df = spark.createDataFrame([*rows.items()], "doc_id long, text string").repartition(7)
    for most in (20_000, 3):
        got = repeats.remove_repeats(df, most_segments=most, digests=True).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(rows, 100)


def test_frequent_anchors_and_pieces(spark, monkeypatch):
    """Segments of hot anchors are dealt out one by one; texts over several pieces."""
    from tidemark.llm import common

    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line = word(70)
    rows = {i: word(60) + line + word(60) for i in range(80)} | {i: word(30) + line + "same passage " * 6 for i in range(80, 110)}
    rows[200] = rows[3] * 3 + word(900) + rows[90]
    monkeypatch.setattr(common, "FEW", 5)
    monkeypatch.setattr(repeats, "FEW", 5)
    docs = spark.createDataFrame([*rows.items()], "doc_id long, text string").repartition(9)
    for step in (repeats.STEP, 128):
        monkeypatch.setattr(repeats, "STEP", step)
        whole = [b.to_pylist() for b in repeats._first_pass(100)(iter([_batch(rows)]))]
        assert len(whole) == 1
        got = repeats.remove_repeats(docs, most_segments=20, digests=True).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute(rows, 100)


def _batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([*rows]), pa.array([*rows]), pa.array([*rows.values()])], ["_k", "_doc", "_text"])


def test_a_text_is_hashed_in_pieces_alike(monkeypatch):
    rng = random.Random(3)
    rows = {1: "".join(rng.choice("abc") for _ in range(3000)), 2: "".join(rng.choice("abc") for _ in range(130))}
    covered = []
    for step in (repeats.STEP, 150):
        monkeypatch.setattr(repeats, "STEP", step)
        found = [r for b in repeats._first_pass(100)(iter([_batch(rows)])) for r in b.to_pylist()]
        covered.append(sorted((r["doc"], s, r["a"]) for r in found if not r["gone"] for s in range(r["start"], r["start"] + r["n"])))
    assert covered[0] == covered[1] and len(covered[0]) == 2901 + 31


def test_borders_are_those_of_common_prefixes():
    rng = np.random.default_rng(0)
    parts = [bytes(rng.integers(97, 99, rng.integers(1, 40)).astype(np.uint8)) for _ in range(12)] + [b"ab" * 20] * 2
    m, least = len(parts), 6
    t = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int64) + m, i) for i, p in enumerate(parts)])
    sa, place = repeats.suffix_array(t, least + 1)
    got = repeats.borders(t, m, sa, place, least)
    for i in range(1, len(t)):
        a, b, k = sa[i - 1], sa[i], 0
        while k < least and max(a, b) + k < len(t) and t[a + k] == t[b + k] and t[a + k] >= m:
            k += 1
        assert got[i] == (k < least)
