import numpy as np
import pytest
from tidemark.llm import near_vectors


def vectors(rng, n=160, d=64):
    base = rng.normal(size=(n, d))
    out = [*base]
    for i in range(n):
        for _ in range(i % 6):
            e = rng.normal(size=d)
            e -= e @ base[i] * base[i] / (base[i] @ base[i])
            e *= np.linalg.norm(base[i]) / np.linalg.norm(e)
            out.append(base[i] + e * np.tan(np.arccos(rng.uniform(0.88, 0.99))))
    return out


@pytest.mark.parametrize("most", [3000, 6])
def test_links_against_brute_force(spark, most):
    rng = np.random.default_rng(3)
    x = vectors(rng)
    x += [x[5], x[5], x[200], 3 * x[7]]
    rows = [(i * 2, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 64, [1.0, None] * 32, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0, 2.0]]
    rows += [(100_001 + i, v, None) for i, v in enumerate(odd)]
    got = {r.vec_id: r for r in near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, class int"), most_bucket=most).collect()}
    assert len(got) == len(rows)
    u = near_vectors.unit(np.array(x))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = np.array([got[2 * i].n_links for i in range(len(x))])
    assert (found <= near.sum(1)).all()
    assert found.sum() >= 0.99 * near.sum()
    for i in range(len(x)):
        if found[i] == near[i].sum():
            assert all(got[2 * int(j)].component_id == got[2 * i].component_id for j in np.flatnonzero(near[i]))
    for i in range(len(odd)):
        r = got[100_001 + i]
        assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_repeated_ids(spark):
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=16).tolist(), rng.normal(size=16).tolist()
    rows = [(1, a), (1, a), (1, b), (2, b), (None, a), (3, None), (3, None)]
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in got) == [(0, 2, 1, False), (1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 0, 3, True), (3, 0, 3, True)]


def test_recall_and_work_as_the_table_grows():
    """Hashes grow with the logarithm of the rows: a pair at the threshold is still found, and the posts that meet by chance grow little faster than the rows."""
    rng, met = np.random.default_rng(1), {}
    for n in (2000, 8000, 32_000):
        x = near_vectors.unit(rng.normal(size=(n, 64)))
        axes = near_vectors.axes_for(n, 64)
        tables = near_vectors.tables_for(axes, 64, 0.9, 0.995)
        codes = near_vectors.bucket_codes(x, tables, axes)
        _, count = np.unique(codes.ravel(), return_counts=True)
        met[n] = float((count * (count - 1) / 2).sum()) / n
        e = rng.normal(size=(1000, 64))
        e = near_vectors.unit(e - (e * x[:1000]).sum(1, keepdims=True) * x[:1000])
        near = near_vectors.bucket_codes(0.9 * x[:1000] + np.sqrt(1 - 0.81) * e, tables, axes)
        assert ((near == codes[:1000, :, :1]).any(2) | (codes[:1000] == near[:, :, :1]).any(2)).any(1).mean() > 0.98
    assert met[32_000] < 16**0.5 * met[2000]  # sixteen times the rows


@pytest.mark.parametrize("d", [1, 2, 16, 64, 700])
@pytest.mark.parametrize("cosine", [0.9, 0.99])
def test_sketches_of_linked_vectors_are_near(d, cosine):
    rng = np.random.default_rng(d)
    a, e = near_vectors.unit(rng.normal(size=(20_000, d))), rng.normal(size=(20_000, d))
    e = near_vectors.unit(e - (e * a).sum(1, keepdims=True) * a) if d > 1 else a
    b = near_vectors.unit(cosine * a + np.sqrt(1 - cosine * cosine) * e)
    differ = lambda x, y: np.bitwise_count((near_vectors.sketches(x) ^ near_vectors.sketches(y)).view(np.uint64)).sum(1)
    most = near_vectors.most_differing(cosine)
    assert (differ(a, b) <= most).all()
    if d >= 64:
        assert (differ(a[1:], a[:-1]) <= most).mean() < 0.0001


def test_floats_are_compared_as_doubles(spark):
    x = [v.astype(np.float32) for v in vectors(np.random.default_rng(6), 40)]
    got = {kind: {(r.vec_id, r.n_links) for r in near_vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")).collect()} for kind in ("float", "double")}
    assert got["float"] == got["double"]


def test_very_long_vectors(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=20_000)
    rows = [(1, a.tolist()), (2, (a + 0.01 * rng.normal(size=len(a))).tolist()), (3, rng.normal(size=len(a)).tolist()), (4, a.tolist())]
    got = near_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 2, 1)]


def test_small_and_large_buckets_agree(spark, monkeypatch):
    x = vectors(np.random.default_rng(5), 60)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    t = near_vectors.bucket_codes(near_vectors.unit(np.array(x)), 2, [64])
    assert t.shape == (len(x), 2, 3)
    assert {(r.vec_id, r.n_links) for r in near_vectors.near_duplicates(df).collect()} == {(r.vec_id, r.n_links) for r in near_vectors.near_duplicates(df, most_bucket=4).collect()}


def test_empty_table(spark):
    assert near_vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hadamard_is_orthogonal():
    h = near_vectors.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, 16 * np.eye(16)) and set(np.abs(h).ravel()) == {1.0}
