import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score int, id string"


def plain(rows, every=10):
    good = [(i, la, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)) for i, v, la, *_ in rows if i is not None and la is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for *_, v in good), default=0)
    good = {i: (la, np.pad(v, (0, dim - len(v)))) for i, la, v in sorted(good, key=lambda g: (g[0], g[1], g[2].tolist()), reverse=True)}
    out = []
    for a, (la, x) in good.items():
        if a % every:
            continue
        scored = sorted((-int(x @ v), i, lb) for i, (lb, v) in good.items() if i != a)
        for s, p, _ in [t for t in scored if t[2] == la][:5]:
            fit = [t for t in scored if t[2] != la and -80 * s <= -100 * t[0] <= -100 * s][:5]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, every=10):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, negatives.mine(negatives.whole_rows(df), F.col("id") % every == 0).collect()))


def sample(n, dim, seed, clusters=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = centres[rng.integers(clusters, size=n)] + rng.normal(size=(n, dim)) * 0.4
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, [float(v) for v in x[i]], int(rng.integers(3)), 0, "c") for i in range(n)]


@pytest.mark.parametrize("shard", [4096, 60])
def test_against_plain(spark, monkeypatch, shard):
    monkeypatch.setattr(negatives, "SHARD", shard)
    monkeypatch.setattr(negatives, "BLOCK", 20)
    rows = sample(500, 12, 1)
    same = [(1000 + i, rows[3][1], i % 3, 0, "c") for i in range(150)]  # a hot cell of equal vectors
    assert mined(spark, rows + same) == plain(rows + same)


def test_edge_cases(spark):
    rows = sample(60, 5, 2)
    odd = [(100, None, 1, 0, ""), (101, [1.0, float("nan")], 1, 0, ""), (102, [None, 1.0], 1, 0, ""), (110, [float("inf")], 0, 0, ""), (None, [1.0], 0, 0, ""), (103, [0.5], None, 0, ""), (120, [], 1, 0, ""), (130, [0.7, 0.7], 2, 0, ""), rows[0], rows[0], (10, [9.0] * 5, 2, 0, ""), (140, [30000.0, -30000.0], 0, 0, "")]
    assert mined(spark, rows + odd) == plain(rows + odd)
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 0, 0, ""), (1, [1.0], 1, 0, "")]) == []  # no positive
    assert mined(spark, [(0, [1.0], 0, 0, ""), (1, [1.0], 0, 0, ""), (2, [0.9], 1, 0, "")]) == [(0, 1, 1, 2, 65536, 58880)]


def test_walk_stops_once_certified():
    """In separated clusters a walk visits few cells and finds what a scan finds."""
    rng = np.random.default_rng(4)
    x = np.round((rng.integers(-1, 2, size=(40, 8)) * 200)[rng.integers(40, size=3000)] + rng.normal(size=(3000, 8)) * 3).astype(np.int64)
    books = tuple(negatives.codebook(x[:, h].astype(float), 30) for h in (slice(0, 4), slice(4, 8)))
    codes = [negatives.nearest(x[:, h].astype(float), b) for h, b in zip((slice(0, 4), slice(4, 8)), books, strict=True)]
    order = np.lexsort((codes[1], codes[0]))
    x, codes = x[order], [c[order].astype(np.int64) for c in codes]
    ids = np.arange(3000)
    packed = dict(zip(negatives._PACKED, [ids.tobytes(), np.zeros(3000, np.int64).tobytes(), codes[0].tobytes(), codes[1].tobytes(), np.zeros(3000, np.int64).tobytes(), x.astype(np.int16).tobytes()], strict=True))
    shard = negatives.Shard(packed, books, 8)
    visits = []
    for a in range(0, 3000, 100):
        bounds = shard.bounds(x[[a]])
        far = np.array([1 << 62])
        w = negatives.Windows(-far, far, -far, 5)
        visits.append(negatives.walk(shard, (bounds[0][0], bounds[1][0]), a, 0, x[a], w, True))
        want = sorted((-int(s), i) for i, s in enumerate(x @ x[a]) if i != a)[:5]
        assert w.best[0] == want
    assert np.median(visits) < 0.5 * len(shard.cells)
