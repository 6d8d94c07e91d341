import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.functions import blocks as B
from tidemark.functions.windows import sequences
from tidemark.plans import features as X
from tidemark.plans import labels as L


@pytest.fixture(scope="module")
def panel(spark):
    """A long series, a short one, and one with years of few rows and long gaps; the context has gaps too."""
    rng = np.random.default_rng(7)
    days = pd.bdate_range("2014-01-01", periods=900)
    some = {"LONG": days, "SHORT": days[500:560], "GAPS": days[(np.arange(900) < 3) | (rng.random(900) < 0.35)]}
    frames = []
    for t, d in some.items():
        close = 50 * np.exp(np.cumsum(rng.normal(0, 0.01, len(d))))
        frames.append(pd.DataFrame({"ticker": t, "date": d.date, "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": rng.integers(1000, 9000, len(d))}))
    context = pd.DataFrame({"date": days.date} | {c: np.where(rng.random(900) < 0.4, np.nan, 20 * np.exp(np.cumsum(rng.normal(0, 0.01, 900)))) for c in X.CONTEXT_COLUMNS})
    context = spark.createDataFrame(context).select("date", *[F.nanvl(c, F.lit(None)).alias(c) for c in X.CONTEXT_COLUMNS])
    return spark.createDataFrame(pd.concat(frames)), context


@pytest.mark.parametrize("days", [40, 365])
def test_features_in_blocks(panel, days):
    bars, context = panel
    keys = ["ticker", "date"]
    want = X.feature_table(bars, context).toPandas().sort_values(keys).reset_index(drop=True)
    got = X.feature_table_in_blocks(bars, context, days).toPandas().sort_values(keys).reset_index(drop=True)
    assert len(want) > 900 and set(want.ticker) == {"LONG", "GAPS"}
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-12)


def test_labels_and_sequences_in_blocks(panel):
    bars, _ = panel
    for days in (15, 400):
        assert sorted(map(tuple, L.triple_barrier_in_blocks(bars, days).select("ticker", "date", "label").collect()), key=str) == sorted(map(tuple, L.triple_barrier(bars).select("ticker", "date", "label").collect()), key=str)
        want, got = sequences(bars, ["close", "volume"], 60), B.sequences_in_blocks(bars, ["close", "volume"], 60, days)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_a_long_series_is_many_tasks(spark, panel):
    """No task of the block's exchange has much more than a block and its halo, and no window is over the ticker alone."""
    bars, context = panel
    rows = B.in_blocks(bars.where("ticker = 'LONG'"), 60, back=20, ahead=5)
    sizes = [r["count"] for r in rows.groupBy("ticker", "_block").count().collect()]
    assert len(sizes) > 15 and max(sizes) <= 44 + 25
    plan = X.feature_table_in_blocks(bars, context, 60)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(ticker#\d+, (\S+?)#", plan)
    assert dealt and set(dealt) == {"_block"}
    assert B.in_blocks(bars.limit(0), 60, 5, 5).count() == 0


def test_halo_spans_sparse_blocks(spark):
    """Blocks with fewer rows than the halo: rows come from as many blocks as it takes."""
    df = spark.createDataFrame([("a", i * 30) for i in range(12)], "ticker string, n int").select("ticker", "n", F.date_add(F.lit("2020-01-01").cast("date"), F.col("n")).alias("date"))
    rows = B.in_blocks(df, 60, back=5, ahead=3).collect()
    own = sorted(r.n for r in rows if r._own)
    assert own == [i * 30 for i in range(12)]
    for block in {r._block for r in rows}:
        mine = sorted(r.n for r in rows if r._block == block and r._own)
        assert sorted(r.n for r in rows if r._block == block) == [n for n in own if mine[0] - 150 <= n <= mine[-1] + 90]
