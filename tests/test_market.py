import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tidemark.functions.windows import sequences, series, top_per_day, with_ewm
from tidemark.operators import evaluate as E
from tidemark.operators import learn as M
from tidemark.operators import strategy as K
from tidemark.operators import writes as W
from tidemark.plans import features as X
from tidemark.plans import labels as L
from tidemark.sources import filings as I
from tidemark.sources import market as S
from tidemark.sources.schemas import SCORES


def series_of(n, level, period, seed):
    """Bars that swing around a slow trend, without weekends; nothing of them repeats exactly."""
    t = np.arange(n)
    noise = np.random.default_rng(seed).uniform(-0.004, 0.004, n)
    close = level * (1 + 0.0003 * t + 0.06 * np.sin(2 * np.pi * t / period) + noise)
    spread = 0.002 + 0.003 * np.abs(np.cos(t))
    return pd.DataFrame({"date": pd.bdate_range("2019-03-04", periods=n).date, "open": close * (1 - spread / 3), "high": close * (1 + spread), "low": close * (1 - spread), "close": close, "volume": 1000 + 37 * (t * t % 911)})


@pytest.fixture(scope="module")
def panel(spark):
    frames = {"KIL": series_of(380, 71.5, 47, 1), "WEM": series_of(245, 18.25, 33, 2)}
    bars = pd.concat([f.assign(ticker=t) for t, f in frames.items()])[["ticker", "date", "open", "high", "low", "close", "volume"]]
    kinds = {"spy": (310, 61, 3), "vix": (17, 19, 4), "hyg": (77, 83, 5), "tnx": (3.4, 101, 6)}
    context = pd.DataFrame({"date": frames["KIL"]["date"]} | {c: series_of(380, *x)["close"] for c, x in kinds.items()})
    return frames, spark.createDataFrame(bars), context, spark.createDataFrame(context)


def test_features_against_pandas(spark, panel):
    frames, bars, context, wide = panel
    got = X.feature_table(bars, wide).toPandas()
    assert not got.isna().any().any() and list(got.columns[7:]) == X.WIDE and len(X.WIDE) == len(set(X.WIDE)) == 30
    for ticker, f in frames.items():
        c, r = f["close"], f["close"].pct_change()
        spy_r = context["spy"].iloc[: len(f)].pct_change()
        mine = got[got.ticker == ticker].sort_values("date").reset_index(drop=True)
        assert len(mine) == len(f) - 99  # the longest warm-up is that of the 100-row mean
        m20, s20 = c.rolling(20).mean(), c.rolling(20).std()
        gain, loss = c.diff().clip(lower=0).rolling(14).mean(), (-c.diff()).clip(lower=0).rolling(14).mean()
        want = {
            "Daily_Return": r, "Mom_20": c.pct_change(20), "Vol_10": r.rolling(10).std(), "SMA_100_Dist": c / c.rolling(100).mean() - 1, "EMA_9_Dist": c / c.ewm(span=9, adjust=False).mean() - 1,
            "MACD_Norm": (c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()) / c, "ZScore_60": (c - c.rolling(60).mean()) / (c.rolling(60).std() + 1e-8), "RSI_14": 100 - 100 / (1 + gain / (loss + 1e-8)),
            "BB_Width": 4 * s20 / m20, "Beta_20": r.rolling(20).cov(spy_r) / (spy_r.rolling(20).var() + 1e-12), "TNX_Change": context["tnx"].iloc[: len(f)].diff(), "Vol_Surge": f["volume"] / f["volume"].rolling(20).mean(),
            "Market_Bullish": (context["spy"] > context["spy"].rolling(200).mean()).iloc[: len(f)].astype(int),
        }
        for name, x in want.items():
            assert np.allclose(mine[name], x.iloc[99:], rtol=1e-9, atol=1e-12), name


def test_no_look_ahead_and_one_exchange(panel):
    _, bars, _, wide = panel
    cut = pd.Timestamp("2019-12-02").date()
    whole = X.feature_table(bars, wide).where(F.col("date") <= F.lit(cut)).toPandas().sort_values(["ticker", "date"])
    past = X.feature_table(bars.where(F.col("date") <= F.lit(cut)), wide).toPandas().sort_values(["ticker", "date"])
    assert len(past) and np.allclose(whole[X.WIDE].astype(float), past[X.WIDE].astype(float))
    plan = X.feature_table(bars, wide)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(ticker") == 1 and "Python" not in plan
    with pytest.raises(ValueError, match="lacks"):
        X.market_context(bars, wide.drop("vix"))


def test_long_exponential_means(spark):
    x = np.random.default_rng(1).normal(100, 5, 5000)
    df = spark.createDataFrame(pd.DataFrame({"ticker": "A", "date": np.arange(5000), "close": x}))
    got = with_ewm(df, "close", {"e9": 9, "e26": 26}).orderBy("date").toPandas()
    for n in (9, 26):
        assert np.allclose(got[f"e{n}"], pd.Series(x).ewm(span=n, adjust=False).mean(), rtol=1e-13)


def test_labels(spark):
    """Every window of up and down steps against a plain reading of the rule."""
    rng = np.random.default_rng(8)
    close = np.round(40 * np.cumprod(1 + rng.choice([-0.016, -0.004, 0.002, 0.009, 0.021], 90)), 4)
    df = spark.createDataFrame([("KIL", i, float(c)) for i, c in enumerate(close)], "ticker string, date int, close double")
    for take, stop, hold in ((0.04, -0.02, 6), (0.012, -0.03, 4)):
        want = []
        for i, c in enumerate(close):
            moves = [x / c - 1 for x in close[i + 1 : i + 1 + hold]]
            touched = [m for m in moves if m >= take or m <= stop]
            want.append(None if len(moves) < hold else int(bool(touched) and touched[0] >= take))
        got = [r.label for r in L.triple_barrier(df, take, stop, hold).orderBy("date").collect()]
        assert got == want and {0, 1, None} == set(got)


def test_folds_purge_and_roles(spark):
    df = spark.createDataFrame([(f"{y}-{m:02d}-20",) for y in range(2012, 2017) for m in range(1, 13)], "d string").select(F.to_date("d").alias("date"))
    rows = L.assigned(df, L.folds_table(spark, L.yearly_folds(2013, 2014))).collect()
    assert max(str(r.date) for r in rows if r.fold == 1 and r.role == "train") == "2013-11-20"
    assert {str(r.date)[:7] for r in rows if r.fold == 1 and r.role == "test"} == {f"2014-{m:02d}" for m in range(4, 13)} | {f"2015-{m:02d}" for m in range(1, 4)}


def test_auc_counts_ties_by_half(spark):
    rng = np.random.default_rng(3)
    p, y = np.round(rng.random(500), 1), rng.integers(0, 2, 500)
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in p[y == 1] for b in p[y == 0]]
    df = spark.createDataFrame(pd.DataFrame({"p": p, "label": y, "g": 1}))
    for got in (E.auc(df), E.auc(df, by=["g"])):
        assert got.first()["auc"] == pytest.approx(np.mean(pairs), abs=1e-12)
    assert E.auc(df.where("label = 1")).first()["auc"] is None


def test_sweep_gate_blend_and_value(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(pd.DataFrame({"blend": rng.random(2000), "label": rng.integers(0, 2, 2000), "regime": "bull"}))
    rows = {(r.scope, r.top_pct): r for r in E.sweep(df).collect()}
    assert [rows["bull", p].trades for p in (100, 50, 25, 10, 5)] == [2000, 1000, 500, 200, 100]
    assert {s for s, _ in rows} == {"ALL", "bull"} and rows["ALL", 10].ev == pytest.approx(4 * rows["ALL", 10].win_rate - 1)
    out = spark.createDataFrame([(0.8, 0.9), (0.8, 0.7), (None, 0.9)], "a double, b double").select(E.agreement(F.col("a"), F.col("b")).alias("g"), E.blend(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.g for r in out] == [1, 0, 0] and out[0].x == pytest.approx(0.85)


def test_scaling(spark):
    df = spark.createDataFrame([(1, "train", 1.0, 5.0), (1, "train", 3.0, 5.0), (1, "test", 5.0, 6.0)], "fold int, role string, a double, b double")
    got = {(r.role, r.a, r.b) for r in E.scaled(df, E.scaler_stats(df, ["a", "b"]), ["a", "b"]).collect()}
    assert got == {("train", 0.0, 0.0), ("train", 1.0, 0.0), ("test", 2.0, 1.0)}


def test_sequences_stay_inside_a_ticker(spark):
    df = spark.createDataFrame([(t, i, float(i)) for t, n in (("A", 120), ("B", 90), ("C", 10)) for i in range(n)], "ticker string, date int, x double")
    rows = sequences(df, ["x"], 10).collect()
    assert len(rows) == 111 + 81  # exactly as many rows as a window gives none
    assert all([x[0] for x in r.sequence] == [float(v) for v in range(r.date - 9, r.date + 1)] for r in rows)


def test_regimes(spark):
    context = spark.createDataFrame([(i, 100.0 + (10 if i % 2 else -10), 30.0 if i > 230 else 15.0 if i != 225 else None, None, None) for i in range(240)], "date int, spy double, vix double, hyg double, tnx double")
    got = {r.date: r.regime for r in L.regimes(context).collect()}
    assert got[198] == "warmup" and got[200] == "bear" and got[201] == got[225] == "bull" and got[235] == "sideways"


def test_strategy(spark):
    cfg = K.Config(k=2, risk=0.02, reward_risk=2.0, cost=0.05, capital=500.0)
    trades = spark.createDataFrame([(7, "KIL", 0.61, 1), (7, "WEM", 0.61, 0), (7, "ROD", 0.4, 1), (9, "ROD", 0.2, 0)], "date int, ticker string, blend double, label int")
    top = top_per_day(trades, "blend", cfg.k)
    assert sorted((r.date, r.ticker) for r in top.collect()) == [(7, "KIL"), (7, "WEM"), (9, "ROD")]  # ties by name
    third = 1 / 3
    assert K.edge(top, cfg).first()["ev"] == pytest.approx(2 * third - 2 * third - 0.05)
    curve = K.equity(K.realised(top, cfg), cfg).orderBy("period").collect()
    first, second = 0.02 * (2.0 - 1 - 2 * 0.05), 0.02 * (-1 - 0.05)
    assert [r.ret for r in curve] == pytest.approx([first, second])
    assert [r.equity for r in curve] == pytest.approx([500 * (1 + first), 500 * (1 + first) * (1 + second)]) and curve[1].drawdown == pytest.approx(-second)
    lost = K.equity(spark.createDataFrame([(0, 1, 0, 60), (0, 2, 9, 9)], "path int, period int, wins long, trades long"), cfg).orderBy("period").collect()
    assert [r.equity for r in lost] == [0.0, 0.0]  # a loss of more than everything


def test_report_reads_the_trades_once(spark):
    rng = np.random.default_rng(12)
    days = pd.date_range("2018-01-01", periods=300).date
    rows = [(d, f"T{i}", float(rng.random()), int(rng.random() < 0.4)) for d in days for i in range(7)]
    scored = spark.createDataFrame(rows, "date date, ticker string, blend double, label int")
    prices = spark.createDataFrame([(days[0], 10.0), (days[-1], 12.0)], "date date, close double")
    cfg = K.Config()
    trades = top_per_day(scored, "blend", cfg.k)
    got = K.report(scored, prices, str(days[0]), str(days[-1]), cfg)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window") <= 2 * 6  # one choice and one path; a plan's text names each node up to twice
    r = got.first().asDict()
    for part in (K.edge(trades, cfg), K.span(trades), K.path_stats(K.equity(K.realised(trades, cfg), cfg), cfg), K.growth(prices, str(days[0]), str(days[-1]))):
        for k, v in part.first().asDict().items():
            assert r[k] == (pytest.approx(v) if isinstance(v, float) else v), k


def test_resampled_paths(spark):
    days = spark.createDataFrame([(i, i % 4, 5) for i in range(50)], "period int, wins long, trades long")
    drawn = K.resampled(days, 30, 3).toPandas()
    assert len(drawn) == 30 * 50 and drawn.groupby("path").period.nunique().eq(50).all() and set(drawn.wins) == {0, 1, 2, 3}
    assert drawn.sort_values(["path", "period"]).equals(K.resampled(days.repartition(3), 30, 3).toPandas().sort_values(["path", "period"]).set_axis(drawn.sort_values(["path", "period"]).index))


def test_writes(spark):
    stored = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0)], "ticker string, date int, close double")
    batch = spark.createDataFrame([("A", 2, 9.0), ("A", 3, 3.0), ("A", 3, 4.0), (None, 4, 1.0)], "ticker string, date int, close double")
    rows = W.append_if_absent(stored, batch, ["ticker", "date"], [F.col("close")]).collect()
    assert sorted((r.date, r.close) for r in rows) == [(1, 1.0), (2, 2.0), (3, 3.0)]
    assert W.new_rows(stored, stored, ["ticker", "date"], [F.col("close")]).count() == 0
    rows = W.replace_rows(stored, batch.where("ticker is not null"), ["ticker", "date"], [F.desc("close")]).collect()
    assert sorted((r.date, r.close) for r in rows) == [(1, 1.0), (2, 9.0), (3, 4.0)]


def test_vendor_frames(spark):
    raw = spark.createDataFrame([("2024-01-02 23:30:00-05:00", 1.0, None), ("2024-01-03", float("nan"), 5), ("bad", 2.0, 6)], "`('DATE', '')` string, `('Close', 'X')` double, volume int")
    rows = S.normalise_prices(raw).collect()
    assert [(str(r.date), r.close, r.volume, r.open) for r in rows] == [("2024-01-02", 1.0, 0, None)]
    assert S.normalise_prices(raw.select("volume")).count() == 0
    twice = spark.createDataFrame([("2024-01-02", 1.0, 2.0, 3.0, 4)], "date string, a double, b double, c double, volume int").toDF("Date", "Close", "Close", "close", "volume")
    assert [r.close for r in S.normalise_prices(twice).collect()] == [3.0]  # the first of equal names, the last of other case
    assert [r.close for r in S.normalise_prices(twice.select("*").toDF("Date", "close", "Close", "Close", "volume")).collect()] == [2.0]


def test_filings(spark):
    t = lambda code, shares, price, ad: f"<nonDerivativeTransaction><transactionCoding>{code}</transactionCoding><transactionAmounts><transactionShares>{shares}</transactionShares><transactionPricePerShare><value>{price}</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>{ad}</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>"
    code = lambda c: f"<transactionCode>{c}</transactionCode>"
    xml = f"<ownershipDocument><nonDerivativeTable>{t(code('P'), '<value>1000</value>', '50.5', 'A')}{t(code('S'), ' 200 ', '60', 'D')}{t('', '1', '1', 'A')}</nonDerivativeTable></ownershipDocument>"
    df = spark.createDataFrame([("A", "2024-01-02", xml), ("A", "2024-01-02", None), ("B", "2024-01-03", "<ownershipDocument/>"), ("C", "2024-01-04", "<broken")], "ticker string, d string, xml string").withColumn("filing_date", F.to_date("d"))
    rows = I.form4_transactions(df, ["ticker"]).collect()
    assert {(r.code, r.ad, r.shares, r.price) for r in rows} == {("P", "A", 1000.0, 50.5), ("S", "D", 200.0, 60.0)}
    repeated = f"<ownershipDocument><nonDerivativeTable>{t(code('P') + code('S'), '<value>7</value><value>8</value>', '5', 'A')}</nonDerivativeTable></ownershipDocument>"
    again = I.form4_transactions(spark.createDataFrame([("A", repeated)], "ticker string, xml string"), ["ticker"]).collect()
    assert [r.code for r in again] == ["S"]  # the last of a repeated field
    flow = {r.ticker: r for r in I.daily_flow(df).collect()}
    assert (flow["A"].n_buys, flow["A"].sell_value, flow["B"].n_buys, flow["B"].buy_value) == (1, 12000.0, 0, 0.0)
    assert "C" in {r.ticker for r in I.malformed(df, ["ticker"]).collect()}
    got = spark.createDataFrame([("\n  ",), ("12.5",), (None,), ("x",)], "s string").select(I.lenient_double(F.col("s")).alias("v")).collect()
    assert [r.v for r in got] == [0.0, 12.5, 0.0, 0.0] and not math.isnan(got[0].v)


def test_cik_lookup(spark):
    payload = '{"0": {"cik_str": 5, "ticker": "KIL", "title": "a"}, "1": {"cik_str": 0, "ticker": "ROD", "title": "b"}, "2": {"cik_str": 9, "ticker": "KIL", "title": "c"}, "3": {"cik_str": 7, "ticker": "wem", "title": "d"}}'
    ciks = I.cik_map(spark.createDataFrame([(payload,)], "payload string"))
    assert {(r.ticker, r.cik) for r in ciks.collect()} == {("KIL", 9), ("ROD", 0), ("wem", 7)}
    got = I.cik_lookup(spark.createDataFrame([("KIL",), ("WEM",), ("ROD",), ("KIL",)], "ticker string"), ciks)
    assert {(r.ticker, r.cik, r.skipped) for r in got.collect()} == {("KIL", 9, False), ("WEM", None, True), ("ROD", None, True)}


def test_stream_compares_with_the_months_it_touches(spark, tmp_path):
    from tidemark.streaming.append import append_stream

    schema = "ticker string, date date, close double"
    row = lambda day, x: (pd.Timestamp(day).date(), x)
    first, second = [row("2020-01-30", 1.0), row("2020-02-03", 2.0)], [row("2020-02-03", 9.0), row("2020-02-04", 3.0), row("2019-12-31", 4.0)]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/target")
    for rows in (first, second, second):
        spark.createDataFrame([("KIL", *r) for r in rows], schema).write.mode("append").parquet(f"{tmp_path}/landing")
        append_stream(spark, f"{tmp_path}/landing", f"{tmp_path}/target", f"{tmp_path}/offsets", schema, ["ticker", "date"])
    got = spark.read.schema(f"{schema}, month string").parquet(f"{tmp_path}/target").collect()
    assert sorted((str(r.date), r.close, r.month) for r in got) == [("2019-12-31", 4.0, "2019-12"), ("2020-01-30", 1.0, "2020-01"), ("2020-02-03", 2.0, "2020-02"), ("2020-02-04", 3.0, "2020-02")]


def test_sweep_cuts_are_exact_quantiles(spark):
    rng = np.random.default_rng(6)
    blends = np.concatenate([rng.random(700), np.full(300, 0.5), rng.normal(0.5, 0.001, 400), [-0.2, 1.3]])
    df = pd.DataFrame({"blend": blends, "label": rng.integers(0, 2, len(blends)), "regime": rng.choice(["bull", "bear", "warmup"], len(blends))})
    got = {(r.scope, r.top_pct): r for r in E.sweep(spark.createDataFrame(df).repartition(5)).collect()}
    for scope, part in (("ALL", df), ("bull", df[df.regime == "bull"]), ("bear", df[df.regime == "bear"])):
        for p in (100, 50, 25, 10, 5):
            own = part[part.blend >= np.quantile(part.blend, 1 - p / 100)]
            assert got[scope, p].trades == len(own) and got[scope, p].win_rate == pytest.approx(own.label.mean())
    assert len(got) == 15


def test_score_files_and_universe(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-02", "AAPL", 1, 3, 0.25), ("2024-01-03", "ZZZ", 0, 3, 0.5)], "d string, ticker string, label int, fold int, p double")
    df = df.select(F.to_date("d").alias("date"), "ticker", F.col("label").cast("byte").alias("label"), "fold", "p")
    for csv in (True, False):
        W.write_scores(df, f"{tmp_path}/{csv}", csv)
        assert sorted(W.read_scores(spark, f"{tmp_path}/{csv}", SCORES, csv).collect()) == sorted(df.collect())
    assert S.restricted(df, ["AAPL", "MSFT"]).count() == S.restricted(df, spark.createDataFrame([("AAPL",)], "ticker string")).count() == 1
    assert [r.close for r in S.stock(spark.createDataFrame([("A", 2, 1.0, 1.0, 1.0, 7.0, 1), ("A", 1, 1.0, 1.0, 1.0, 6.0, 1), ("B", 1, 1.0, 1.0, 1.0, 5.0, 1)], "ticker string, date int, open double, high double, low double, close double, volume long"), "A").collect()] == [6.0, 7.0]


def test_models(spark):
    rng = np.random.default_rng(5)
    rows = [(d, t, int(x > 0), float(x + rng.normal(0, 0.3)), float(rng.normal())) for t in ("A", "B", "C") for d, x in zip(pd.date_range("2012-01-01", "2016-12-31", freq="7D").date, rng.normal(size=261), strict=True)]
    df = spark.createDataFrame(rows, "date date, ticker string, label int, x double, z double").withColumn("label", F.col("label").cast("byte"))
    folds = L.folds_table(spark, L.yearly_folds(2013, 2014) + [("1990-12-31", "1991-04-01", "1992-03-31")])
    trees = M.walk_forward_trees(df, folds, ["x", "z"], rounds=5)
    lines = M.walk_forward_sequences(df, folds, ["x", "z"], length=5, iterations=20)
    for got in (trees, lines):
        out = got.toPandas()
        assert set(out.fold) == {1, 2} and out.p.between(0, 1).all()
        assert (out[out.fold == 1].date.min(), out[out.fold == 1].date.max()) >= (pd.Timestamp("2014-04-01").date(), pd.Timestamp("2015-03-01").date())
        assert E.auc(got).first()["auc"] > 0.8
    both = trees.withColumnRenamed("p", "p1").join(lines.select("date", "ticker", F.col("p").alias("p2")), ["date", "ticker"])
    report = M.ensemble_report(M.stacked(both, 1)).first()
    assert report.auc_stack > 0.8 and report.best_single == max(report.auc_c1, report.auc_c2)


def test_learning_queries_do_the_whole_job(spark, monkeypatch):
    """All four folds of the other fold queries, and the operators' own rounds and iterations."""
    import inspect

    from tidemark.plans import catalog as C

    given = {}
    monkeypatch.setattr(C, "pool", lambda spark, d: None)
    for name in ("walk_forward_trees", "walk_forward_sequences"):
        real = getattr(M, name)
        monkeypatch.setattr(M, name, lambda *a, name=name, real=real, **k: given.update({name: inspect.signature(real).bind(*a, **k).arguments}))
    C.QUERIES["walk_forward_trees"](spark, "")
    C.QUERIES["walk_forward_sequence"](spark, "")
    for args, size, least in ((given["walk_forward_trees"], "rounds", 300), (given["walk_forward_sequences"], "iterations", 50)):
        assert args.get(size, least) >= least
        assert sorted(args["folds"].collect()) == sorted(C.test_folds(spark).collect()) and args["folds"].count() == 4


def test_cik_payloads_stay_small(spark, tmp_path, monkeypatch):
    """More customers make more payloads, not longer ones; the later entry of a ticker still counts."""
    from tidemark.plans import catalog as C

    n, seen, real = 45_000, {}, I.cik_map
    spark.range(n).select(F.col("id").alias("c_custkey"), F.concat(F.lit("n"), "id").alias("c_name")).write.parquet(f"{tmp_path}/customer.parquet")
    monkeypatch.setattr(C.I, "cik_map", lambda df: real(seen.setdefault("df", df)))
    out = C.cik_map(spark, str(tmp_path))
    sizes = [r[0] for r in seen["df"].select(F.size(F.json_object_keys("payload"))).collect()]
    assert len(sizes) == 45 and max(sizes) == 2000
    assert out.count() == n and out.where("cast(cik as bigint) <> cast(substring(ticker, 2) as bigint) * 7 + 1").count() == 0
