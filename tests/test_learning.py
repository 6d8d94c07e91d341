import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from tidemark.operators import evaluate as E
from tidemark.operators import folds as V
from tidemark.operators import learn as M
from tidemark.operators import ranges as R
from tidemark.plans import labels as L


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    days = pd.date_range("2012-01-01", "2016-12-31", freq="4D").date
    rows = [(d, t, int(x > 0), float(x + rng.normal(0, 0.3)), float(rng.normal())) for t in ("A", "B", "C") for d, x in zip(days, rng.normal(size=len(days)), strict=True)]
    return spark.createDataFrame(rows, "date date, ticker string, label int, x double, z double")


def test_fold_statistics_equal_those_of_assigned_rows(spark, panel):
    folds = L.folds_table(spark, [*L.yearly_folds(2012, 2014), ("2013-06-30", "2013-07-01", "2013-07-05"), ("1990-12-31", "1991-04-01", "1992-03-31")])
    odd = panel.unionByName(panel.limit(3).withColumns({"date": F.lit(None).cast("date")}))
    rows = L.assigned(odd, folds)
    want = rows.groupBy("fold", "role").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"), *[f(c).alias(f"{c}_{f.__name__}") for c in ("x", "z") for f in (F.min, F.max)])
    got = V.fold_stats(odd, folds, ["x", "z"])
    assert sorted(got.select(*want.columns).collect()) == sorted(want.collect()) and got.count() >= 7
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    assert sorted(L.tested(odd, folds).select("fold", "date", "x").collect()) == sorted(rows.where("role = 'test'").select("fold", "date", "x").collect())
    scored = L.tested(panel, folds).withColumn("p", F.col("x"))
    metrics = {r.fold: r for r in V.fold_metrics(panel, folds, scored).collect()}
    for fold in (1, 2, 3):
        own = [r for r in want.collect() if r.fold == fold]
        assert {(metrics[fold].train_rows, metrics[fold].test_rows)} == {tuple(next(r.n for r in own if r.role == role) for role in ("train", "test"))}
    assert V.fold_stats(panel.limit(0), folds, ["x"]).count() == 0


def test_fold_days_stay_before_the_cut(spark, panel):
    """A fold is a filter on the one written table, and its train rows are from before its purged cut."""
    folds = L.folds_table(spark, L.yearly_folds(2013, 2014))
    for f in M.fold_list(panel, folds):
        assert f.train(panel).agg(F.max("date")).first()[0] <= f.cut == datetime.date(2012 + f.fold, 12, 17)
        assert f.test(panel).agg(F.min("date")).first()[0] >= f.first > f.cut
        assert (f.n_pos, f.n_neg) == (f.train(panel).where("label = 1").count(), f.train(panel).where("label = 0").count())


def test_early_stopping_keeps_the_best_step():
    losses = [0.7, 0.5, 0.45, 0.44995, 0.46, 0.45, 0.1]
    fitted = M.fit_stopping(lambda m: (m or 0) + 1, lambda m: losses[m - 1], most=7)
    assert (fitted.model, fitted.best, fitted.losses) == (3, 3, losses[:6])  # 0.44995 gains too little, 0.1 would come too late
    fitted = M.fit_stopping(lambda m: (m or 0) + 1, lambda m: losses[m - 1], most=2)
    assert (fitted.model, fitted.best, len(fitted.losses)) == (2, 2, 2)


def vectors(spark, x, y):
    """Rows of sequences, a day each."""
    first = datetime.date(2010, 1, 1)
    rows = [(first + datetime.timedelta(days=i), "A", int(b), [float(v) for v in a.ravel()]) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "date date, ticker string, label int, v array<double>").repartition(2)
    return df.select("date", "ticker", "label", array_to_vector("v").alias("features"))


def auc_of(model, rows):
    return E.auc(M.probability(model, rows)).first()["auc"]


def test_network_separates_the_last_step(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 20, 8)).astype(np.float32)
    y = x[:, -1, 0] > 0
    fitted = M.fit_network(vectors(spark, x[:1500], y[:1500]), 1.0, 160, iterations=40)
    assert fitted.losses[fitted.best - 1] <= min(fitted.losses) + 1e-4
    assert auc_of(fitted.model, vectors(spark, x[1500:], y[1500:])) > 0.9


def test_network_beats_the_line_on_an_xor_of_steps(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 2, 2))
    y = (x[:, -1, 0] > 0) ^ (x[:, 0, 1] > 0)
    train, test = vectors(spark, x[:2400], y[:2400]), vectors(spark, x[2400:], y[2400:])
    line, net = M.fit_line(train, 1.0), M.fit_network(train, 1.0, 4, iterations=120, hidden=(8,))
    assert auc_of(line, test) < 0.6 < 0.9 < auc_of(net.model, test)


def test_balanced_repeats_the_rarer_class(spark):
    df = spark.range(40_000).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    n = {r.label: r["count"] for r in M.balanced(df, 3.0, "id").groupBy("label").count().collect()}
    assert n == {0: 30_000, 1: 30_000}
    n = {r.label: r["count"] for r in M.balanced(df, 1.5, "id").groupBy("label").count().collect()}
    assert n[0] == 30_000 and abs(n[1] - 15_000) < 300
    n = {r.label: r["count"] for r in M.balanced(df, 0.5, "id").groupBy("label").count().collect()}
    assert n == {0: 60_000, 1: 10_000}


def test_folds_stop_by_themselves(spark, panel):
    folds = L.folds_table(spark, L.yearly_folds(2013, 2014))
    windows, known, fitted = M.fitted_sequences(panel, folds, ["x", "z"], length=5, iterations=60, hidden=(4,))
    assert [f.fold for f in known] == [1, 2] and all(f.best <= len(f.losses) <= 12 for f in fitted)
    assert "Join" not in plan_of(known[1].train(windows))
    out = M.out_of_fold(windows, known, [f.model for f in fitted], lambda x, f: x.withColumn("features", M.scaled_sequence(f, ["x", "z"])))
    assert E.auc(out).first()["auc"] > 0.8


def test_trees_stop_on_later_days(spark, panel):
    folds = L.folds_table(spark, L.yearly_folds(2013, 2013))
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["x", "z"], outputCol="features").transform(panel)
    f = M.fold_list(rows, folds)[0]
    assert M.fit_trees(f.train(rows), f, 12).getNumTrees == 12
    assert M.fit_trees(f.train(rows), f, 60, validation=0.7).getNumTrees < 60


@pytest.mark.parametrize("spread", [1.0, 0.01])
def test_running_totals_and_quantiles(spark, spread):
    rng = np.random.default_rng(8)
    p = 0.5 + (np.round(rng.random(4000), 3) - 0.5) * spread
    df = pd.DataFrame({"g": rng.choice(["a", "b", None], 4000, p=[0.8, 0.15, 0.05]), "p": p, "label": rng.integers(0, 2, 4000)})
    rows = spark.createDataFrame(df)
    got = {r.g: r for r in R.quantiles(rows, "p", {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q99": 0.99}, ["g"]).collect()}
    for g in ("a", "b", None):
        own = df[df.g.isna()].p if g is None else df[df.g == g].p
        assert [got[g][k] for k in ("q0", "q1", "q5", "q99")] == pytest.approx(np.quantile(own, [0, 0.1, 0.5, 0.99]))
    aucs = {r.g: r.auc for r in E.auc(rows, by=["g"]).collect()}
    for g in ("a", "b"):
        own = df[df.g == g]
        n1, n0 = (own.label == 1).sum(), (own.label == 0).sum()
        assert aucs[g] == pytest.approx((own.p.rank()[own.label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))
    counts = rows.groupBy("g", F.col("p").alias("v")).agg(F.count("*").alias("n"))
    from tidemark.operators.scratch import written

    R.running(counts, ["g"], "v", "n").count()
    sizes = [r["count"] for r in spark.read.parquet(written()[-1]).groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)  # however close the values lie
    assert R.quantiles(rows.limit(0), "p", {"q": 0.5}).first()["q"] is None
