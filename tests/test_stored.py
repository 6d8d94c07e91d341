import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from tidemark.functions.windows import series
from tidemark.operators import stored as T
from tidemark.plans import features as X
from tidemark.sources import filings as I
from tidemark.streaming.windows import count_windows, windowed

SCHEMA = "k int, x string, part int"


def batch(spark, rows):
    return spark.createDataFrame([(k, x, None if k is None else k % 3) for k, x in rows], SCHEMA)


def content(spark, path):
    return sorted((r.k, r.x) for r in T.read_table(spark, path, SCHEMA).collect())


def test_runs_replace_and_append(spark, tmp_path):
    path, order = str(tmp_path), [F.col("x")]
    assert T.write_run(spark, path, batch(spark, [(1, "a"), (2, "b"), (3, "c"), (3, "b")]), ["k"], order, "part", "r1")
    assert content(spark, path) == [(1, "a"), (2, "b"), (3, "b")]
    assert T.write_run(spark, path, batch(spark, [(1, "new"), (4, "d")]), ["k"], order, "part", "r2")
    assert T.write_run(spark, path, batch(spark, [(1, "later"), (7, "e"), (None, "z")]), ["k"], order, "part", "r3", "append")
    assert content(spark, path) == [(1, "new"), (2, "b"), (3, "b"), (4, "d"), (7, "e")]
    assert not T.write_run(spark, path, batch(spark, [(1, "again")]), ["k"], order, "part", "r2")
    assert content(spark, path)[0] == (1, "new")
    assert sorted((r.run_id, r.rows_held) for r in T.read_log(spark, path).collect()) == [("r1", 3), ("r2", 2), ("r3", 3)]  # r2 and r3 touch one partition
    assert not (tmp_path / "stage" / "r3").exists()
    assert T.write_run(spark, path, batch(spark, [(None, "z")]), ["k"], order, "part", "r4") and T.write_run(spark, path, batch(spark, [(None, "y")]), ["k"], order, "part", "r5")
    assert T.read_table(spark, path, SCHEMA).where("k is null").count() == 2  # of null keys none replaces another
    with pytest.raises(ValueError):
        T.write_run(spark, path, batch(spark, []), ["k"], order, "part", "../r4")


@pytest.mark.parametrize("killed", ["swap", "log_run", "_remove", "half"])
def test_a_killed_run_is_finished_by_calling_it_again(spark, tmp_path, monkeypatch, killed):
    def die(*_):
        raise KeyboardInterrupt

    def half(spark, path, schema, by, run_id):
        staged = spark.read.schema(schema).parquet(f"{path}/stage/{run_id}").where(f"{by} = 1")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{path}/data")
        die()

    path, order = str(tmp_path), [F.col("x")]
    T.write_run(spark, path, batch(spark, [(k, "old") for k in range(9)]), ["k"], order, "part", "r1")
    with monkeypatch.context() as m:
        m.setattr(T, "swap" if killed == "half" else killed, half if killed == "half" else die)
        with pytest.raises(KeyboardInterrupt):
            T.write_run(spark, path, batch(spark, [(1, "new"), (2, "new")]), ["k"], order, "part", "r2")
    T.write_run(spark, path, batch(spark, [(1, "new"), (2, "new")]), ["k"], order, "part", "r2")
    assert content(spark, path) == [(k, "new" if k in (1, 2) else "old") for k in range(9)]
    assert T.read_log(spark, path).count() == 2


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path)
    T.write_run(spark, path, batch(spark, [(k, "old") for k in range(9)]), ["k"], [F.col("x")], "part", "r1")
    files = lambda p: sorted(f.name for f in (tmp_path / "data" / f"part={p}").glob("*.parquet"))
    before = [files(p) for p in range(3)]
    T.write_run(spark, path, batch(spark, [(4, "new")]), ["k"], [F.col("x")], "part", "r2")
    assert [files(p) == before[p] for p in range(3)] == [True, False, True]


def test_bucketed_prices_need_no_exchange(spark, tmp_path):
    bars = spark.createDataFrame([(f"T{i % 7}", d, 1.0, 2.0, 0.5, 1.0 + d % 5, 10) for i in range(7) for d in range(40)], "ticker string, d int, open double, high double, low double, close double, volume long")
    bars = bars.select("ticker", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("date"), "open", "high", "low", "close", "volume")
    stored = T.write_bucketed(bars, "prices_of_test", str(tmp_path / "prices"), 4)
    context = bars.select("date").distinct().select("date", *[F.lit(1.0).alias(c) for c in X.CONTEXT_COLUMNS])
    plan = X.feature_table(stored, context, dealt=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(ticker" not in plan
    assert X.feature_table(bars, context)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(ticker") == 1
    one = stored.where("ticker = 'T3'").withColumn("p", F.lag("close").over(series()))
    assert "SelectedBucketsCount: 1 out of 4" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 40


def test_quarantine_in_one_parse(spark):
    good = "<ownershipDocument><nonDerivativeTable><nonDerivativeTransaction><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>5</value></transactionShares></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    texts = {"good": good, "half": good[:150], "none": None, "empty": "", "text": "Not found", "bare": "<ownershipDocument></ownershipDocument>"}
    df = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "accession string, xml string, rejected int")
    counts = Observation("filings")
    out = I.checked_filings(df, ["accession"], counts=counts)
    rows = {r.accession: r for r in out.collect()}
    assert {k for k, r in rows.items() if r.rejected} == {"half", "none", "empty", "text"} and rows["half"].xml == good[:150] and rows["good"].xml is None
    assert [tuple(t) for t in rows["good"].transactions] == [("P", None, 5.0, 0.0)] and rows["bare"].transactions == rows["half"].transactions == []
    assert counts.get == {"filings": 6, "rejected": 4}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") <= 1


EVENTS = "event_id long, ts timestamp, kind string"


def test_stream_windows_by_rule(spark, tmp_path):
    """Repeated deliveries count once, late rows go, and a window comes out once the watermark has passed it; every step is a new start."""
    def land(rows):
        df = spark.createDataFrame([(i, t, "k") for i, t in rows], "event_id long, t string, kind string").select("event_id", F.to_timestamp("t").alias("ts"), "kind")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/landing")
        count_windows(spark, f"{tmp_path}/landing", f"{tmp_path}/target", f"{tmp_path}/offsets", EVENTS, "ts", ["event_id"], ["kind"], {"n": F.count("*")}, "1 hour", "2 hours")
        return sorted((r.start.hour, r.n) for r in spark.read.schema("start timestamp, kind string, n long").parquet(f"{tmp_path}/target").collect())

    day = "2024-05-01 "
    assert land([(1, day + "01:10:00"), (2, day + "01:20:00"), (2, day + "01:20:00"), (3, day + "02:30:00")]) == []
    assert land([(2, day + "01:20:00"), (4, day + "01:50:00"), (5, day + "04:10:00")]) == [(1, 3)]  # 2 is repeated, 4 is out of order but in time
    assert land([(6, day + "01:55:00"), (3, day + "02:30:00"), (7, day + "05:30:00")]) == [(1, 3), (2, 1)]  # 6 is late
    table = spark.createDataFrame([(1, day + "01:10:00"), (1, day + "01:10:00")], "event_id long, t string").select("event_id", F.to_timestamp("t").alias("ts"), F.lit("k").alias("kind"))
    assert [r.n for r in windowed(table, "ts", ["event_id"], ["kind"], "1 hour", "2 hours", {"n": F.count("*")}).collect()] == [1]
