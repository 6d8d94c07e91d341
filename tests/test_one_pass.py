"""Queries over filings and bars work their input up once: steps whose cost grows with the input are not repeated."""

import random

from pyspark.sql import functions as F
from tidemark.operators import stored as T
from tidemark.plans import catalog
from tidemark.sources import adapters as A
from tidemark.sources import filings as I

DATA = "/root/testdata/sf0.001"


def counted(spark, monkeypatch, name):
    """How many rows come out of the adapter over all jobs of a query, in multiples of the rows there are."""
    seen, made = spark.sparkContext.accumulator(0), getattr(A, name)

    def tally(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = made(spark, DATA).count()
    monkeypatch.setattr(A, name, lambda s, d: (df := made(s, d)).mapInArrow(tally, df.schema))
    return lambda: seen.value / rows


def test_replace_upsert_parses_each_filing_once(spark, monkeypatch):
    times = counted(spark, monkeypatch, "filings")
    assert catalog.QUERIES["replace_upsert"](spark, DATA).count() > 0 and times() == 1


def test_stored_upsert_parses_each_filing_once(spark, monkeypatch):
    times = counted(spark, monkeypatch, "filings")
    assert catalog.QUERIES["stored_upsert"](spark, DATA).count() > 0 and times() == 1


def test_a_run_computes_its_batch_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def tally(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    batch = spark.createDataFrame([(k, "a", k % 3) for k in range(9)], "k int, x string, part int").mapInArrow(tally, "k int, x string, part int")
    before = T.written()
    T.write_run(spark, str(tmp_path), batch, ["k"], [F.col("x")], "part", "r1")
    assert seen.value == 9 and T.written() == before
    assert T.read_table(spark, str(tmp_path), "k int, x string, part int").count() == 9


def test_calibrated_scores_make_their_bars_once(spark, monkeypatch):
    times = counted(spark, monkeypatch, "bars")
    assert catalog.QUERIES["calibrated_scores"](spark, DATA).count() > 0 and times() == 1


def test_insider_totals_take_one_pass(spark, monkeypatch):
    times = counted(spark, monkeypatch, "filings")
    assert catalog.QUERIES["insider_totals"](spark, DATA).count() > 0 and times() == 1


def _filing(*leaves):
    t = "".join(f"<nonDerivativeTransaction><transactionCoding>{c}</transactionCoding><transactionAmounts>{a}</transactionAmounts></nonDerivativeTransaction>" for c, a in leaves)
    return f"<ownershipDocument><nonDerivativeTable>{t}</nonDerivativeTable></ownershipDocument>"


def test_totals_in_one_pass_are_those_of_the_flow(spark):
    """Filings without a transaction, a code, a day, a ticker or a document count as before."""
    code = lambda c: f"<transactionCode>{c}</transactionCode>"
    texts = [_filing(), _filing((code("P"), ""), (code("S"), ""), (code("P"), "")), _filing(("", ""), (code(" "), "")), None, "<broken", _filing((code("M"), ""))]
    r = random.Random(3)
    rows = [(r.choice(["A", "B", "C", None]), r.choice(["2024-01-02", "2024-01-03", None]), r.choice(texts)) for _ in range(60)] + [("D", "2024-01-02", None)]
    df = spark.createDataFrame(rows, "ticker string, d string, xml string").select("ticker", F.col("d").cast("date").alias("filing_date"), "xml")
    shown = lambda x: sorted(map(str, x.select("ticker", "n_filings", "n_days", "n_buys").collect()))
    assert shown(I.filing_totals(df)) == shown(I.flow_totals(df, I.daily_flow(df)))


def test_fields_of_odd_documents(spark):
    """A field is one struct: of repeated ones the last counts, wherever its text stands. Entries are taken apart after the explode, and flow leaves out what it doesn't need."""
    shares = lambda *x: "".join(f"<transactionShares>{y}</transactionShares>" for y in x)
    cases = {
        "child": (shares("<value>5</value>"), 5.0), "own": (shares(" 5\n"), 5.0), "case": (shares("<VALUE>5</VALUE>"), 5.0), "last": (shares("5", "<value>6</value>"), 6.0), "last_blank": (shares("5", ""), 0.0),
        "mixed": (shares("7<value>5</value>"), 5.0), "twice": (shares("<value>5</value><value>6</value>"), 6.0), "note": (shares("<footnoteId id='F1'/><value>5</value>"), 5.0), "cdata": (shares("<![CDATA[5]]>"), 5.0), "none": ("", 0.0),
    }
    df = spark.createDataFrame([(k, _filing(("<transactionCode>X</transactionCode><transactionCode>P</transactionCode>", a + "<transactionPricePerShare>2</transactionPricePerShare>"), ("", a))) for k, (a, _) in cases.items()], "ticker string, xml string")
    df = df.withColumn("filing_date", F.lit("2024-01-02").cast("date"))
    want = {k: x for k, (_, x) in cases.items()}
    found = I.form4_transactions(df, ["ticker"])
    assert {r.ticker: r.shares for r in found.collect()} == want and found.where("code = 'P' and price = 2").count() == len(cases)
    assert {r.ticker: r.shares for r in I.form4_transactions(df, ["ticker"], outer=True).collect()} == want
    assert {r.ticker: r.transactions[0].shares for r in I.checked_filings(df, ["ticker"]).collect()} == want
    assert {r.ticker: (r.n_buys, r.buy_value) for r in I.daily_flow(df).collect()} == {k: (1, 2 * x) for k, x in want.items()}
    assert "transform(" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert "AcquiredDisposed" not in I.daily_flow(df)._jdf.queryExecution().optimizedPlan().toString()


def test_plain_filings_are_read_with_the_cheap_schema(spark):
    """Others with the full one; both give the same rows, and attributes are no text."""
    code, amount = lambda c: f"<transactionCode>{c}</transactionCode>", lambda x, a="": f"<transactionShares{a}>{x}</transactionShares>"
    plain = {"value": "<value> 5\n</value>", "own": "5", "amp": "<value>A &amp; B</value>", "blank": "", "empty": "<value/>", "gt": "<value>5 > 4</value>"}
    odd = {
        "mixed": "7<value>5</value>", "note": "<value>5</value><footnoteId id='F1'/>", "twice": "<value>5</value><value>6</value>", "case": "<VALUE>5</VALUE>", "lt": "&lt;value>5&lt;/value>", "char": "&#60;value>5&#x3c;/value>",
        "cdata": "<![CDATA[<value>5</value>]]>", "deep": "<value><b>5</b></value>", "attr": "<value x='1'>5</value>", "comment": "5<!-- x -->6", "step": "5<?x y?>6", "bare": "A & B", "open": "<value>5",
    }
    docs = {k: _filing((code("P"), amount(x)), (code(x), amount("1"))) for k, x in (plain | odd).items()}
    docs |= {"text": docs["own"].replace("<transactionCoding>", "x<transactionCoding>", 1), "group": docs["own"].replace("transactionAmounts", "TransactionAmounts"), "none": _filing((code("P"), "")).replace("<transactionAmounts></transactionAmounts>", "")}
    docs["named"] = _filing((code("P"), amount("5", " VALUE='9'")))
    df = spark.createDataFrame(list(docs.items()), "ticker string, xml string").withColumn("filing_date", F.lit("2024-01-02").cast("date"))
    parsed = I._parsed(df, ["ticker"], "xml", I.schemas.FORM4_FIELDS)
    assert {r.ticker for r in parsed.where("_plain is not null").collect()} == {*plain, "named"}
    assert {r.ticker for r in parsed.where("_full is not null").collect()} == {*odd, "text", "group", "none"} - {"bare", "open"}
    shown = lambda x: sorted(map(str, x.collect()))
    found = I.form4_transactions(df, ["ticker"])
    assert shown(found) == shown(I.form4_transactions(df, ["ticker"], outer=True).where("code is not null"))
    assert found.where("ticker = 'named'").first().shares == 5.0
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 2
