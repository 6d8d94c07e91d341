"""The queries of the market engine, each with its SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.blocks import sequences_in_blocks
from tidemark.functions.windows import sequences, top_per_day
from tidemark.operators import evaluate as E
from tidemark.operators import folds as V
from tidemark.operators import learn as M
from tidemark.operators import stored as T
from tidemark.operators import strategy as K
from tidemark.operators import writes as W
from tidemark.operators.scratch import materialise, new_path
from tidemark.plans import features as X
from tidemark.plans import labels as L
from tidemark.sources import adapters as A
from tidemark.sources import filings as I
from tidemark.sources import market as S
from tidemark.sources.schemas import SCORES
from tidemark.streaming.append import append_stream
from tidemark.streaming.windows import count_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Tables that the SQL of most queries builds on.
BARS = """px AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, round(100 + 60 * (l_discount + 0.0 - 0.05), 6) AS px, l_quantity,
  l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (SELECT ticker, date, (min({'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'px': px})).px AS open, max(px) AS high, min(px) AS low,
  round(avg(px), 8) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume FROM px GROUP BY ticker, date)"""
CONTEXT = """wide AS (SELECT CAST(l_shipdate AS DATE) AS date, round(avg(round(100 + 60 * (l_discount + 0.0 - 0.05), 6)), 8) AS spy,
  round(10 + 200 * avg(l_discount + 0.0), 8) AS vix, round(avg(round(100 + 60 * (l_discount + 0.0 - 0.05), 6)) FILTER (l_returnflag = 'R'), 8) AS hyg,
  round(100 * avg(l_tax), 8) AS tnx FROM lineitem GROUP BY 1)"""
STOCKS = """stocks AS (SELECT p_brand AS ticker, p_brand AS company_name, min(p_type) AS sector, CASE WHEN right(p_brand, 1) = '5' THEN 'watch' ELSE 'sp500' END AS source,
  false AS ml_ready, DATE '1995-01-02' AS first_seen, DATE '1995-01-02' AS last_updated FROM part GROUP BY p_brand)"""
FILINGS = """filings AS (SELECT 'C' || o_custkey AS ticker, CAST(o_orderdate AS DATE) AS filing_date, lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS accession,
  CASE o_orderstatus WHEN 'F' THEN '4' WHEN 'O' THEN '4/A' ELSE '10-K' END AS form, o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
flow AS (SELECT ticker, filing_date AS date, CAST(count(*) FILTER (l_returnflag = 'A') AS INTEGER) AS n_buys, CAST(count(*) FILTER (l_returnflag = 'R') AS INTEGER) AS n_sells,
  coalesce(sum(l_quantity * l_extendedprice) FILTER (l_returnflag = 'A'), 0) AS buy_value, coalesce(sum(l_quantity * l_extendedprice) FILTER (l_returnflag = 'R'), 0) AS sell_value
  FROM filings JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def _roll(agg: str, x: str, n: int, present: str | None = None) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({present or x}) {w} = {n} THEN {agg}({x}) {w} END"


def _ewm(span: int) -> str:
    q, alpha = f"(1 - 2 / {span + 1}.0::DOUBLE)", f"(2 / {span + 1}.0::DOUBLE)"
    return f"pow({q}, idx) * sum((CASE WHEN idx = 0 THEN 1 ELSE {alpha} END) * close * pow({q}, -idx)) OVER t"


OWN = (
    BARS
    + f""",
l1 AS (SELECT *, (row_number() OVER t - 1)::DOUBLE AS idx, lag(close) OVER t AS pc FROM bars WINDOW t AS (PARTITION BY ticker ORDER BY date)),
l2 AS (SELECT *, close / nullif(pc, 0) - 1 AS "Daily_Return", close - pc AS d, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr, (high + low + close) / 3 * volume AS tv, volume::DOUBLE AS vol,
  {_ewm(9)} AS e9, {_ewm(12)} AS e12, {_ewm(26)} AS e26, {", ".join(f'close / nullif(lag(close, {n}) OVER t, 0) - 1 AS "Mom_{n}"' for n in (5, 10, 20))},
  {", ".join(f"{_roll('avg', 'close', n)} AS m{n}" for n in (5, 10, 20, 50, 60, 100))}, {", ".join(f"{_roll('stddev_samp', 'close', n)} AS s{n}" for n in (20, 60))}
  FROM l1 WINDOW t AS (PARTITION BY ticker ORDER BY date)),
l3 AS (SELECT *, {", ".join(f'{_roll("stddev_samp", chr(34) + "Daily_Return" + chr(34), n)} AS "Vol_{n}"' for n in (5, 10, 20))},
  {", ".join(f'(close - m{n}) / nullif(m{n}, 0) AS "SMA_{n}_Dist"' for n in (5, 10, 20, 50, 100))},
  close / nullif(e9, 0) - 1 AS "EMA_9_Dist", (e12 - e26) / nullif(close, 0) AS "MACD_Norm", {", ".join(f'(close - m{n}) / (s{n} + 1e-8) AS "ZScore_{n}"' for n in (20, 60))},
  100 - 100 / (1 + {_roll("avg", "CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", 14)} / ({_roll("avg", "CASE WHEN d IS NOT NULL THEN -least(d, 0) END", 14)} + 1e-8)) AS "RSI_14",
  ((m20 + 2 * s20) - (m20 - 2 * s20)) / nullif(m20, 0) AS "BB_Width", (close - (m20 - 2 * s20)) / ((m20 + 2 * s20) - (m20 - 2 * s20) + 1e-8) AS "Boll_Pos",
  {_roll("avg", "tr", 14)} / nullif(close, 0) * 100 AS "NATR_14", vol / nullif({_roll("avg", "vol", 20)}, 0) AS "Vol_Surge",
  close / nullif({_roll("sum", "tv", 20)} / nullif({_roll("sum", "vol", 20)}, 0), 0) - 1 AS "VWAP_Dist"
  FROM l2)"""
)
FULL = (
    OWN
    + ", "
    + CONTEXT
    + f""",
c1 AS (SELECT l3.*, {", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY l3.date ROWS UNBOUNDED PRECEDING) AS {c}" for c in X.CONTEXT_COLUMNS)} FROM l3 LEFT JOIN wide USING (date)),
c2 AS (SELECT *, {", ".join(f'{c} / nullif(lag({c}) OVER t, 0) - 1 AS "{n}"' for c, n in (("spy", "SPY_Return"), ("vix", "VIX_Change"), ("hyg", "HYG_Return")))}, tnx - lag(tnx) OVER t AS "TNX_Change", vix AS "VIX_Level"
  FROM c1 WINDOW t AS (PARTITION BY ticker ORDER BY date)),
full_ AS (SELECT *, "Daily_Return" - "SPY_Return" AS "Relative_Strength", coalesce(CAST(spy > {_roll("avg", "spy", 200)} AS INTEGER), 0) AS "Market_Bullish",
  CASE WHEN count(CASE WHEN "SPY_Return" IS NOT NULL THEN "Daily_Return" END) OVER f = 20 THEN covar_samp("Daily_Return", "SPY_Return") OVER f END / ({_roll("var_samp", '"SPY_Return"', 20)} + 1e-12) AS "Beta_20"
  FROM c2 WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)),
feat AS (SELECT * FROM full_ WHERE """
    + " AND ".join(f'"{c}" IS NOT NULL' for c in X.WIDE)
    + """),
ahead AS (SELECT *, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS f FROM feat),
touched AS (SELECT *, list_filter(list_transform(f, lambda x: x / nullif(close, 0) - 1), lambda r: r <= -0.01 OR r >= 0.03)[1] AS r FROM ahead WHERE coalesce(len(f), 0) = 10),
pool AS (SELECT *, CAST(CASE WHEN r <= -0.01 THEN 0 WHEN r >= 0.03 THEN 1 ELSE 0 END AS TINYINT) AS label, round(1 / (1 + exp(-50 * "SMA_20_Dist")), 8) AS p1, round(1 / (1 + exp(-0.05 * ("RSI_14" - 50))), 8) AS p2 FROM touched),
folds AS (SELECT CAST(y - 1995 AS INTEGER) AS fold, make_date(y, 12, 31) AS train_end, make_date(y + 1, 4, 1) AS test_start, make_date(y + 2, 3, 31) AS test_end FROM range(1996, 2000) AS r(y)),
assigned AS (SELECT pool.*, fold, CASE WHEN date <= train_end - 14 THEN 'train' ELSE 'test' END AS role FROM pool JOIN folds ON date <= train_end - 14 OR date BETWEEN test_start AND test_end),
scores AS (SELECT date, ticker, label, fold, p1, p2, close FROM assigned WHERE role = 'test'),
reg0 AS (SELECT date, spy, last_value(vix IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS vix, CASE WHEN count(spy) OVER (ORDER BY date ROWS 199 PRECEDING) = 200 THEN avg(spy) OVER (ORDER BY date ROWS 199 PRECEDING) END AS m FROM wide WHERE spy IS NOT NULL),
regimes AS (SELECT date, CASE WHEN m IS NULL THEN 'warmup' WHEN spy < m THEN 'bear' WHEN vix <= 20 THEN 'bull' ELSE 'sideways' END AS regime FROM reg0),
blended AS (SELECT scores.*, 0.5 * p1 + 0.5 * p2 AS blend, regime FROM scores LEFT JOIN regimes USING (date)),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY blend DESC, ticker) AS rank FROM blended) WHERE rank <= 5)"""
)
CURVE = """curve0 AS (SELECT date, count(*) FILTER (label = 1) AS wins, count(*) AS trades FROM chosen GROUP BY date),
curve1 AS (SELECT *, (wins * 3.0 * 0.01 - (trades - wins) * 0.01 - trades * 0.001 * 0.01)::DOUBLE AS ret FROM curve0),
curve2 AS (SELECT *, 1000.0 * exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM curve1),
curve AS (SELECT *, greatest(max(equity) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 1000.0) AS peak FROM curve2)"""
CFG = K.Config()
SCORES_BASE = "date date, ticker string, label byte, fold int"


#: Columns that come out of the same few exact operations in any engine, so they are given as they are.
EXACT = {*X.RETURNS, "SPY_Return", "Relative_Strength", "VIX_Level", "VIX_Change", "HYG_Return", "TNX_Change", "close", "p1", "p2"}
#: Decimals of the others, which hold sums of floats: more for small numbers; 6 for those not named.
DIGITS = dict.fromkeys([*X.VOLATILITY, *X.DISTANCES, *X.EXPONENTIAL, "BB_Width", "VWAP_Dist"], 8)


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Doubles that are not exact to some decimals, as sums of floats differ in their last bits between engines."""
    return df.select(*[(F.round(f"`{c}`", digits or DIGITS.get(c, 6)) + 0.0).alias(c) if t == "double" and c not in EXACT else F.col(f"`{c}`") for c, t in df.dtypes])


def _r(*columns: str, digits: int | None = None) -> str:
    return ", ".join(f'"{c}"' if c in EXACT else f'round("{c}", {digits or DIGITS.get(c, 6)}) + 0.0 AS "{c}"' for c in columns)


def context(spark: SparkSession, d: str) -> DataFrame:
    return S.baselines_wide(A.baselines(spark, d))


def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    return X.feature_table(A.bars(spark, d), context(spark, d))


def pool(spark: SparkSession, d: str) -> DataFrame:
    """Labelled features with two scores that need no training."""
    p1 = F.round(1 / (1 + F.exp(-50 * F.col("SMA_20_Dist"))), 8)
    p2 = F.round(1 / (1 + F.exp(-0.05 * (F.col("RSI_14") - 50))), 8)
    return L.labelled(feature_rows(spark, d)).withColumns({"p1": p1, "p2": p2})


def test_folds(spark: SparkSession) -> DataFrame:
    return L.folds_table(spark, L.yearly_folds(1996, 1999))


def assigned(spark: SparkSession, d: str) -> DataFrame:
    return L.assigned(pool(spark, d), test_folds(spark))


def scores(spark: SparkSession, d: str) -> DataFrame:
    return L.tested(pool(spark, d), test_folds(spark)).select("date", "ticker", "label", "fold", "p1", "p2", "close")


def score_files(spark: SparkSession, d: str, name: str = "scores") -> tuple[DataFrame, DataFrame]:
    """The two models' score files, written once: every query on both reads these instead of computing features twice."""
    path = new_path(spark, name)
    W.write_scores(scores(spark, d), path)
    both = W.read_scores(spark, path, f"{SCORES_BASE}, p1 double, p2 double, close double")
    return both.drop("p2"), both.select("date", "ticker", "p2")


def metric_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pool, the folds, and the scores of the folds' test rows, from one table."""
    rows, folds = materialise(pool(spark, d).select("date", "ticker", "label", "p1"), "pool"), test_folds(spark)
    return rows, folds, L.tested(rows, folds)


def blended(spark: SparkSession, d: str) -> DataFrame:
    return E.blended(*score_files(spark, d), L.regimes(context(spark, d)))


def chosen(spark: SparkSession, d: str) -> DataFrame:
    return top_per_day(blended(spark, d), "blend", CFG.k)


# ---- sources -------------------------------------------------------------------------------------------------------


@query(f"WITH {BARS} SELECT * FROM bars")
def bars_daily(spark, d):
    return A.bars(spark, d)


@query(f"WITH {CONTEXT} SELECT * FROM wide")
def baseline_pivot(spark, d):
    return context(spark, d)


@query("SELECT replace(replace(p_brand, '#', '-'), '.', '-') AS ticker, trim(p_name) AS company_name, trim(p_type) AS sector, 'sp500' AS source FROM part")
def universe_normalise(spark, d):
    raw = A.read(spark, d, "part").select(F.replace("p_brand", F.lit("#"), F.lit(".")).alias("Symbol"), "p_name", "p_type")
    listed = S.normalise_universe(raw, "Symbol", "p_name", "p_type")
    path = new_path(spark, "tables")
    listed.write.option("header", True).csv(path)
    return S.read_universe(spark, path)


@query("SELECT CAST(o_orderkey AS BIGINT) AS key, CAST(o_orderdate AS DATE) AS date, NULL::DOUBLE AS open, o_totalprice AS high, NULL::DOUBLE AS low, o_totalprice / 2 AS close, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_custkey END AS volume FROM orders WHERE o_orderstatus <> 'P'")
def vendor_normalise(spark, d):
    o = A.read(spark, d, "orders")
    raw = o.select(
        F.col("o_orderkey").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ssXXX").alias("('Datetime', '')"), F.col("o_totalprice").alias("('High', 'XYZ')"), F.col("o_totalprice").alias("close"),
        F.when(F.col("o_orderstatus") == "P", float("nan")).otherwise(F.col("o_totalprice") / 2).alias("('Close', 'XYZ')"), F.col("o_totalprice").alias("Close"), F.when(F.col("o_orderstatus") != "O", F.col("o_custkey")).alias("volume"),
    )
    return S.normalise_prices(raw, "key")


@query("SELECT 'C' || c_custkey AS ticker, CAST(max(c_custkey * 7 + 1) AS BIGINT) AS cik FROM customer GROUP BY c_custkey")
def cik_map(spark, d):
    c = A.read(spark, d, "customer").withColumn("g", F.expr("c_custkey div 1000"))  # payloads stay small, their number grows; both entries of a ticker share one
    entry = lambda i: F.struct((F.col("c_custkey") * 2 + i).cast("string").alias("k"), F.struct((F.col("c_custkey") * 7 + i).alias("cik_str"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_name").alias("title")).alias("v"))
    entries = F.array_sort(F.flatten(F.collect_list(F.array(entry(0), entry(1)))), lambda a, b: F.when(a["v"]["cik_str"] < b["v"]["cik_str"], -1).when(a["v"]["cik_str"] > b["v"]["cik_str"], 1).otherwise(0))
    return I.cik_map(c.groupBy("g").agg(F.to_json(F.map_from_entries(entries)).alias("payload")))


@query("""WITH t AS (SELECT 'C' || o_custkey AS ticker FROM orders UNION SELECT 'S' || s_suppkey FROM supplier)
SELECT ticker, CAST(c_custkey * 7 + 1 AS BIGINT) AS cik, c_custkey IS NULL AS skipped FROM t LEFT JOIN (SELECT DISTINCT c_custkey FROM customer) ON ticker = 'C' || c_custkey""")
def cik_lookup(spark, d):
    """Customers with orders have an entry, suppliers none."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string")).alias("ticker")
    tickers = A.read(spark, d, "orders").select(name("C", "o_custkey")).union(A.read(spark, d, "supplier").select(name("S", "s_suppkey")))
    return I.cik_lookup(tickers, cik_map(spark, d))


def filing_payloads(spark, d):
    f = A.filings(spark, d)
    part = lambda c: F.transform("rows", lambda x: x[c])
    rows = f.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("accession", F.col("filing_date").cast("string").alias("day"), "form"))).alias("rows"))
    return rows.select("ticker", F.to_json(F.struct(F.struct(F.struct(part("form").alias("form"), part("day").alias("filingDate"), part("accession").alias("accessionNumber")).alias("recent")).alias("filings"))).alias("payload"))


@query(f"WITH {FILINGS} SELECT ticker, filing_date, accession FROM filings WHERE form = '4'")
def filings_json(spark, d):
    return I.form4_filings(filing_payloads(spark, d), "ticker")


@query(f"WITH {FILINGS} SELECT ticker, filing_date, accession FROM filings WHERE form = '4' ORDER BY filing_date DESC, accession LIMIT 40")
def latest_filings(spark, d):
    return I.latest(filings_json(spark, d), 40)


@query(f"WITH {FILINGS} SELECT accession, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'M' END AS code, CASE l_returnflag WHEN 'R' THEN 'D' ELSE 'A' END AS ad, l_quantity AS shares, l_extendedprice AS price FROM filings JOIN lineitem ON l_orderkey = o_orderkey")
def form4_xml(spark, d):
    return I.form4_transactions(A.filings(spark, d), ["accession"])


@query(f"WITH {FILINGS} SELECT accession, right(accession, 1) IN ('0', '5', '7') AS rejected, CASE WHEN right(accession, 1) IN ('0', '5', '7') THEN 0 ELSE count(*) END AS n, CASE WHEN right(accession, 1) IN ('0', '5', '7') THEN 0 ELSE sum(l_quantity) END AS shares FROM filings JOIN lineitem ON l_orderkey = o_orderkey GROUP BY accession")
def form4_quarantine(spark, d):
    """Some filings arrive cut in half, others are no XML: they are told apart from the good ones in one parse."""
    last, xml = F.right("accession", F.lit(1)), F.col("xml")
    broken = F.when(last.isin("0", "5"), F.substr(xml, F.lit(1), F.expr("cast(length(xml) div 2 as int)"))).when(last == "7", F.lit("Error 503 <")).otherwise(xml)
    out = I.checked_filings(A.filings(spark, d).withColumn("xml", broken), ["accession"])
    shares = F.aggregate("transactions", F.lit(0.0), lambda a, t: a + t["shares"])
    return out.select("accession", "rejected", F.size("transactions").cast("bigint").alias("n"), shares.alias("shares"))


@query("SELECT lpad(CAST(o_custkey AS VARCHAR), 6, '0') || '-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS accession, lpad(CAST(o_custkey AS VARCHAR), 6, '0') || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS folder, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority || '.xml' END AS document FROM orders")
def filing_index_xml(spark, d):
    o = A.read(spark, d, "orders")
    name = lambda x: F.struct(x.alias("name"))
    items = F.array(name(F.lit("index.htm")), name(F.when(F.col("o_orderstatus") != "P", F.concat("o_orderpriority", F.lit(".xml"))).otherwise("none.txt")), name(F.when(F.col("o_orderstatus") != "P", "later.xml").otherwise("x.pdf")))
    accession = F.concat_ws("-", F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    return I.primary_document(o.select(accession.alias("accession"), F.to_json(F.struct(F.struct(items.alias("item")).alias("directory"))).alias("payload")))


SPLIT, OVERLAP = "1999-01-01", "1998-12-20"


@query(f"WITH {BARS}, {STOCKS} SELECT ticker, coalesce(max(date), DATE '2010-01-01') AS last_date FROM stocks LEFT JOIN (SELECT * FROM bars WHERE date < DATE '{SPLIT}' AND ticker NOT LIKE '%1') USING (ticker) GROUP BY ticker")
def high_water(spark, d):
    stored = A.bars(spark, d).where(f"date < date'{SPLIT}' and ticker not like '%1'")
    return S.high_water(A.stocks(spark, d), stored)


@query(f"WITH {BARS} SELECT ticker, count(*) AS n, min(date) AS first_date FROM bars WHERE ticker IN ('Brand#11', 'Brand#23', 'Brand#55') GROUP BY ticker")
def dev_universe(spark, d):
    return S.restricted(A.bars(spark, d), ["Brand#11", "Brand#23", "Brand#55"]).groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first_date"))


# ---- writes --------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT l_orderkey AS key, l_linenumber AS line, l_quantity AS qty, l_extendedprice AS price, l_shipdate < TIMESTAMP '1999-01-01' AS old FROM lineitem),
stored AS (SELECT key, line, qty, price FROM (SELECT *, row_number() OVER (PARTITION BY key, line ORDER BY price, qty) AS r FROM b WHERE old) WHERE r = 1)
SELECT * FROM stored UNION ALL SELECT key, line, qty, price FROM (SELECT *, row_number() OVER (PARTITION BY key, line ORDER BY price, qty) AS r FROM b WHERE NOT old) x WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.key = x.key AND s.line = x.line)""")
def append_if_absent(spark, d):
    rows = A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), (F.col("l_shipdate") < "1999-01-01").alias("old"))
    order = [F.col("price"), F.col("qty")]
    stored = W.first_of(rows.where("old"), ["key", "line"], order).drop("old")
    return W.append_if_absent(stored, rows.where("not old").drop("old"), ["key", "line"], order)


@query(f"""WITH {STOCKS}, listed AS (SELECT 'Brand#' || p_size AS ticker, arg_max(p_name, p_partkey) AS company_name, arg_max(p_type, p_partkey) AS sector FROM part GROUP BY 1)
SELECT ticker, CASE WHEN l.ticker IS NULL THEN s.company_name ELSE l.company_name END AS company_name, CASE WHEN l.ticker IS NULL THEN s.sector ELSE l.sector END AS sector,
  CASE WHEN l.ticker IS NULL THEN s.source ELSE 'watch' END AS source, coalesce(ml_ready, false) AS ml_ready, CASE WHEN s.ticker IS NULL THEN DATE '2001-01-01' ELSE first_seen END AS first_seen,
  CASE WHEN ticker LIKE '%1' THEN DATE '2001-01-01' ELSE last_updated END AS last_updated FROM stocks s FULL JOIN listed l USING (ticker)""")
def upsert_universe(spark, d):
    today = F.lit("2001-01-01").cast("date")
    listed = A.read(spark, d, "part").select(F.concat(F.lit("Brand#"), F.col("p_size").cast("string")).alias("ticker"), F.col("p_name").alias("company_name"), F.col("p_type").alias("sector"), F.lit("watch").alias("source"), F.col("p_partkey").alias("position"))
    out = W.upsert_universe(A.stocks(spark, d), listed, today)
    return W.touch(out, out.where("ticker like '%1'"), today)


@query(f"WITH {STOCKS} SELECT count(*) FILTER (source = 'sp500') AS sp500, count(*) FILTER (source <> 'sp500') AS watchlist, count(*) AS total FROM stocks")
def source_counts(spark, d):
    return W.source_counts(A.stocks(spark, d))


@query(f"WITH {FILINGS} SELECT ticker, date, CASE WHEN date >= DATE '{SPLIT}' THEN n_buys + 1 ELSE n_buys END AS n_buys, n_sells, {_r('buy_value', 'sell_value', digits=2)} FROM flow")
def replace_upsert(spark, d):
    flow = materialise(I.daily_flow(A.filings(spark, d)), "flow")
    newer = flow.where(f"date >= date'{SPLIT}'").withColumn("n_buys", F.col("n_buys") + 1)
    return rounded(W.replace_rows(flow, newer, ["ticker", "date"], [F.desc("n_buys"), F.col("n_sells")]), 2)


@query(f"""WITH {BARS}, {STOCKS}, stored AS (SELECT * FROM bars WHERE date < DATE '{SPLIT}'), bad AS (SELECT DISTINCT ticker FROM bars WHERE date >= DATE '{OVERLAP}' AND ticker LIKE '%3'),
marks AS (SELECT ticker, coalesce(max(date), DATE '2010-01-01') AS mark FROM stocks LEFT JOIN stored USING (ticker) GROUP BY ticker),
added AS (SELECT b.* FROM bars b JOIN marks USING (ticker) WHERE b.date >= DATE '{OVERLAP}' AND b.date >= mark AND ticker NOT IN (SELECT ticker FROM bad) AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.ticker = b.ticker AND s.date = b.date))
SELECT ticker, count(added.date) AS rows_added, ticker IN (SELECT ticker FROM bad) AS failed FROM stocks LEFT JOIN added USING (ticker) GROUP BY ticker""")
def incremental_load(spark, d):
    bars = A.bars(spark, d)
    landed = bars.where(f"date >= date'{OVERLAP}'").withColumn("close", F.when(~F.col("ticker").like("%3"), F.col("close")))
    _, _, report = W.incremental(A.stocks(spark, d), bars.where(f"date < date'{SPLIT}'"), landed, "ticker", [F.col("volume"), F.col("close")], F.col("close").isNull())
    return report


_LOADED = SQL["incremental_load"]


@query(f"""SELECT TIMESTAMP '2001-01-01 06:00:00' AS run_at, 'incremental' AS mode, CAST(count(*) FILTER (NOT failed) AS INTEGER) AS stocks_updated, sum(rows_added)::BIGINT AS rows_added,
  CAST(count(*) FILTER (failed) AS INTEGER) AS errors, 61.3::DOUBLE AS duration_sec, CASE WHEN bool_or(failed) THEN 'partial' ELSE 'ok' END AS status FROM ({_LOADED})""")
def run_log(spark, d):
    return W.run_log_row(incremental_load(spark, d), "incremental", "2001-01-01 06:00:00", 61.26)


@query(f"WITH {BARS} SELECT ticker, count(*) AS n FROM bars WHERE ticker LIKE '%5' GROUP BY ticker")
def orphan_prices(spark, d):
    return S.orphans(A.bars(spark, d), A.stocks(spark, d).where("source = 'sp500'")).groupBy("ticker").agg(F.count("*").alias("n"))


@query(f"WITH {BARS}, {CONTEXT}, {STOCKS}, n AS (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker) SELECT (SELECT count(DISTINCT ticker) FROM bars) AS tickers, (SELECT count(*) FROM bars) AS price_rows, (SELECT min(date) FROM bars) AS first_date, (SELECT max(date) FROM bars) AS last_date, (SELECT count(*) FROM stocks JOIN n USING (ticker) WHERE n >= 1400) AS ready, (SELECT sum((spy IS NOT NULL)::INT + (vix IS NOT NULL)::INT + (hyg IS NOT NULL)::INT + (tnx IS NOT NULL)::INT)::BIGINT FROM wide) AS baseline_rows")
def table_summary(spark, d):
    bars = A.bars(spark, d)
    return W.summary(W.history_flag(A.stocks(spark, d), bars, 1400), bars, A.baselines(spark, d))


@query(f"WITH {BARS}, {STOCKS}, n AS (SELECT ticker, count(*) AS n FROM bars GROUP BY ticker) SELECT ticker, source, coalesce(n, 0) >= 1550 AS ml_ready FROM stocks LEFT JOIN n USING (ticker)")
def history_flag(spark, d):
    return W.history_flag(A.stocks(spark, d), A.bars(spark, d), 1550).select("ticker", "source", "ml_ready")


@query(f"WITH {BARS}, {STOCKS}, n AS (SELECT ticker FROM bars GROUP BY ticker HAVING count(*) >= 1550) SELECT ticker, date, close FROM bars WHERE ticker IN (SELECT ticker FROM n)")
def ready_prices(spark, d):
    bars = A.bars(spark, d)
    return S.restricted(bars, S.ready_universe(W.history_flag(A.stocks(spark, d), bars, 1550))).select("ticker", "date", "close")


@query(f"WITH {BARS} SELECT count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM bars")
def stream_append(spark, d):
    base = new_path(spark, "stream")
    bars = A.bars(spark, d)
    schema = "ticker string, date date, open double, high double, low double, close double, volume bigint"
    bars.limit(0).write.parquet(f"{base}/target")
    for part in (f"date < date'{SPLIT}'", f"date >= date'{OVERLAP}'"):  # the second delivery repeats some days
        bars.where(part).write.mode("append").parquet(f"{base}/landing")
        append_stream(spark, f"{base}/landing", f"{base}/target", f"{base}/offsets", schema, ["ticker", "date"])
    return spark.read.schema(f"{schema}, month string").parquet(f"{base}/target").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(SQL["append_if_absent"])
def stored_append(spark, d):
    """A stored table that two runs append to, the second of them called twice."""
    rows = A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), (F.col("l_shipdate") < "1999-01-01").alias("old"))
    rows, path = rows.withColumn("part", F.pmod("key", F.lit(8))), new_path(spark, "stored")
    for run in ("old", "not old", "not old"):
        T.write_run(spark, path, rows.where(run).drop("old"), ["key", "line"], [F.col("price"), F.col("qty")], "part", run.replace(" ", "-"), "append")
    return T.read_table(spark, path, "key bigint, line int, qty double, price double, part bigint").drop("part")


@query(SQL["replace_upsert"])
def stored_upsert(spark, d):
    """Daily flow stored by year; a second run replaces the later rows and touches their years only."""
    path = new_path(spark, "stored")
    flow = materialise(I.daily_flow(A.filings(spark, d)).withColumn("year", F.year("date")), "flow")
    newer = flow.where(f"date >= date'{SPLIT}'").withColumn("n_buys", F.col("n_buys") + 1)
    for run, batch in (("first", flow), ("second", newer)):
        T.write_run(spark, path, batch, ["ticker", "date"], [F.desc("n_buys"), F.col("n_sells")], "year", run)
    return rounded(T.read_table(spark, path, "ticker string, date date, n_buys int, n_sells int, buy_value double, sell_value double, year int").drop("year"), 2)


@query(f"""SELECT 'night' AS run_id, * FROM ({SQL["run_log"]})""")
def stored_log(spark, d):
    """The log after one incremental load that was called twice."""
    path, bars = new_path(spark, "stored"), A.bars(spark, d).withColumn("year", F.year("date"))
    landed = bars.where(f"date >= date'{OVERLAP}'").withColumn("close", F.when(~F.col("ticker").like("%3"), F.col("close")))
    for _ in range(2):
        added, _, report = W.incremental(A.stocks(spark, d), bars.where(f"date < date'{SPLIT}'"), landed, "ticker", [F.col("volume"), F.col("close")], F.col("close").isNull())
        T.write_run(spark, path, added.select(*bars.columns), ["ticker", "date"], [F.col("volume"), F.col("close")], "year", "night", "append", W.run_log_row(report, "incremental", "2001-01-01 06:00:00", 61.26))
    return T.read_log(spark, path)


@query("""WITH w AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
SELECT start, event_type, n, total FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events)""")
def stream_windows(spark, d):
    """Events land in three steps, each taken in by a new start of the stream: the second repeats the last hours of the first, the third brings all of the first again, too late to count."""
    base, schema = new_path(spark, "stream"), "event_id bigint, ts timestamp, event_type string, value double"
    events = A.read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    t = [F.timestamp_seconds(F.lit(x)) for x in events.agg(F.expr("percentile_approx(unix_seconds(ts), array(0.33, 0.66), 1000)")).first()[0]]
    steps = [F.col("ts") < t[0], F.col("ts").between(t[0] - F.expr("interval 6 hours"), t[1]), (F.col("ts") > t[1]) | (F.col("ts") < t[0])]
    for step in steps:
        events.where(step).write.mode("append").parquet(f"{base}/landing")
        count_windows(spark, f"{base}/landing", f"{base}/target", f"{base}/offsets", schema, "ts", ["event_id"], ["event_type"], {"n": F.count("*"), "total": F.sum("value")})
    return rounded(spark.read.schema("start timestamp, event_type string, n bigint, total double").parquet(f"{base}/target"), 4)


# ---- insider flow --------------------------------------------------------------------------------------------------


@query(f"WITH {FILINGS} SELECT ticker, date, n_buys, n_sells, {_r('buy_value', 'sell_value', digits=2)} FROM flow")
def insider_daily(spark, d):
    return rounded(I.daily_flow(A.filings(spark, d)), 2)


@query(f"WITH {FILINGS}, n AS (SELECT ticker, count(*) AS n_filings FROM filings GROUP BY ticker) SELECT ticker, n_filings, count(*) AS n_days, sum(n_buys)::BIGINT AS n_buys FROM n JOIN flow USING (ticker) GROUP BY ALL")
def insider_totals(spark, d):
    return I.filing_totals(A.filings(spark, d))


@query(f"""WITH {FILINGS}, days AS (SELECT DISTINCT 'C' || o_custkey AS ticker, CAST(o_orderdate AS DATE) + 3 AS date FROM orders)
SELECT p.ticker, p.date, 1.0::DOUBLE AS close, f.date AS filed, n_buys, n_sells, {_r('buy_value', 'sell_value', digits=2)} FROM days p ASOF LEFT JOIN flow f ON p.ticker = f.ticker AND p.date >= f.date""")
def insider_pit(spark, d):
    f = A.filings(spark, d)
    days = A.read(spark, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), F.date_add(F.to_date("o_orderdate"), 3).alias("date")).distinct().withColumn("close", F.lit(1.0))
    return rounded(I.point_in_time(days, I.daily_flow(f)), 2)


# ---- features ------------------------------------------------------------------------------------------------------


def _feature_query(name: str, columns: list[str], market: bool = False):
    def run(spark, d):
        df = X.own_features(A.bars(spark, d))
        df = X.market_context(df, context(spark, d)) if market else df
        return rounded(df.select("ticker", "date", *columns))

    ints = {"Market_Bullish"}
    shown = ", ".join(f'"{c}"' if c in ints else _r(c) for c in columns)
    query(f"WITH {FULL if market else OWN} SELECT ticker, date, {shown} FROM {'full_' if market else 'l3'}", name)(run)


for _name, _columns, _market in (
    ("returns_momentum", X.RETURNS, False), ("volatility", X.VOLATILITY, False), ("sma_distance", X.DISTANCES, False), ("ema_macd", X.EXPONENTIAL, False), ("zscore", X.SCORES, False), ("rsi", ["RSI_14"], False),
    ("bollinger", X.BANDS, False), ("natr", ["NATR_14"], False), ("volume_vwap", X.VOLUME, False), ("macro_context", X.CONTEXT, True),
):
    _feature_query(_name, _columns, _market)

_WIDE = ", ".join(f'"{c}"' if c == "Market_Bullish" else _r(c) for c in X.WIDE)


@query(f"WITH {FULL} SELECT ticker, date, {_r('close')}, {_WIDE} FROM feat")
def feature_table(spark, d):
    return rounded(feature_rows(spark, d).select("ticker", "date", "close", *X.WIDE))


@query(SQL["feature_table"])
def feature_table_stored(spark, d):
    """The same features out of prices stored in buckets by ticker: no exchange of the bars."""
    path = new_path(spark, "prices")
    stored = T.write_bucketed(A.bars(spark, d), "prices_" + path[-32:], path, 16)
    return rounded(X.feature_table(stored, context(spark, d), dealt=True).select("ticker", "date", "close", *X.WIDE))


@query(SQL["feature_table"])
def feature_table_blocks(spark, d):
    """The same features with each series cut into blocks of a year."""
    return rounded(X.feature_table_in_blocks(A.bars(spark, d), context(spark, d), 365).select("ticker", "date", "close", *X.WIDE))


@query(f"WITH {BARS} SELECT date, open, high, low, close, volume FROM bars WHERE ticker = 'Brand#23'")
def stock_prices(spark, d):
    return S.stock(A.bars(spark, d), "Brand#23")


@query(f"WITH {FULL} SELECT ticker, date, {_WIDE} FROM feat WHERE ticker = 'Brand#23'")
def feature_table_one(spark, d):
    return rounded(X.feature_table(A.bars(spark, d), context(spark, d), ticker="Brand#23").select("ticker", "date", *X.WIDE))


@query(f"""WITH {BARS}, a AS (SELECT *, list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING) AS f FROM bars),
t AS (SELECT *, list_filter(list_transform(f, lambda x: x / nullif(close, 0) - 1), lambda r: r <= -0.01 OR r >= 0.03)[1] AS r FROM a)
SELECT ticker, date, close, CASE WHEN coalesce(len(f), 0) < 10 THEN NULL WHEN r <= -0.01 THEN 0 WHEN r >= 0.03 THEN 1 ELSE 0 END AS label FROM t""")
def triple_barrier(spark, d):
    return L.triple_barrier(A.bars(spark, d)).select("ticker", "date", "close", "label")


@query(SQL["triple_barrier"])
def triple_barrier_blocks(spark, d):
    return L.triple_barrier_in_blocks(A.bars(spark, d), 180).select("ticker", "date", "close", "label")


@query(f"WITH {FULL} SELECT ticker, date, close, label FROM pool")
def labelled_pool(spark, d):
    return pool(spark, d).select("ticker", "date", "close", "label")


@query(f"WITH {FULL} SELECT ticker, count(*) AS n, avg(label) AS win_rate FROM pool GROUP BY ticker")
def win_rates(spark, d):
    return pool(spark, d).groupBy("ticker").agg(F.count("*").alias("n"), F.avg("label").alias("win_rate"))


# ---- folds ---------------------------------------------------------------------------------------------------------


@query(f"WITH {FULL} SELECT fold, role, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM assigned GROUP BY fold, role")
def fold_rows(spark, d):
    return assigned(spark, d).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def _auc_sql(rows: str, score: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""(SELECT {key}sum(n1 * (b + n0 / 2)) / nullif(sum(n1) * sum(n0), 0)::DOUBLE AS auc FROM (SELECT *, coalesce(sum(n0) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM (SELECT {key}{score} AS s, (count(*) FILTER (label = 1))::DOUBLE AS n1, (count(*) FILTER (label = 0))::DOUBLE AS n0 FROM {rows} GROUP BY ALL)) {f"GROUP BY {by}" if by else ""})"""


@query(f"WITH {FULL} SELECT fold, round(auc, 9) AS auc FROM {_auc_sql('scores', 'p1', 'fold')}")
def auc_by_fold(spark, d):
    return rounded(E.auc(scores(spark, d), "p1", by=["fold"]), 9)


@query(f"WITH {FULL} SELECT round(auc, 9) AS auc FROM {_auc_sql('scores', 'p1')}")
def auc_pooled(spark, d):
    return rounded(E.auc(scores(spark, d), "p1"), 9)


_METRICS = f"metrics AS (SELECT fold, count(*) FILTER (role = 'train') AS train_rows, count(*) FILTER (role = 'test') AS test_rows, avg(label) FILTER (role = 'test') AS win_rate, auc FROM assigned LEFT JOIN {_auc_sql('scores', 'p1', 'fold')} USING (fold) GROUP BY fold, auc HAVING train_rows > 0 AND test_rows > 0)"


@query(f"WITH {FULL}, {_METRICS} SELECT fold, train_rows, test_rows, {_r('win_rate', 'auc')} FROM metrics")
def fold_metrics(spark, d):
    return rounded(V.fold_metrics(*metric_inputs(spark, d), "p1"))


@query(f"WITH {FULL}, {_METRICS} SELECT round(avg(round(auc, 4)), 6) AS auc_mean, round(stddev_samp(round(auc, 4)), 6) AS auc_sd FROM metrics")
def auc_spread(spark, d):
    return rounded(E.auc_spread(V.fold_metrics(*metric_inputs(spark, d), "p1")))


@query(f"WITH {FULL} SELECT fold, " + ", ".join(f'round(min("{c}"), 6) + 0.0 AS "{c}_min", round(max("{c}"), 6) + 0.0 AS "{c}_max"' for c in X.LEAN) + " FROM assigned WHERE role = 'train' GROUP BY fold")
def scaler_stats(spark, d):
    return rounded(V.scaler_stats(pool(spark, d), test_folds(spark), X.LEAN))


_STATS = "stats AS (SELECT fold, " + ", ".join(f'min("{c}") AS "{c}_min", max("{c}") AS "{c}_max"' for c in X.LEAN) + " FROM assigned WHERE role = 'train' GROUP BY fold)"


_UNIT = {c: f'("{c}" - "{c}_min") / (CASE WHEN "{c}_max" = "{c}_min" THEN 1 ELSE "{c}_max" - "{c}_min" END)' for c in X.LEAN}


@query(f"WITH {FULL}, {_STATS}, u AS (SELECT fold, role, ticker, date, " + ", ".join(f'{e} AS "{c}"' for c, e in _UNIT.items()) + " FROM assigned JOIN stats USING (fold) WHERE role = 'test') SELECT fold, role, ticker, date, " + _r(*X.LEAN, digits=6) + " FROM u")
def scaled_rows(spark, d):
    rows, folds = materialise(pool(spark, d).select("ticker", "date", "label", *X.LEAN), "pool"), test_folds(spark)
    out = E.scaled(L.tested(rows, folds).select("fold", F.lit("test").alias("role"), "ticker", "date", *X.LEAN), V.scaler_stats(rows, folds, X.LEAN), X.LEAN)
    return rounded(out, 6)


@query(f"WITH {FULL} SELECT fold, round(count(*) FILTER (label = 0) / greatest(count(*) FILTER (label = 1), 1), 6) AS positive_weight FROM assigned WHERE role = 'train' GROUP BY fold")
def class_balance(spark, d):
    return rounded(V.class_balance(pool(spark, d), test_folds(spark)))


@query(f"""WITH {FULL}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS seq, count(*) OVER (PARTITION BY ticker) AS n FROM pool)
SELECT b.ticker, b.date, CAST(60 AS INTEGER) AS length, """ + ", ".join(f'round(sum(a."{c}"::FLOAT::DOUBLE * (a.seq - b.seq + 60)), 3) + 0.0 AS "{c}"' for c in X.LEAN) + """ FROM n b JOIN n a ON a.ticker = b.ticker AND a.seq BETWEEN b.seq - 59 AND b.seq WHERE b.seq >= 60 AND b.n > 60 GROUP BY b.ticker, b.date""", name="sequences")
def sequence_windows(spark, d):
    """Each feature's values weighted by their place, so that every one of the 60 x 8 counts."""
    return _weighted(sequences(pool(spark, d), X.LEAN, 60))


@query(SQL["sequences"])
def sequences_blocks(spark, d):
    """The same windows with each series cut into blocks of a year."""
    return _weighted(sequences_in_blocks(pool(spark, d), X.LEAN, 60, 365))


def _weighted(out: DataFrame) -> DataFrame:
    def weighted(k: int) -> Column:
        return F.aggregate(F.transform("sequence", lambda row, i: F.get(row, F.lit(k)).cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)

    return out.select("ticker", "date", F.size("sequence").alias("length"), *[(F.round(weighted(k), 3) + 0.0).alias(c) for k, c in enumerate(X.LEAN)])


@query(f"WITH {FULL}, c AS (SELECT quantile_cont(date_diff('day', DATE '1970-01-01', date)::DOUBLE, 0.85) AS cut FROM pool) SELECT CASE WHEN date_diff('day', DATE '1970-01-01', date) <= cut THEN 'train' ELSE 'validation' END AS part, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM pool, c GROUP BY 1")
def validation_split(spark, d):
    return L.validation_split(pool(spark, d)).groupBy("part").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


# ---- scores --------------------------------------------------------------------------------------------------------


@query(f"WITH {FULL} SELECT round(corr(p1, p2), 6) AS corr, CASE WHEN corr(p1, p2) < 0.9 THEN 'diverse' ELSE 'redundant' END AS verdict FROM scores")
def score_corr(spark, d):
    return rounded(E.correlation(scores(spark, d), "p1", "p2"))


@query(f"WITH {FULL} SELECT date, ticker, CAST(p1 >= 0.55 AND p2 >= 0.55 AS TINYINT) AS gate FROM scores")
def agreement_gate(spark, d):
    return scores(spark, d).select("date", "ticker", E.agreement(F.col("p1"), F.col("p2"), 0.55).alias("gate"))


@query(f"WITH {FULL} SELECT kind, date, ticker, label, fold, p1 AS p FROM scores, (SELECT unnest(['csv', 'parquet']) AS kind)")
def stored_scores(spark, d):
    """Score files of both kinds, as read back."""
    out, own = None, scores(spark, d).select("date", "ticker", "label", "fold", F.col("p1").alias("p"))
    for kind in ("parquet", "csv"):
        path = new_path(spark, kind)
        W.write_scores(own, path, kind == "csv")
        own = W.read_scores(spark, path, SCORES, kind == "csv")
        found = own.withColumn("kind", F.lit(kind))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH {FULL} SELECT date, ticker, label, fold, {_r('p1', 'p2')}, round(0.5 * p1 + 0.5 * p2, 6) AS blend FROM scores")
def blend(spark, d):
    first, second = score_files(spark, d)
    return rounded(E.blended(first.drop("close"), second))


@query(f"WITH {FULL} SELECT * FROM regimes")
def regimes(spark, d):
    return L.regimes(context(spark, d))


@query(f"WITH {FULL} SELECT date, ticker, label, fold, regime, {_r('blend')} FROM blended")
def blended_regime(spark, d):
    return rounded(blended(spark, d).select("date", "ticker", "label", "fold", "regime", "blend"))


@query(f"WITH {FULL} SELECT coalesce(regime, 'none') AS regime, count(*) AS n, round(avg(label), 6) AS win_rate FROM blended GROUP BY 1")
def regime_counts(spark, d):
    return rounded(E.regime_counts(blended(spark, d)))


@query(f"""WITH {FULL}, s AS (SELECT 'ALL' AS scope, blend, label FROM blended UNION ALL SELECT regime, blend, label FROM blended WHERE regime IN ('bull', 'sideways', 'bear')),
t AS (SELECT unnest([100, 50, 25, 10, 5])::INTEGER AS top_pct), cuts AS (SELECT scope, top_pct, quantile_cont(blend, 1 - top_pct / 100) AS cut FROM (SELECT scope, top_pct, blend FROM s, t) GROUP BY scope, top_pct)
SELECT scope, top_pct, count(*) AS trades, round(avg(label), 6) AS win_rate, round(avg(label) * 4 - 1, 6) AS ev FROM s JOIN cuts USING (scope) WHERE blend >= cut GROUP BY scope, top_pct""".replace("quantile_cont(blend, 1 - top_pct / 100)", "CASE top_pct WHEN 100 THEN quantile_cont(blend, 0.0) WHEN 50 THEN quantile_cont(blend, 0.5) WHEN 25 THEN quantile_cont(blend, 0.75) WHEN 10 THEN quantile_cont(blend, 0.9) ELSE quantile_cont(blend, 0.95) END"))
def selectivity_sweep(spark, d):
    return rounded(E.sweep(blended(spark, d)))


# ---- strategy ------------------------------------------------------------------------------------------------------


@query(f"WITH {FULL} SELECT date, ticker, label, rank, {_r('blend')} FROM chosen")
def top_k_per_day(spark, d):
    return rounded(chosen(spark, d).select("date", "ticker", "label", F.col("rank").cast("bigint").alias("rank"), "blend"))


@query(f"WITH {FULL} SELECT count(*) AS trades, round(avg(label), 6) AS win_rate, round(avg(label) * 3 - (1 - avg(label)) - 0.001, 6) AS ev FROM chosen")
def trade_edge(spark, d):
    return rounded(K.edge(chosen(spark, d), CFG))


@query(f"WITH {FULL} SELECT min(date) AS first_date, max(date) AS last_date, round(date_diff('day', min(date), max(date)) / 365.25, 6) AS years, round(count(*) / (date_diff('day', min(date), max(date)) / 365.25), 6) AS trades_per_year FROM chosen")
def trade_span(spark, d):
    return rounded(K.span(chosen(spark, d)))


_CAGR = "pow(arg_max(spy, date) / arg_min(spy, date), 365.25 / date_diff('day', DATE '1996-01-01', DATE '2000-12-31')) - 1"


@query(f"WITH {CONTEXT} SELECT round({_CAGR}, 6) AS cagr FROM wide WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'")
def benchmark_cagr(spark, d):
    return rounded(K.growth(S.baseline(A.baselines(spark, d), "SPY"), "1996-01-01", "2000-12-31"))


@query(f"WITH {FULL}, {CURVE} SELECT date AS period, wins, trades, round(ret, 6) + 0.0 AS ret, round(equity, 2) AS equity, round(peak, 2) AS peak, round(1 - equity / peak, 6) + 0.0 AS drawdown FROM curve")
def realised_equity(spark, d):
    out = K.equity(K.realised(chosen(spark, d), CFG), CFG)
    return out.select("period", "wins", "trades", *[(F.round(c, n) + 0.0).alias(c) for c, n in (("ret", 6), ("equity", 2), ("peak", 2), ("drawdown", 6))])


def _path_sql(rows: str) -> str:
    return f"""{rows},
e0 AS (SELECT *, (wins * 3.0 * 0.01 - (trades - wins) * 0.01 - trades * 0.001 * 0.01)::DOUBLE AS ret FROM rows_), e1 AS (SELECT *, 1000.0 * exp(sum(ln(1 + ret)) OVER (PARTITION BY path ORDER BY period ROWS UNBOUNDED PRECEDING)) AS equity FROM e0),
e2 AS (SELECT *, greatest(max(equity) OVER (PARTITION BY path ORDER BY period ROWS UNBOUNDED PRECEDING), 1000.0) AS peak FROM e1),
ends AS (SELECT path, arg_max(equity, period) AS final, max(1 - equity / peak) AS worst, max((equity < 500)::INT) AS ruined FROM e2 GROUP BY path)
SELECT count(*) AS paths, round(quantile_cont(final, 0.5), 3) AS median, round(quantile_cont(final, 0.05), 3) AS p5, round(quantile_cont(final, 0.95), 3) AS p95, round(avg(ruined), 3) AS ruin, round(quantile_cont(worst, 0.5), 3) + 0.0 AS median_drawdown FROM ends"""


@query("WITH " + _path_sql("""lines AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS r, CAST(l_linenumber % 6 AS BIGINT) AS wins FROM lineitem),
rows_ AS (SELECT l_suppkey || '-' || (r // 125) AS path, r % 125 AS period, wins, 5 AS trades FROM lines)"""))
def path_stats(spark, d):
    """A supplier's line items in order are as many paths of 125 periods as they fill, and a last shorter one."""
    w = K.Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    rows = A.read(spark, d, "lineitem").select("l_suppkey", (F.row_number().over(w) - 1).alias("r"), (F.col("l_linenumber") % 6).cast("bigint").alias("wins"), F.lit(5).cast("bigint").alias("trades"))
    rows = rows.select(F.concat_ws("-", F.col("l_suppkey").cast("string"), F.expr("cast(r div 125 as string)")).alias("path"), F.expr("r % 125").alias("period"), "wins", "trades")
    return rounded(K.path_stats(K.equity(rows, CFG), CFG), 3)


@query(f"WITH {FULL}, {CURVE}, " + _path_sql("""num AS (SELECT wins, trades, row_number() OVER (ORDER BY date) AS day, count(*) OVER () AS n FROM curve0),
rows_ AS (SELECT g.path, g.day AS period, p.wins, p.trades FROM (SELECT day, n, unnest(range(1, 201)) AS path FROM num) g JOIN num p ON p.day = ('0x' || substr(md5('7:' || g.path || ':' || g.day), 1, 8))::BIGINT % g.n + 1)"""))
def path_draws(spark, d):
    """Paths of the chosen trades' days, drawn with replacement."""
    return rounded(K.path_stats(K.equity(K.resampled(K.realised(chosen(spark, d), CFG), 200, 7), CFG), CFG), 3)


@query(f"""WITH {FULL}, {CURVE}, e AS (SELECT count(*) AS trades, avg(label) AS win_rate, avg(label) * 3 - (1 - avg(label)) - 0.001 AS ev, min(date) AS first_date, max(date) AS last_date, date_diff('day', min(date), max(date)) / 365.25 AS years FROM chosen),
g AS (SELECT {_CAGR} AS cagr FROM wide WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'), f AS (SELECT arg_max(equity, date) AS final, max(1 - equity / peak) AS worst, avg(1.0) * max((equity < 500)::INT) AS ruin FROM curve)
SELECT trades, round(win_rate, 4) AS win_rate, round(ev, 4) AS ev, first_date, last_date, round(years, 4) AS years, round(trades / years, 4) AS trades_per_year, round(cagr, 4) + 0.0 AS cagr, round(pow(1 + cagr, 5), 4) AS benchmark_gain,
  CAST(1 AS BIGINT) AS paths, round(final, 4) AS median, round(final, 4) AS p5, round(final, 4) AS p95, round(ruin, 4) AS ruin, round(worst, 4) + 0.0 AS median_drawdown FROM e, g, f""")
def backtest_report(spark, d):
    return rounded(K.report(blended(spark, d), S.baseline(A.baselines(spark, d), "SPY"), "1996-01-01", "2000-12-31", CFG), 4)


# ---- learning: no SQL ----------------------------------------------------------------------------------------------


@query()
def walk_forward_trees(spark, d):
    return M.walk_forward_trees(pool(spark, d), test_folds(spark), X.WIDE)


@query()
def walk_forward_sequence(spark, d):
    return M.walk_forward_sequences(pool(spark, d), test_folds(spark), X.LEAN)


@query()
def calibrated_scores(spark, d):
    s = materialise(scores(spark, d), "scores")
    model = M.fit_logistic(s.where("fold <= 2"), ["p1"])
    return M.apply_logistic(model, s.where("fold > 2"), ["p1"], "c1").select("date", "ticker", "label", "fold", "p1", "c1")


_NAMES = {"c1": "p1", "c2": "p2", "blend": "0.5 * p1 + 0.5 * p2", "stack": "greatest(p1, p2)"}


@query(f"WITH {FULL}, s AS (SELECT label, " + ", ".join(f"{e} AS {n}" for n, e in _NAMES.items()) + " FROM scores), " + ", ".join(f"a_{n} AS (SELECT auc AS auc_{n} FROM {_auc_sql('s', n)})" for n in _NAMES)
       + " SELECT " + ", ".join(_r(f"auc_{n}") for n in _NAMES) + ", round(greatest(auc_c1, auc_c2), 6) AS best_single, round(auc_stack - greatest(auc_c1, auc_c2), 6) + 0.0 AS lift, CASE WHEN auc_stack > greatest(auc_c1, auc_c2) THEN 'stack' ELSE 'single' END AS verdict FROM " + ", ".join(f"a_{n}" for n in _NAMES))
def ensemble_report(spark, d):
    """The report on given score columns: the better of both in the stack's place."""
    return rounded(M.ensemble_report(scores(spark, d).select("label", *[F.expr(e).alias(n) for n, e in _NAMES.items()])))


@query()
def stacked_scores(spark, d):
    return M.ensemble_report(M.stacked(scores(spark, d).drop("close"), 2))
