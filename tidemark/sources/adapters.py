"""Market-like tables out of the given order tables, so that every operator runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _priced(lineitem: DataFrame) -> DataFrame:
    discount = F.col("l_discount") + 0.0  # no negative zeros
    return lineitem.withColumn("discount", discount).withColumn("px", F.round(100 + 60 * (discount - 0.05), 6)).withColumn("date", F.to_date("l_shipdate"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: a part's brand is the ticker, and each line item a trade on its shipping date."""
    trades = _priced(read(spark, sf_dir, "lineitem")).join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    first = F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "px"))["px"]
    return trades.groupBy(F.col("p_brand").alias("ticker"), "date").agg(first.alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.round(F.avg("px"), 8).alias("close"), F.sum("l_quantity").cast("bigint").alias("volume"))


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, close) of four market series."""
    daily = _priced(read(spark, sf_dir, "lineitem")).groupBy("date").agg(
        F.avg("px").alias("SPY"), (10 + 200 * F.avg("discount")).alias("^VIX"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("px"))).alias("HYG"), (100 * F.avg("l_tax")).alias("^TNX")
    )
    long = daily.select("date", F.explode(F.array(*[F.struct(F.lit(s).alias("symbol"), F.round(F.col(f"`{s}`"), 8).alias("close")) for s in ("SPY", "^VIX", "HYG", "^TNX")])).alias("s"))
    return long.select("s.symbol", "date", "s.close").where("close is not null")


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe: a row per brand, none of them ready yet."""
    p = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("ticker")).agg(F.min("p_type").alias("sector"))
    day = F.lit("1995-01-02").cast("date")
    source = F.when(F.substring("ticker", -1, 1) == "5", "watch").otherwise("sp500")
    return p.select("ticker", F.col("ticker").alias("company_name"), "sector", source.alias("source"), F.lit(False).alias("ml_ready"), day.alias("first_seen"), day.alias("last_updated"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, filing_date, accession, form, xml): each order with lines is a filing of its customer, each line a transaction."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    code = lambda x: F.when(x["l_returnflag"] == "A", "P").when(x["l_returnflag"] == "R", "S").otherwise("M")
    transaction = lambda x: F.concat(
        F.lit("<nonDerivativeTransaction><transactionCoding><transactionCode>"), code(x), F.lit("</transactionCode></transactionCoding><transactionAmounts><transactionShares><value> "),
        x["l_quantity"].cast("string"), F.lit("\n</value></transactionShares><transactionPricePerShare><value>"), x["l_extendedprice"].cast("string"),
        F.lit("</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>"), F.when(x["l_returnflag"] == "R", "D").otherwise("A"),
        F.lit("</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>"),
    )
    xml = F.concat(F.lit('<ownershipDocument xmlns="urn:own"><nonDerivativeTable>'), F.array_join(F.transform("lines", transaction), ""), F.lit("</nonDerivativeTable></ownershipDocument>"))
    orders = read(spark, sf_dir, "orders")
    form = F.when(F.col("o_orderstatus") == "F", "4").when(F.col("o_orderstatus") == "O", "4/A").otherwise("10-K")
    accession = F.concat_ws("-", F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), F.to_date("o_orderdate").alias("filing_date"), accession.alias("accession"), form.alias("form"), xml.alias("xml"))
