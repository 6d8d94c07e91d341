"""Filing payloads (JSON and XML texts in a table) as rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidemark.sources import schemas

#: Names count without their prefix. Attributes are no text: of <x VALUE="1">2</x> the text is 2.
XML = {"ignoreNamespace": "true", "excludeAttribute": "true"}


def lenient_double(x: Column) -> Column:
    """0.0 where the text is missing or no number."""
    return F.coalesce(F.trim(x, F.lit(" \t\r\n")).try_cast("double"), F.lit(0.0))


def cik_map(df: DataFrame, text: str = "payload") -> DataFrame:
    """(ticker, cik) out of JSON objects of records; of a repeated ticker the last entry counts."""
    entries = df.select(F.posexplode(F.map_entries(F.from_json(text, schemas.CIK_MAP))).alias("at", "e"))
    ranked = entries.select("e.value.ticker", F.col("e.value.cik_str").alias("cik"), F.row_number().over(Window.partitionBy("e.value.ticker").orderBy(F.desc("at"), F.desc("e.value.cik_str"))).alias("r"))
    return ranked.where("r = 1").select("ticker", "cik")


def cik_lookup(tickers: DataFrame, ciks: DataFrame) -> DataFrame:
    """(ticker, cik, skipped) of each ticker: those that the map lacks, or has under 0, are skipped."""
    known = ciks.where("cik <> 0").select("ticker", "cik")
    return tickers.select("ticker").distinct().join(known.hint("merge"), "ticker", "left").withColumn("skipped", F.col("cik").isNull())


def form4_filings(df: DataFrame, key: str, text: str = "payload") -> DataFrame:
    """(key, filing_date, accession) of the filings of form 4 itself, out of parallel arrays."""
    recent = F.from_json(text, schemas.FILINGS_JSON)["filings"]["recent"]
    rows = df.select(key, F.explode(F.arrays_zip(recent["form"].alias("form"), recent["filingDate"].alias("filing_date"), recent["accessionNumber"].alias("accession"))).alias("f"))
    return rows.where("f.form = '4'").select(key, F.col("f.filing_date").try_cast("date").alias("filing_date"), F.col("f.accession").alias("accession"))


def latest(filings: DataFrame, n: int) -> DataFrame:
    return filings.orderBy(F.desc("filing_date"), "accession").limit(n)


def primary_document(df: DataFrame, accession: str = "accession", text: str = "payload") -> DataFrame:
    """The folder and the first .xml entry of each filing's index; NULL without one."""
    items = F.from_json(text, schemas.FILING_INDEX)["directory"]["item"]
    first = F.get(F.filter(items, lambda i: F.endswith(i["name"], F.lit(".xml"))), F.lit(0))["name"]
    return df.select(F.col(accession), F.replace(F.col(accession), F.lit("-"), F.lit("")).alias("folder"), first.alias("document"))


def _trimmed(x: Column) -> Column:
    return F.nullif(F.trim(x, F.lit(" \t\r\n")), F.lit(""))


def field(x: Column) -> Column:
    """The text of a field."""
    return _trimmed(F.coalesce(x["value"], x["_VALUE"]))


def _text(t: Column, group: str, name: str) -> Column:
    """A field of a transaction that the full schema has read."""
    return field(t[group][name])


def _either_text(t: Column, group: str, name: str) -> Column:
    """The same of one of _either's transactions. In a plain document a field's inner XML has no other markup than one <value>."""
    plain, full = t["plain"][group][name], t["full"][group][name]
    return _trimmed(F.coalesce(F.replace(F.replace(plain, F.lit("<value>"), F.lit("")), F.lit("</value>"), F.lit("")), full["value"], full["_VALUE"]))


def _entries(doc: Column) -> Column:
    return doc["nonDerivativeTable"]["nonDerivativeTransaction"]


def _code(t: Column, text=_text) -> Column:
    return text(t, "transactionCoding", "transactionCode")


def _amount(t: Column, name: str, text=_text) -> Column:
    return lenient_double(text(t, "transactionAmounts", name))


def _values(t: Column, text=_text) -> list[Column]:
    ad = text(t, "transactionAmounts", "transactionAcquiredDisposedCode")
    return [_code(t, text).alias("code"), ad.alias("ad"), _amount(t, "transactionShares", text).alias("shares"), _amount(t, "transactionPricePerShare", text).alias("price")]


def _transactions(doc: Column) -> Column:
    return F.filter(F.transform(_entries(doc), lambda t: F.struct(*_values(t))), lambda t: t["code"].isNotNull())


def _is_plain(entries: Column, fields: dict[str, list[str]]) -> Column:
    """Whether every transaction has its groups by their own names, and in every field a text, or one <value> and nothing else."""
    one = F.lit(r"^\s*(?:<value>[^<]*</value>\s*|[^<]*)$")
    odd = lambda t: reduce(or_, [t[g].isNull() for g in fields] + [~F.rlike(t[g][x], one) for g, names in fields.items() for x in names])
    return ~F.coalesce(F.exists(entries, odd), F.lit(False))


def _parsed(df: DataFrame, keys: list[str | Column], text: str, fields: dict[str, list[str]]) -> DataFrame:
    """keys with _plain and _full, of which one holds the transactions: plain documents are read with the cheap schema, all others, and those that it can't read, with the full one."""
    # a "<" in a field may be text there, and a text may be cut in pieces; a declaration at the start does no harm
    has = lambda x: F.contains(F.col(text), F.lit(x))
    literal = has("&lt") | has("&#") | has("<!") | (has("<?") & (F.locate("<?", text, 2) > 0))
    rows = df.select(*keys, F.col(text).alias("_text"), F.when(~literal, _entries(F.from_xml(F.col(text), schemas.form4_plain(fields), XML))).alias("_plain"))
    rows = rows.withColumn("_plain", F.when(_is_plain(F.col("_plain"), fields), F.col("_plain")))
    return rows.withColumn("_full", F.when(F.col("_plain").isNull(), _entries(F.from_xml(F.col("_text"), schemas.form4(fields), XML))))


def _either(rows: DataFrame) -> Column:
    """(plain, full) of each transaction, to be exploded as it is: as a column, Spark would make it twice to drop empty ones beforehand."""
    return F.arrays_zip(*[F.coalesce(x, F.array().cast(rows.schema[x].dataType)).alias(x[1:]) for x in ("_plain", "_full")])


def form4_transactions(df: DataFrame, keys: list[str], text: str = "xml", outer: bool = False) -> DataFrame:
    """keys with code, ad, shares, price of the non-derivative transactions that have a code. With outer, a filing without any gives one row of NULLs."""
    if outer:
        doc = F.from_xml(F.col(text), schemas.FORM4_XML, XML)
        return df.select(*keys, F.explode_outer(_transactions(doc)).alias("t")).select(*keys, "t.code", "t.ad", "t.shares", "t.price")
    t = F.col("t")
    parsed = _parsed(df, keys, text, schemas.FORM4_FIELDS)
    rows = parsed.select(*keys, F.explode(_either(parsed)).alias("t"))
    return rows.where(_code(t, _either_text).isNotNull()).select(*keys, *_values(t, _either_text))


def checked_filings(df: DataFrame, keys: list[str], text: str = "xml", counts: Observation | None = None) -> DataFrame:
    """keys with rejected, xml (of rejected filings only, for a second look) and transactions, each text parsed once.

    Rejected is what is no well-formed document, and a null text. A document without transactions is fine and has none. counts: gets the filings and the rejected ones as the rows pass.
    """
    schema = schemas.FORM4_XML.removesuffix(">") + ", _corrupt_record: STRING>"
    doc = F.from_xml(F.col(text), schema, XML | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = df.select(*keys, text, doc.alias("_doc"))
    bad = F.col("_doc").isNull() | F.col("_doc._corrupt_record").isNotNull()
    none = F.array().cast("array<struct<code:string,ad:string,shares:double,price:double>>")
    out = rows.select(*keys, bad.alias("rejected"), F.when(bad, F.col(text)).alias(text), F.when(bad, none).otherwise(F.coalesce(_transactions(F.col("_doc")), none)).alias("transactions"))
    return out if counts is None else out.observe(counts, F.count(F.lit(1)).alias("filings"), F.count_if("rejected").alias("rejected"))


def malformed(df: DataFrame, keys: list[str], text: str = "xml") -> DataFrame:
    """Filings whose XML gives no document: to be looked at."""
    doc = F.from_xml(F.col(text), schemas.FORM4_XML, XML)
    return df.where(doc["nonDerivativeTable"].isNull()).select(*keys, text)


def _flow_rows(filings: DataFrame, text: str) -> DataFrame:
    """(ticker, date, code, value, first) of every transaction; a filing without any gives one row of NULLs. first: one row of each filing."""
    t, keys = F.col("t"), ["ticker", F.col("filing_date").alias("date")]
    parsed = _parsed(filings, keys, text, schemas.FLOW_FIELDS)
    rows = parsed.select("ticker", "date", F.posexplode_outer(_either(parsed)).alias("at", "t"))
    value = _amount(t, "transactionShares", _either_text) * _amount(t, "transactionPricePerShare", _either_text)
    return rows.select("ticker", "date", _code(t, _either_text).alias("code"), value.alias("value"), (F.coalesce("at", F.lit(0)) == 0).alias("first"))


def daily_flow(filings: DataFrame, text: str = "xml") -> DataFrame:
    """(ticker, date, n_buys, n_sells, buy_value, sell_value) by filing date. A filing without purchases or sales gives a day of zeros."""
    aggs = []
    for name, code in (("buy", "P"), ("sell", "S")):
        own = F.col("code") == code
        aggs += [F.count_if(own).cast("int").alias(f"n_{name}s"), F.coalesce(F.sum(F.when(own, F.col("value"))), F.lit(0.0)).alias(f"{name}_value")]
    return _flow_rows(filings, text).groupBy("ticker", "date").agg(*aggs).select("ticker", "date", "n_buys", "n_sells", "buy_value", "sell_value")


def flow_totals(filings: DataFrame, flow: DataFrame) -> DataFrame:
    """Per ticker: filings, days with a row, purchases."""
    n = filings.groupBy("ticker").agg(F.count("*").alias("n_filings"))
    days = flow.groupBy("ticker").agg(F.count("*").alias("n_days"), F.sum("n_buys").alias("n_buys"))
    return n.join(days.hint("merge"), "ticker", "left").na.fill(0)


def filing_totals(filings: DataFrame, text: str = "xml") -> DataFrame:
    """flow_totals of filings and their own daily flow, in one pass over the filings. As there, filings without a ticker have no days."""
    days = _flow_rows(filings, text).groupBy("ticker", "date").agg(F.count_if("first").alias("n"), F.count_if(F.col("code") == "P").alias("b"))
    known = lambda x: F.when(F.col("ticker").isNotNull(), x).otherwise(F.lit(0)).cast("bigint")
    return days.groupBy("ticker").agg(F.sum("n").alias("n_filings"), F.count("*").alias("d"), F.sum("b").alias("b")).select("ticker", "n_filings", known(F.col("d")).alias("n_days"), known(F.col("b")).alias("n_buys"))


def point_in_time(prices: DataFrame, flow: DataFrame) -> DataFrame:
    """Prices with the flow last filed on or before the day: both tables in one ordered pass, without a range join."""
    values = ["n_buys", "n_sells", "buy_value", "sell_value"]
    own = prices.select("ticker", "date", "close", F.lit(1).alias("_kind"), F.lit(None).cast("struct<filed:date,n_buys:int,n_sells:int,buy_value:double,sell_value:double>").alias("_flow"))
    filed = flow.select("ticker", "date", F.lit(None).cast("double").alias("close"), F.lit(0).alias("_kind"), F.struct(F.col("date").alias("filed"), *values).alias("_flow"))
    w = Window.partitionBy("ticker").orderBy("date", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    out = own.unionByName(filed).withColumn("_flow", F.last("_flow", ignorenulls=True).over(w)).where("_kind = 1")
    return out.select("ticker", "date", "close", "_flow.*")
