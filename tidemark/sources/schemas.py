"""Schemas of the stored tables."""

PRICES = "ticker STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT"
BASELINES = "symbol STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT"
STOCKS = "ticker STRING, company_name STRING, sector STRING, source STRING, ml_ready BOOLEAN, first_seen DATE, last_updated DATE"
UNIVERSE = "ticker STRING, company_name STRING, sector STRING, source STRING"
INSIDER_FLOW = "ticker STRING, date DATE, n_buys INT, n_sells INT, buy_value DOUBLE, sell_value DOUBLE"
RUN_LOG = "run_at TIMESTAMP, mode STRING, stocks_updated INT, rows_added BIGINT, errors INT, duration_sec DOUBLE, status STRING"
SCORES = "date DATE, ticker STRING, label BYTE, fold INT, p DOUBLE"
FOLDS = "fold INT, train_end DATE, test_start DATE, test_end DATE"
#: One filing document: a field's text stands in a <value> child or in the field itself; of a repeated field the last counts.
_FIELD = "STRUCT<value: STRING, _VALUE: STRING>"
FORM4_FIELDS = {"transactionCoding": ["transactionCode"], "transactionAmounts": ["transactionShares", "transactionPricePerShare", "transactionAcquiredDisposedCode"]}
#: What daily flow needs of them: a field that is not asked for is passed over, which costs less.
FLOW_FIELDS = FORM4_FIELDS | {"transactionAmounts": ["transactionShares", "transactionPricePerShare"]}


def form4(fields: dict[str, list[str]]) -> str:
    groups = ", ".join(f"{g}: STRUCT<{', '.join(f'{x}: {_FIELD}' for x in names)}>" for g, names in fields.items())
    return f"STRUCT<nonDerivativeTable: STRUCT<nonDerivativeTransaction: ARRAY<STRUCT<{groups}>>>>"


def form4_plain(fields: dict[str, list[str]]) -> str:
    """The same with each field's inner XML, for documents in which that is a text or one <value>. from_xml spends most of its time on structs inside structs; those inside maps cost half."""
    names = ", ".join(f"{x}: STRING" for names in fields.values() for x in names)
    return f"STRUCT<nonDerivativeTable: STRUCT<nonDerivativeTransaction: ARRAY<MAP<STRING, STRUCT<{names}>>>>>"


FORM4_XML = form4(FORM4_FIELDS)
CIK_MAP = "MAP<STRING, STRUCT<cik_str: BIGINT, ticker: STRING, title: STRING>>"
FILINGS_JSON = "STRUCT<filings: STRUCT<recent: STRUCT<form: ARRAY<STRING>, filingDate: ARRAY<STRING>, accessionNumber: ARRAY<STRING>>>>"
FILING_INDEX = "STRUCT<directory: STRUCT<item: ARRAY<STRUCT<name: STRING>>>>"
