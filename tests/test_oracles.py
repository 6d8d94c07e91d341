"""Queries against their SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest
from tidemark.plans.catalog import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
#: One query of each kind; the others share their parts.
CHOSEN = "bars_daily baseline_pivot universe_normalise vendor_normalise cik_map cik_lookup filings_json form4_xml filing_index_xml high_water append_if_absent upsert_universe replace_upsert incremental_load run_log table_summary stream_append insider_totals insider_pit ema_macd macro_context feature_table triple_barrier regimes auc_pooled stored_scores selectivity_sweep sequences path_draws backtest_report path_stats auc_by_fold fold_metrics class_balance scaler_stats feature_table_blocks feature_table_stored triple_barrier_blocks form4_quarantine stored_append stored_upsert stored_log stream_windows".split()


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    with duckdb.connect() as c:
        for t in TABLES:
            c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
        r = c.execute(SQL[name])
        names = [d[0] for d in r.description]
        want = r.fetchall()
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(x[i]) for i in at) for x in want), key=repr)


def test_every_sql_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(QUERIES) > 60
