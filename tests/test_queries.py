"""Registered queries against DuckDB. A few per family by default; all of them with LOGWEAVE_ALL=1."""

import os

import duckdb
import pytest

import check
from logweave.queries import catalog
from logweave.queries.inputs import TABLES

SF = os.environ.get("LOGWEAVE_SF", "/root/testdata/sf0.001")
SAMPLE = [
    "ingest_cef_repair", "ingest_timestamp_parse", "ingest_quality", "parse_logs", "reparse_counts", "filter_combined", "filter_search",
    "filter_cidr", "filter_cidr_v6_long", "parse_user_rules", "load_compact", "saved_query_override", "logs_page_after", "range_aggregates", "device_list", "timeline_tz", "alert_firings",
    "silence_transitions", "alert_fanout", "notification_history", "export_csv_rows", "retention_plan", "search_phrase",
    "stream_parse", "stream_log_rate", "stream_alert_threshold", "stream_device_silence", "stream_late_data",
]
NAMES = sorted(catalog.QUERIES) if os.environ.get("LOGWEAVE_ALL") else SAMPLE

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = check.table(df.columns, [tuple(r) for r in df.collect()])
    result = duck.execute(catalog.ORACLE[name])
    assert got == check.table([d[0] for d in result.description], result.fetchall())


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE) and len(catalog.QUERIES) == 164


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert catalog.QUERIES.keys() <= entry.queries().keys()
    assert catalog.ORACLE.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()
