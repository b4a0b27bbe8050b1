"""Registered queries against their SQL on the smallest tables (ALL_QUERIES=1 for every one)."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

SAMPLE = ["a01_resample", "a04_factor_snapshot", "a19_revision_duplicates", "e02_identity", "e04_fused_events", "f01_pe_history", "g09_ma_stack",
          "i09_macd", "i24_trend_regime", "i37_price_divergence", "j02_point_in_time", "j05_earliest_tradable", "k01_top_gains", "l04_fifo_pnl",
          "l05_time_weighted", "n01_ex_date_reference", "o09_earliest_of", "o10_non_overlapping", "p06_not", "p22_fees", "q06_minute_daily_tolerance",
          "r01_stream_bars", "s12_sink_manifest", "t07_bollinger", "u03_key_difference", "x03_term_counts"]
NAMES = list(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con(folder):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return c


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return float(f"{float(v):.12g}")
    return str(v) if hasattr(v, "isoformat") else v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    """Of the library's own; the training-data queries, where they are present, are tested on their own."""
    from tidemark.plans import all_queries, all_sql

    assert set(all_queries()) == set(all_sql())
    assert set(all_queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, folder, con, name):
    df = entry.queries()[name](spark, folder)
    got = table(df.columns, df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["instrument", "session_date"]


def test_listing_queries_needs_no_session():
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-500:]
