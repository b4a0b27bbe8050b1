import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    s = local_session("4", "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def folder():
    return SF


@pytest.fixture
def make_bars(spark):
    """Daily bars from rows (instrument, open, high, low, close, volume), one day each."""
    from datetime import date, timedelta

    def build(series):
        rows = []
        for inst, bars in series.items():
            for i, b in enumerate(bars):
                o, h, l, c, v = b if isinstance(b, tuple) else (b, b, b, b, 100.0)
                rows.append((inst, date(2024, 1, 2) + timedelta(days=i), float(o), float(h), float(l), float(c), float(v), float(c * v), bool(v > 0)))
        return spark.createDataFrame(
            rows,
            "instrument int, session_date date, open double, high double, low double, close double, volume double, "
            "amount double, tradable boolean",
        )

    return build


def column(df, name, instrument=None):
    rows = df.orderBy("instrument", "session_date").collect()
    return [r[name] for r in rows if instrument is None or r["instrument"] == instrument]
