import numpy as np
import pandas as pd
import pytest

from conftest import column
from pyspark.sql import functions as F
from tidemark.functions.recurrence import ema
from tidemark.functions.windows import DAILY, TRADED, crosses_above
from tidemark.operators import indicators as I
from tidemark.plans.atoms import coded_bars
from tidemark.sources import market


@pytest.mark.parametrize("n", [1, 63, 64, 65, 300])
def test_recurrence_equals_sequential(make_bars, n):
    x = np.random.default_rng(n).uniform(1, 1000, n)
    df = make_bars({1: list(x), 2: list(x[::-1])}).withColumn("rn", DAILY.row())
    got = ema(df, DAILY, {"e": ("close", 2 / 13)}, "rn")
    for inst, series in ((1, x), (2, x[::-1])):
        want = pd.Series(series).ewm(span=12, adjust=False).mean()
        assert np.allclose(column(got, "e", inst), want, rtol=1e-12)


def test_long_decay_does_not_overflow(make_bars):
    x = np.random.default_rng(0).uniform(1, 10, 700)
    got = ema(make_bars({1: list(x)}).withColumn("rn", DAILY.row()), DAILY, {"e": ("close", 0.9)}, "rn")
    assert np.allclose(column(got, "e"), pd.Series(x).ewm(alpha=0.9, adjust=False).mean(), rtol=1e-10)


def test_shortest_periods_follow_the_price(make_bars):
    bars = make_bars({1: [3.0, 5.0, 4.0]})
    assert column(I.evaluate(bars, "technical.ema", (), period=1), "ema") == [3.0, 5.0, 4.0]
    assert column(I.evaluate(bars, "technical.atr", (), value=1.0, period=1), "atr") == [None, 2.0, 1.0]
    assert column(I.evaluate(bars, "technical.kdj", (), value=1.0, period=2, k_smoothing=1, d_smoothing=1), "k") == [None, 100.0, 0.0]


def test_rolling_value_needs_a_full_frame(make_bars):
    df = make_bars({1: [1, 2, 3, 4]}).withColumn("m", DAILY.mean("close", 3))
    assert column(df, "m") == [None, None, 2.0, 3.0]


def test_crossing_counts_equality_before_and_is_unknown_at_the_start(make_bars):
    df = make_bars({1: [3, 5, 5, 6, 4, 6]}).withColumn("x", crosses_above(DAILY, "close", 5))
    assert column(df, "x") == [None, False, False, True, False, True]


def test_suspended_session_neither_moves_nor_emits(make_bars):
    rows = [(c, c, c, c, v) for c, v in ((1, 9), (99, 0), (2, 9), (3, 9))]
    out = I.evaluate(make_bars({1: rows}), "technical.ma", ("price_above",), period=2)
    assert column(out, "ma") == [None, None, 1.5, 2.5]
    assert column(out, "price_above") == [None, None, True, True]


def test_rsi_conventions(make_bars):
    flat, up, down = [5] * 20, list(range(1, 21)), list(range(20, 0, -1))
    out = I.evaluate(make_bars({1: flat, 2: up, 3: down}), "technical.rsi", (), value=50.0)
    assert [column(out, "rsi", i)[-1] for i in (1, 2, 3)] == [50.0, 100.0, 0.0]
    assert column(out, "rsi", 2)[:14] == [None] * 14 and column(out, "rsi", 2)[14] is not None


def test_flat_market_is_finite(make_bars):
    bars = make_bars({1: [7] * 40})
    assert column(I.evaluate(bars, "technical.cci", (), value=0.0), "cci")[-1] == 0.0
    assert column(I.evaluate(bars, "technical.williams_r", (), value=0.0), "williams_r")[-1] == -50.0
    assert column(I.evaluate(bars, "technical.stochastic", (), value=0.0), "stoch_k")[-1] == 50.0
    assert column(I.evaluate(bars, "technical.kdj", (), value=0.0), "j")[-1] == pytest.approx(50.0)


def test_streak_resets_on_equal_close(make_bars):
    out = I.evaluate(make_bars({1: [1, 2, 3, 4, 4, 5]}), "price.consecutive_up", days=2)
    assert column(out, "streak") == [None, None, 2.0, 3.0, 0.0, 1.0]


@pytest.mark.parametrize("id", sorted(I.CATALOG))
def test_catalog_matrix_and_prefix_stability(make_bars, id):
    """Every trigger of every study yields true, false or unknown, and history never changes."""
    rng = np.random.default_rng(7)
    close = 100 + np.cumsum(rng.normal(0, 2, 140)) + 30 * np.sin(np.arange(140) / 9)
    rows = [(c - 0.5, c + abs(e) + 1, c - abs(e) - 1, c, 0 if i % 23 == 9 else 100 + 40 * abs(e))
            for i, (c, e) in enumerate(zip(close, rng.normal(0, 1, 140)))]
    extra = {"turnover_rate_pct": F.col("volume") / 50, "turnover_rate_provider": F.lit("p"), "turnover_rate_methodology": F.lit("m")}
    full = I.evaluate(make_bars({1: rows}).withColumns(extra), id, value=1.0).select("instrument", "session_date", *I.CATALOG[id].triggers)
    cut = I.evaluate(make_bars({1: rows[:125]}).withColumns(extra), id, value=1.0).select("instrument", "session_date", *I.CATALOG[id].triggers)
    a = [tuple(r)[2:] for r in full.orderBy("session_date").collect()]
    b = [tuple(r)[2:] for r in cut.orderBy("session_date").collect()]
    assert a[: len(b)] == b
    assert {v for r in a for v in r} <= {True, False, None}
    assert any(v is not None for r in a for v in r)
    assert TRADED.keys == ("instrument", "tradable")


@pytest.mark.parametrize("view", [market.bars_suspended, coded_bars])
def test_windows_run_in_as_many_tasks_as_the_ticks_need(spark, monkeypatch, view):
    monkeypatch.setattr(market, "TICKS_A_TASK", 2000)
    bars = view(spark, "/root/testdata/sf0.01").withColumn("m", DAILY.mean("close", 5))
    per_task = bars.groupBy(F.spark_partition_id().alias("task")).count().toPandas()
    assert len(per_task) > 8 and per_task["count"].sum() == 53307
