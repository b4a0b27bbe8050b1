"""Strategy signal generators: one HOLD/BUY/SELL (0/1/2) column per strategy.

The order of the ``when`` branches is the priority of the strategy.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.market_rules import limit_threshold
from tidemark.functions.windows import DAILY, Axis
from tidemark.operators.atoms import bands, change_pct, simple_rsi
from tidemark.operators.indicators import macd_lines, smoothed_from

HOLD, BUY, SELL = 0, 1, 2


@dataclass(frozen=True)
class Strategy:
    name: str
    build: Callable[..., tuple[DataFrame, Column]]
    defaults: Mapping[str, object]
    requires_stop_loss: bool = False


STRATEGIES: dict[str, Strategy] = {}


def strategy(name: str, requires_stop_loss: bool = False, **defaults):
    def add(build):
        if name in STRATEGIES:
            raise ValueError(f"strategy {name} is registered twice")
        STRATEGIES[name] = Strategy(name, build, defaults, requires_stop_loss)
        return build

    return add


def signals(bars: DataFrame, name: str, axis: Axis = DAILY, out: str = "signal", **params) -> DataFrame:
    s = STRATEGIES[name]
    unknown = set(params) - set(s.defaults)
    if unknown:
        raise ValueError(f"strategy {name} has no parameter {sorted(unknown)}")
    p = {**s.defaults, **{k: v for k, v in params.items() if v is not None}}
    df, column = s.build(bars.withColumn("rn", axis.row()), axis, **p)
    return df.withColumn(out, column).select(*bars.columns, out)


def pick(first: Column, first_code: int, second: Column, second_code: int) -> Column:
    return F.when(first, first_code).when(second, second_code).otherwise(HOLD)


def _lagged(df: DataFrame, ax: Axis, *names: str) -> DataFrame:
    return df.withColumns({f"{n}0": ax.lag(n) for n in names})


@strategy("dual_ma", short_period=5, long_period=20)
def dual_ma(df, ax, short_period, long_period):
    df = df.withColumn("_g", ax.mean("close", short_period) - ax.mean("close", long_period))
    df = _lagged(df, ax, "_g")
    g, g0 = F.col("_g"), F.col("_g0")
    return df, pick((g0 <= 0) & (g > 0), BUY, (g0 >= 0) & (g < 0), SELL)


@strategy("macd", fast_period=12, slow_period=26, signal_period=9)
def macd(df, ax, fast_period, slow_period, signal_period):
    df = macd_lines(df, ax, fast_period, slow_period, signal_period)
    df = _lagged(df.withColumn("_h", F.col("dif") - F.col("dea")), ax, "_h")
    h, h0 = F.col("_h"), F.col("_h0")
    return df, pick((h0 <= 0) & (h > 0), BUY, (h0 >= 0) & (h < 0), SELL)


@strategy("rsi", period=14, oversold=30, overbought=70)
def rsi(df, ax, period, oversold, overbought):
    df = _lagged(simple_rsi(df, ax, period, "_r"), ax, "_r")
    r, r0 = F.col("_r"), F.col("_r0")
    return df, pick((r0 > overbought) & (r <= overbought), SELL, (r0 < oversold) & (r >= oversold), BUY)


@strategy("kdj", n_period=9, m1=3, m2=3, low_threshold=30, high_threshold=70)
def kdj(df, ax, n_period, m1, m2, low_threshold, high_threshold):
    df = df.withColumns({"_ll": ax.rolling(F.min, "low", n_period), "_hh": ax.rolling(F.max, "high", n_period)})
    span = F.col("_hh") - F.col("_ll")
    df = df.withColumn("_rsv", (F.col("close") - F.col("_ll")) / F.when(span == 0, 1e-9).otherwise(span) * 100)
    df = smoothed_from(df, ax, "_k", "_rsv", m1, 50.0, n_period)
    df = smoothed_from(df, ax, "_d", "_k", m2, 50.0, n_period)
    df = _lagged(df.withColumn("_g", F.col("_k") - F.col("_d")), ax, "_g")
    g, g0, k = F.col("_g"), F.col("_g0"), F.col("_k")
    return df, pick((g0 >= 0) & (g < 0) & (k > high_threshold), SELL, (g0 <= 0) & (g > 0) & (k < low_threshold), BUY)


@strategy("bollinger", period=20, std_mult=2.0, direction="mean_reversion")
def bollinger(df, ax, period, std_mult, direction):
    df = _lagged(bands(df, ax, period, std_mult), ax, "_up", "_low", "close")
    c, c0, up, up0, lo, lo0 = (F.col(x) for x in ("close", "close0", "_up", "_up0", "_low", "_low0"))
    if direction == "breakout":
        return df, pick((c0 >= lo0) & (c < lo), SELL, (c0 <= up0) & (c > up), BUY)
    return df, pick((c0 < up0) & (c >= up), SELL, (c0 > lo0) & (c <= lo), BUY)


@strategy("mean_reversion", ma_period=20, deviation=0.03)
def mean_reversion(df, ax, ma_period, deviation):
    df = _lagged(df.withColumn("_m", ax.mean("close", ma_period)), ax, "_m", "close")
    m = F.col("_m")
    buy = (m > 0) & (F.try_divide(m - F.col("close"), m) >= deviation)
    return df, pick(buy, BUY, (F.col("close0") < F.col("_m0")) & (F.col("close") >= m), SELL)


@strategy("n_day_high", buy_period=20, sell_period=10)
def n_day_high(df, ax, buy_period, sell_period):
    df = df.withColumns({"_hi": ax.prior(F.max, "close", buy_period), "_lo": ax.prior(F.min, "close", sell_period)})
    return df, pick(F.col("close") < F.col("_lo"), SELL, F.col("close") > F.col("_hi"), BUY)


@strategy("volume_breakout", ma_period=20, vol_ma_period=20, vol_mult=1.5)
def volume_breakout(df, ax, ma_period, vol_ma_period, vol_mult):
    df = df.withColumns({"_m": ax.mean("close", ma_period), "_v": ax.mean("volume", vol_ma_period)})
    df = _lagged(df, ax, "_m", "close")
    c, c0, m, m0, v = (F.col(x) for x in ("close", "close0", "_m", "_m0", "_v"))
    buy = (c0 <= m0) & (c > m) & (v > 0) & (F.col("volume") >= v * vol_mult)
    return df, pick((c0 >= m0) & (c < m), SELL, buy, BUY)


@strategy("ma_stack", short_period=5, mid_period=20, long_period=60, extra_period=10)
def ma_stack(df, ax, short_period, mid_period, long_period, extra_period):
    if not short_period < mid_period < long_period:
        return df, F.lit(HOLD)
    s, m, l = (ax.mean("close", n) for n in (short_period, mid_period, long_period))
    stacked = (s > m) & (m > l)
    if extra_period:
        e = ax.mean("close", extra_period)
        stacked = stacked & (s > e) & (e > m)
    df = df.withColumn("_st", F.coalesce(stacked, F.lit(False)))
    df = df.withColumn("_st0", F.coalesce(ax.lag("_st"), F.lit(False)))
    return df, pick(~F.col("_st0") & F.col("_st"), BUY, F.col("_st0") & ~F.col("_st"), SELL)


@strategy("trend_oversold", trend_ma_period=60, rsi_period=14, oversold=40, overbought=70)
def trend_oversold(df, ax, trend_ma_period, rsi_period, oversold, overbought):
    df = simple_rsi(df, ax, rsi_period, "_r").withColumn("_m", ax.mean("close", trend_ma_period))
    df = _lagged(df, ax, "_r")
    r, r0 = F.col("_r"), F.col("_r0")
    buy = (F.col("close") > F.col("_m")) & (r0 < oversold) & (r >= oversold)
    return df, pick(buy, BUY, (r0 > overbought) & (r <= overbought), SELL)


@strategy("dual_confirm", ma_period=20, fast_period=12, slow_period=26, signal_period=9)
def dual_confirm(df, ax, ma_period, fast_period, slow_period, signal_period):
    df = macd_lines(df, ax, fast_period, slow_period, signal_period)
    df = df.withColumns({"_h": F.col("dif") - F.col("dea"), "_m": ax.mean("close", ma_period)})
    df = _lagged(df, ax, "_h")
    h, h0 = F.col("_h"), F.col("_h0")
    return df, pick((h0 <= 0) & (h > 0) & (F.col("close") > F.col("_m")), BUY, (h0 >= 0) & (h < 0), SELL)


@strategy("limit_board", requires_stop_loss=True, consecutive_days=2)
def limit_board(df, ax, consecutive_days):
    df = change_pct(df, ax)
    up = F.col("_chg") >= limit_threshold(F.col("stock_code"))
    df = df.withColumns({"_isup": F.coalesce(up, F.lit(False)).cast("int"), "_open": F.coalesce(~up, F.lit(False))})
    before = ax.frame(-consecutive_days, -1)
    all_up = (F.sum("_isup").over(before) >= consecutive_days) & (F.count("_chg").over(before) >= consecutive_days)
    return df, F.when(F.col("_open") & all_up, BUY).otherwise(HOLD)


@strategy("always_hold")
def always_hold(df, ax):
    return df, F.lit(BUY)
