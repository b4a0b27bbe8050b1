"""Technical studies: values and boolean triggers for every instrument in one pass.

A study adds its value columns ("lines") to a bar frame; triggers are Columns
over those lines. Every window uses the same partition keys, so a chain of
studies costs one exchange. Suspended sessions sit in their own window
partition and come out as NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.recurrence import discounted_sums, ema, wilder_impulse
from tidemark.functions.windows import TRADED, Axis, crosses_above, crosses_below, known

Trigger = Callable[[Axis, Mapping[str, object]], Column]


@dataclass(frozen=True)
class Study:
    id: str
    build: Callable[..., DataFrame]
    lines: tuple[str, ...]
    triggers: Mapping[str, Trigger]
    defaults: Mapping[str, object] = field(default_factory=dict)
    valued: tuple[str, ...] = ()  # triggers that compare with a caller's value


CATALOG: dict[str, Study] = {}


def study(id: str, lines: str, triggers: Mapping[str, Trigger], valued: tuple[str, ...] = (), **defaults):
    def add(build):
        if id in CATALOG:
            raise ValueError(f"study {id} is registered twice")
        CATALOG[id] = Study(id, build, tuple(lines.split()), triggers, defaults, valued)
        return build

    return add


# ---- trigger families ---------------------------------------------------------

THRESHOLD4 = ("crosses_above", "crosses_below", "above", "below")


def line_triggers(left: str, right: str, names: tuple[str, str, str, str]) -> dict[str, Trigger]:
    up, down, over, under = names
    return {
        up: lambda ax, p: crosses_above(ax, left, right),
        down: lambda ax, p: crosses_below(ax, left, right),
        over: lambda ax, p: F.col(left) > F.col(right),
        under: lambda ax, p: F.col(left) < F.col(right),
    }


def price_vs(line: str) -> dict[str, Trigger]:
    """The study's own price field against its line."""
    return {
        "price_crosses_above": lambda ax, p: crosses_above(ax, p["price_field"], line),
        "price_crosses_below": lambda ax, p: crosses_below(ax, p["price_field"], line),
        "price_above": lambda ax, p: F.col(p["price_field"]) > F.col(line),
        "price_below": lambda ax, p: F.col(p["price_field"]) < F.col(line),
    }


def threshold(line: str, prefix: str = "") -> dict[str, Trigger]:
    return {
        f"{prefix}crosses_above": lambda ax, p: crosses_above(ax, line, p["value"]),
        f"{prefix}crosses_below": lambda ax, p: crosses_below(ax, line, p["value"]),
        f"{prefix}above": lambda ax, p: F.col(line) > p["value"],
        f"{prefix}below": lambda ax, p: F.col(line) < p["value"],
    }


def threshold6(line: str) -> dict[str, Trigger]:
    return {
        **threshold(line),
        "at_least": lambda ax, p: F.col(line) >= p["value"],
        "at_most": lambda ax, p: F.col(line) <= p["value"],
    }


SIX = THRESHOLD4 + ("at_least", "at_most")


def evaluate(
    bars: DataFrame,
    id: str,
    triggers: tuple[str, ...] | None = None,
    value: float | None = None,
    axis: Axis = TRADED,
    **params,
) -> DataFrame:
    """Add the lines of a study and one nullable boolean column per trigger."""
    s = CATALOG[id]
    wanted = tuple(s.triggers) if triggers is None else triggers
    p = {**s.defaults, **params, "value": value}
    build_args = {k: v for k, v in p.items() if k in s.defaults}
    out = s.build(bars, axis, **build_args)
    out = out.withColumns({t: s.triggers[t](axis, p) for t in wanted})
    mask = {c: F.when(F.col("tradable"), F.col(c)) for c in (*s.lines, *wanted)}
    return out.withColumns(mask) if "tradable" in bars.columns else out


def numbered(df: DataFrame, axis: Axis) -> DataFrame:
    return df if "rn" in df.columns else df.withColumn("rn", axis.row())


# ---- averages -----------------------------------------------------------------


@study("technical.ma", "ma", price_vs("ma"), period=20, price_field="close")
def ma(df, ax, period, price_field):
    return df.withColumn("ma", ax.mean(price_field, period))


@study("technical.ema", "ema", price_vs("ema"), period=28, price_field="close")
def ema_line(df, ax, period, price_field="close"):
    df = ema(numbered(df, ax), ax, {"ema": (price_field, 2 / (period + 1))}, "rn")
    return df.withColumn("ema", F.when(F.col("rn") >= period, F.col("ema")))


CROSS_NAMES = ("golden_cross", "death_cross", "fast_above_slow", "fast_below_slow")


@study("technical.ma_cross", "fast slow", line_triggers("fast", "slow", CROSS_NAMES), fast_period=5, slow_period=20,
       price_field="close")
def ma_cross(df, ax, fast_period, slow_period, price_field):
    df = df.withColumns({"fast": ax.mean(price_field, fast_period), "slow": ax.mean(price_field, slow_period)})
    ready = known(F.col("fast"), F.col("slow"))
    return df.withColumns({c: F.when(ready, F.col(c)) for c in ("fast", "slow")})


def _band_triggers() -> dict[str, Trigger]:
    out: dict[str, Trigger] = {}
    for band in ("upper", "middle", "lower"):
        out[f"price_crosses_above_{band}"] = lambda ax, p, b=band: crosses_above(ax, p["price_field"], b)
        out[f"price_crosses_below_{band}"] = lambda ax, p, b=band: crosses_below(ax, p["price_field"], b)
    return out


@study("technical.bollinger", "middle upper lower", _band_triggers(), period=20, stddev_multiplier=2.0, price_field="close")
def bollinger(df, ax, period, stddev_multiplier, price_field):
    df = df.withColumns({"middle": ax.mean(price_field, period), "_sd": ax.rolling(F.stddev_pop, price_field, period)})
    width = stddev_multiplier * F.col("_sd")
    return df.withColumns({"upper": F.col("middle") + width, "lower": F.col("middle") - width}).drop("_sd")


@study("technical.bbi", "bbi", price_vs("bbi"), period_1=3, period_2=6, period_3=12, period_4=24, price_field="close")
def bbi(df, ax, period_1, period_2, period_3, period_4, price_field):
    total = reduce(lambda a, b: a + b, [ax.mean(price_field, n) for n in (period_1, period_2, period_3, period_4)])
    return df.withColumn("bbi", total / 4)


@study("technical.ema_bias", "ema_bias", threshold("ema_bias"), THRESHOLD4, period=28, price_field="close")
def ema_bias(df, ax, period, price_field):
    df = ema_line(df, ax, period, price_field)
    return df.withColumn("ema_bias", (F.col(price_field) / F.col("ema") - 1) * 100)


@study("technical.bias", "bias", threshold("bias"), THRESHOLD4, period=20, price_field="close")
def bias(df, ax, period, price_field):
    return df.withColumn("bias", (F.col(price_field) / ax.mean(price_field, period) - 1) * 100)


@study("amount.average", "amount_average", threshold("amount_average"), THRESHOLD4, period=20)
def amount_average(df, ax, period):
    return df.withColumn("amount_average", ax.mean("amount", period))


# ---- oscillators --------------------------------------------------------------


@study(
    "technical.kdj",
    "k d j",
    {
        "golden_cross": lambda ax, p: crosses_above(ax, "k", "d"),
        "death_cross": lambda ax, p: crosses_below(ax, "k", "d"),
        "j_above": lambda ax, p: F.col("j") > p["value"],
        "j_below": lambda ax, p: F.col("j") < p["value"],
    },
    ("j_above", "j_below"),
    period=9,
    k_smoothing=3,
    d_smoothing=3,
)
def kdj(df, ax, period, k_smoothing, d_smoothing):
    df = numbered(df, ax).withColumns(
        {"_lo": ax.rolling(F.min, "low", period), "_hi": ax.rolling(F.max, "high", period)}
    )
    flat = F.col("_hi") == F.col("_lo")
    rsv = F.when(flat, F.lit(50.0)).otherwise((F.col("close") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 100)
    df = df.withColumn("_rsv", F.when(F.col("_hi").isNotNull(), rsv))
    df = smoothed_from(df, ax, "k", "_rsv", k_smoothing, 50.0, period)
    df = smoothed_from(df, ax, "d", "k", d_smoothing, 50.0, period)
    return df.withColumn("j", 3 * F.col("k") - 2 * F.col("d")).drop("_lo", "_hi", "_rsv")


def smoothed_from(df, ax, out, x, n, start, first_row) -> DataFrame:
    """y = (y'*(n-1) + x)/n from ``first_row`` on, with the value before it fixed at ``start``."""
    u = F.when(F.col("rn") == first_row, (F.col(x) + start * (n - 1)) / n).when(
        F.col("rn") > first_row, F.col(x) / n
    )
    df = discounted_sums(df, ax, {out: (u, 1 - 1 / n)}, "rn")
    return df.withColumn(out, F.when(F.col("rn") >= first_row, F.col(out)))


@study("technical.cci", "cci", threshold("cci"), THRESHOLD4, period=14, constant=0.015)
def cci(df, ax, period, constant):
    df = df.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    df = df.withColumns({"_m": ax.mean("_tp", period), "_all": F.collect_list("_tp").over(ax.frame(-(period - 1), 0))})
    mad = F.aggregate("_all", F.lit(0.0), lambda acc, x: acc + F.abs(x - F.col("_m"))) / period
    df = df.withColumn("_mad", mad)
    out = F.when(F.col("_mad") == 0, F.lit(0.0)).otherwise((F.col("_tp") - F.col("_m")) / (constant * F.col("_mad")))
    return df.withColumn("cci", F.when(F.col("_m").isNotNull(), out)).drop("_tp", "_m", "_all", "_mad")


@study(
    "technical.macd",
    "dif dea hist",
    {
        "golden_cross": lambda ax, p: crosses_above(ax, "dif", "dea"),
        "death_cross": lambda ax, p: crosses_below(ax, "dif", "dea"),
        "crosses_above_zero": lambda ax, p: crosses_above(ax, "dif", 0),
        "crosses_below_zero": lambda ax, p: crosses_below(ax, "dif", 0),
    },
    fast=12,
    slow=26,
    signal=9,
)
def macd(df, ax, fast, slow, signal):
    df = macd_lines(numbered(df, ax), ax, fast, slow, signal)
    ready = F.col("rn") >= slow + signal - 1
    df = df.withColumn("hist", 2 * (F.col("dif") - F.col("dea")))
    return df.withColumns({c: F.when(ready, F.col(c)) for c in ("dif", "dea", "hist")})


def macd_lines(df, ax, fast, slow, signal) -> DataFrame:
    """Raw DIF and DEA lines without a warm-up gate."""
    df = ema(df, ax, {"_ef": ("close", 2 / (fast + 1)), "_es": ("close", 2 / (slow + 1))}, "rn")
    df = df.withColumn("dif", F.col("_ef") - F.col("_es")).drop("_ef", "_es")
    return ema(df, ax, {"dea": ("dif", 2 / (signal + 1))}, "rn")


@study("technical.rsi", "rsi", threshold("rsi"), THRESHOLD4, period=14)
def rsi(df, ax, period):
    df = numbered(df, ax).withColumn("_chg", F.col("close") - ax.lag("close"))
    df = df.withColumns(
        {"_up": F.greatest(F.col("_chg"), F.lit(0.0)), "_dn": F.greatest(-F.col("_chg"), F.lit(0.0))}
    )
    df = df.withColumns({"_su": ax.mean("_up", period), "_sd": ax.mean("_dn", period)})
    df = discounted_sums(
        df,
        ax,
        {
            "_ag": (wilder_impulse(F.col("_up"), F.col("_su"), period, "rn", period + 1), 1 - 1 / period),
            "_al": (wilder_impulse(F.col("_dn"), F.col("_sd"), period, "rn", period + 1), 1 - 1 / period),
        },
        "rn",
    )
    g, l = F.col("_ag"), F.col("_al")
    value = (
        F.when((g == 0) & (l == 0), 50.0).when(l == 0, 100.0).when(g == 0, 0.0).otherwise(100 - 100 / (1 + g / l))
    )
    return df.withColumn("rsi", F.when(F.col("rn") > period, value)).drop(
        "_chg", "_up", "_dn", "_su", "_sd", "_ag", "_al"
    )


@study(
    "technical.stochastic",
    "stoch_k stoch_d",
    {
        "k_crosses_above_d": lambda ax, p: crosses_above(ax, "stoch_k", "stoch_d"),
        "k_crosses_below_d": lambda ax, p: crosses_below(ax, "stoch_k", "stoch_d"),
        "k_above": lambda ax, p: F.col("stoch_k") > p["value"],
        "k_below": lambda ax, p: F.col("stoch_k") < p["value"],
    },
    ("k_above", "k_below"),
    k_period=14,
    d_period=3,
)
def stochastic(df, ax, k_period, d_period):
    df = df.withColumns({"_lo": ax.rolling(F.min, "low", k_period), "_hi": ax.rolling(F.max, "high", k_period)})
    span = F.col("_hi") - F.col("_lo")
    df = df.withColumn("stoch_k", F.when(span == 0, 50.0).otherwise(100 * (F.col("close") - F.col("_lo")) / span))
    df = df.withColumn("stoch_d", ax.mean("stoch_k", d_period))
    return df.withColumn("stoch_k", F.when(F.col("stoch_d").isNotNull(), F.col("stoch_k"))).drop("_lo", "_hi")


@study("technical.williams_r", "williams_r", threshold("williams_r"), THRESHOLD4, period=14)
def williams_r(df, ax, period):
    df = df.withColumns({"_lo": ax.rolling(F.min, "low", period), "_hi": ax.rolling(F.max, "high", period)})
    span = F.col("_hi") - F.col("_lo")
    value = F.when(span == 0, -50.0).otherwise(-100 * (F.col("_hi") - F.col("close")) / span)
    return df.withColumn("williams_r", value).drop("_lo", "_hi")


# ---- ranges and directional movement --------------------------------------------


@study("price.true_range", "true_range", threshold("true_range"), THRESHOLD4)
def true_range(df, ax):
    df = df.withColumn("_pc", ax.lag("close"))
    pc = F.col("_pc")
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))
    return df.withColumn("true_range", F.when(pc.isNotNull(), tr)).drop("_pc")


@study("technical.atr", "atr", threshold("atr"), THRESHOLD4, period=14)
def atr(df, ax, period):
    df = true_range(numbered(df, ax), ax).withColumn("_seed", ax.mean("true_range", period))
    u = wilder_impulse(F.col("true_range"), F.col("_seed"), period, "rn", period + 1)
    df = discounted_sums(df, ax, {"atr": (u, 1 - 1 / period)}, "rn")
    return df.withColumn("atr", F.when(F.col("rn") > period, F.col("atr"))).drop("_seed", "true_range")


@study("technical.natr", "natr", threshold("natr"), THRESHOLD4, period=14)
def natr(df, ax, period):
    return atr(df, ax, period).withColumn("natr", 100 * F.col("atr") / F.col("close"))


@study("technical.adx", "adx", threshold("adx"), THRESHOLD4, period=14)
def adx(df, ax, period):
    """Directional movement: ADX, +DI and -DI, all hidden until 2N rows exist."""
    df = true_range(numbered(df, ax), ax).withColumns(
        {"_um": F.col("high") - ax.lag("high"), "_dm": ax.lag("low") - F.col("low")}
    )
    um, dm = F.col("_um"), F.col("_dm")
    df = df.withColumns(
        {
            "_pdm": F.when(um.isNotNull(), F.when((um > dm) & (um > 0), um).otherwise(0.0)),
            "_mdm": F.when(um.isNotNull(), F.when((dm > um) & (dm > 0), dm).otherwise(0.0)),
        }
    )
    parts = {"tr": "true_range", "p": "_pdm", "m": "_mdm"}
    df = df.withColumns({f"_seed_{k}": ax.rolling(F.sum, c, period) for k, c in parts.items()})
    first = period + 1
    df = discounted_sums(
        df,
        ax,
        {
            f"_s_{k}": (
                F.when(F.col("rn") == first, F.col(f"_seed_{k}")).when(F.col("rn") > first, F.col(c)),
                1 - 1 / period,
            )
            for k, c in parts.items()
        },
        "rn",
    )
    s = F.col("_s_tr")
    df = df.withColumns(
        {
            "plus_di": F.when(s == 0, 0.0).otherwise(100 * F.col("_s_p") / s),
            "minus_di": F.when(s == 0, 0.0).otherwise(100 * F.col("_s_m") / s),
        }
    )
    total = F.col("plus_di") + F.col("minus_di")
    dx = F.when(total == 0, 0.0).otherwise(100 * F.abs(F.col("plus_di") - F.col("minus_di")) / total)
    df = df.withColumn("_dx", F.when(F.col("rn") >= first, dx))
    df = df.withColumn("_seed", ax.mean("_dx", period))
    u = wilder_impulse(F.col("_dx"), F.col("_seed"), period, "rn", 2 * period)
    df = discounted_sums(df, ax, {"adx": (u, 1 - 1 / period)}, "rn")
    ready = F.col("rn") >= 2 * period
    df = df.withColumns({c: F.when(ready, F.col(c)) for c in ("adx", "plus_di", "minus_di")})
    return df.drop("true_range", "_um", "_dm", "_pdm", "_mdm", "_dx", "_seed",
                   *[f"_seed_{k}" for k in parts], *[f"_s_{k}" for k in parts])


DMI_NAMES = ("plus_crosses_above_minus", "plus_crosses_below_minus", "plus_above_minus", "plus_below_minus")
study("technical.dmi", "plus_di minus_di", line_triggers("plus_di", "minus_di", DMI_NAMES), period=14)(adx)


@study(
    "technical.donchian",
    "upper middle lower",
    {
        "price_crosses_above_upper": lambda ax, p: crosses_above(ax, "close", "upper"),
        "price_crosses_below_lower": lambda ax, p: crosses_below(ax, "close", "lower"),
        "price_above_upper": lambda ax, p: F.col("close") > F.col("upper"),
        "price_below_lower": lambda ax, p: F.col("close") < F.col("lower"),
    },
    period=20,
)
def donchian(df, ax, period):
    df = df.withColumns({"upper": ax.prior(F.max, "high", period), "lower": ax.prior(F.min, "low", period)})
    return df.withColumn("middle", (F.col("upper") + F.col("lower")) / 2)


# ---- returns and dispersion -----------------------------------------------------


@study("technical.roc", "roc", threshold("roc"), THRESHOLD4, period=12, price_field="close")
def roc(df, ax, period, price_field):
    return df.withColumn("roc", (F.col(price_field) / ax.lag(price_field, period) - 1) * 100)


@study("technical.momentum", "momentum", threshold("momentum"), THRESHOLD4, period=10, price_field="close")
def momentum(df, ax, period, price_field):
    return df.withColumn("momentum", F.col(price_field) - ax.lag(price_field, period))


@study("technical.return_stddev", "return_stddev", threshold("return_stddev"), THRESHOLD4, period=20,
       price_field="close")
def return_stddev(df, ax, period, price_field):
    df = df.withColumn("_r", 100 * (F.col(price_field) / ax.lag(price_field) - 1))
    return df.withColumn("return_stddev", ax.rolling(F.stddev_pop, "_r", period)).drop("_r")


@study(
    "technical.historical_volatility",
    "historical_volatility",
    threshold("historical_volatility"),
    THRESHOLD4,
    period=20,
    annualization_sessions=252,
    price_field="close",
)
def historical_volatility(df, ax, period, annualization_sessions, price_field):
    df = df.withColumn("_r", F.log(F.col(price_field) / ax.lag(price_field)))
    scale = math.sqrt(annualization_sessions) * 100
    return df.withColumn("historical_volatility", ax.rolling(F.stddev_pop, "_r", period) * scale).drop("_r")


REGIMES = {"uptrend": "up", "downtrend": "down", "range": "range"}


@study(
    "technical.trend_regime",
    "regime",
    {t: (lambda ax, p, r=r: F.col("regime") == r) for t, r in REGIMES.items()},
    short_period=20,
    long_period=60,
    slope_lookback=5,
    adx_period=14,
    adx_threshold=25.0,
    confirmation_days=2,
    stability_bars=120,
)
def trend_regime(df, ax, short_period, long_period, slope_lookback, adx_period, adx_threshold, confirmation_days,
                 stability_bars):
    df = adx(df, ax, adx_period).withColumns(
        {"_s": ax.mean("close", short_period), "_l": ax.mean("close", long_period)}
    )
    df = df.withColumn("_s0", ax.lag("_s", slope_lookback))
    s, l, s0, c = F.col("_s"), F.col("_l"), F.col("_s0"), F.col("close")
    ready = known(s, l, s0, F.col("adx")) & (F.col("rn") >= stability_bars) & (F.col("rn") > slope_lookback)
    strong = F.col("adx") >= adx_threshold
    up = (c > s) & (s > l) & (s > s0) & strong & (F.col("plus_di") > F.col("minus_di"))
    down = (c < s) & (s < l) & (s < s0) & strong & (F.col("minus_di") > F.col("plus_di"))
    df = df.withColumns({"_ready": ready, "_raw": F.when(ready & up, "up").when(ready & down, "down").otherwise("range")})
    recent = ax.frame(-(confirmation_days - 1), 0)
    same = (F.min("_raw").over(recent) == F.max("_raw").over(recent)) & (F.count("_raw").over(recent) == confirmation_days)
    df = df.withColumn("_same", same)
    regime = F.when(F.col("_ready"), F.when(F.col("_same"), F.col("_raw")).otherwise("range"))
    return df.withColumn("regime", regime).drop("_s", "_l", "_s0", "_ready", "_raw", "_same")


# ---- price and amount facts -----------------------------------------------------


@study("price.close", "price", threshold6("price"), SIX)
def close_price(df, ax):
    return df.withColumn("price", F.col("close"))


@study("price.return_pct", "return_pct", threshold6("return_pct"), SIX, period=5, price_field="close")
def return_pct(df, ax, period, price_field):
    return df.withColumn("return_pct", (F.col(price_field) / ax.lag(price_field, period) - 1) * 100)


@study("price.rolling_high", "prior_high", {"new_high": lambda ax, p: F.col(p["price_field"]) > F.col("prior_high")}, period=20,
       price_field="close")
def rolling_high(df, ax, period, price_field):
    return df.withColumn("prior_high", ax.prior(F.max, price_field, period))


@study("price.consecutive_up", "streak", {"at_least": lambda ax, p: F.col("streak") >= p["days"]}, days=3)
def consecutive_up(df, ax, days):
    """Length of the current run of rises: rows since the last row that did not rise."""
    df = numbered(df, ax).withColumn("_pc", ax.lag("close"))
    df = df.withColumn("_break", F.when(F.coalesce(F.col("close") > F.col("_pc"), F.lit(False)), None).otherwise(F.col("rn")))
    df = df.withColumn("streak", (F.col("rn") - F.max("_break").over(ax.so_far())).cast("double"))
    return df.withColumn("streak", F.when(F.col("rn") > days, F.col("streak"))).drop("_pc", "_break")


@study("price.amplitude", "amplitude", threshold("amplitude"), THRESHOLD4)
def amplitude(df, ax):
    return df.withColumn("amplitude", 100 * (F.col("high") - F.col("low")) / ax.lag("close"))


@study("market.amount", "turnover", threshold("turnover"), THRESHOLD4)
def market_amount(df, ax):
    return df.withColumn("turnover", F.col("amount"))


@study("market.turnover_rate", "turnover_rate", threshold("turnover_rate"), THRESHOLD4)
def turnover_rate(df, ax):
    """The provider's own rate; a row without full provenance stays unknown."""
    sourced = known(F.col("turnover_rate_pct"), F.col("turnover_rate_provider"), F.col("turnover_rate_methodology"))
    return df.withColumn("turnover_rate", F.when(sourced, F.col("turnover_rate_pct")))


# ---- volume ---------------------------------------------------------------------


@study(
    "market.volume",
    "volume_average",
    {
        "gte_multiple": lambda ax, p: F.col("volume") >= F.col("volume_average") * p["value"],
        "lte_multiple": lambda ax, p: F.col("volume") <= F.col("volume_average") * p["value"],
    },
    ("gte_multiple", "lte_multiple"),
    baseline_period=20,
)
def volume_average(df, ax, baseline_period):
    return df.withColumn("volume_average", ax.mean("volume", baseline_period))


def _steady(ax: Axis, p) -> Column:
    return ax.rolling(F.min, "rvol", p["consecutive_days"]) >= p["value"]


@study(
    "volume.relative",
    "rvol",
    {
        "gt_multiple": lambda ax, p: F.col("rvol") > p["value"],
        "gte_multiple": lambda ax, p: F.col("rvol") >= p["value"],
        "lte_multiple": lambda ax, p: F.col("rvol") <= p["value"],
        "consecutive_gte_multiple": _steady,
    },
    ("gt_multiple", "gte_multiple", "lte_multiple", "consecutive_gte_multiple"),
    baseline_period=20,
    consecutive_days=3,
)
def relative_volume(df, ax, baseline_period, consecutive_days=3):
    return df.withColumn("rvol", F.try_divide(F.col("volume"), ax.prior(F.avg, "volume", baseline_period)))


@study(
    "volume.price_confirmation",
    "rvol return_1",
    {
        "surge_up": lambda ax, p: (F.col("rvol") >= p["volume_multiple"]) & (F.col("return_1") >= p["return_threshold_pct"]),
        "surge_down": lambda ax, p: (F.col("rvol") >= p["volume_multiple"]) & (F.col("return_1") <= -p["return_threshold_pct"]),
    },
    baseline_period=20,
    volume_multiple=1.5,
    return_threshold_pct=5.0,
)
def price_confirmation(df, ax, baseline_period, volume_multiple, return_threshold_pct):
    df = relative_volume(df, ax, baseline_period)
    return df.withColumn("return_1", F.when(F.col("rvol").isNotNull(), (F.col("close") / ax.lag("close") - 1) * 100))


@study(
    "technical.obv",
    "obv",
    {
        "rising": lambda ax, p: F.col("obv") > ax.lag("obv"),
        "falling": lambda ax, p: F.col("obv") < ax.lag("obv"),
    },
)
def obv(df, ax):
    df = df.withColumn("_pc", ax.lag("close"))
    signed = F.when(F.col("_pc").isNull(), F.col("volume")).otherwise(
        F.signum(F.col("close") - F.col("_pc")) * F.col("volume")
    )
    return df.withColumn("_sv", signed).withColumn("obv", F.sum("_sv").over(ax.so_far())).drop("_pc", "_sv")


@study(
    "volume.price_divergence",
    "obv_change obv_needed",
    {"bearish": lambda ax, p: F.col("_bear"), "bullish": lambda ax, p: F.col("_bull")},
    left_bars=3,
    right_bars=3,
    min_separation=5,
    max_separation=60,
    price_threshold_pct=2.0,
    obv_threshold_adv=1.0,
    average_volume_period=20,
)
def price_divergence(df, ax, left_bars, right_bars, min_separation, max_separation, price_threshold_pct,
                     obv_threshold_adv, average_volume_period):
    """Pivots that price and OBV disagree on, reported on the row that confirms the pivot.

    The previous pivot is found with a bounded row frame instead of a join.
    """
    df = obv(numbered(df, ax), ax)
    left, right = (-left_bars, -1), (1, right_bars)
    df = df.withColumns(
        {
            "_hp": (F.col("high") > ax.gated(F.max, "high", *left)) & (F.col("high") > ax.gated(F.max, "high", *right)),
            "_lp": (F.col("low") < ax.gated(F.min, "low", *left)) & (F.col("low") < ax.gated(F.min, "low", *right)),
            "_adv": ax.prior(F.avg, "volume", average_volume_period),
        }
    )
    is_high = F.coalesce(F.col("_hp"), F.lit(False))
    is_low = F.coalesce(F.col("_lp"), F.lit(False)) & ~is_high
    back = ax.frame(-max_separation, -min_separation)
    df = df.withColumns(
        {
            "_ph": F.max(F.when(is_high, F.struct("rn", "high", "obv"))).over(back),
            "_pl": F.max(F.when(is_low, F.struct("rn", "low", "obv"))).over(back),
        }
    )
    high_move = (F.col("high") / F.col("_ph.high") - 1) * 100
    low_move = (F.col("_pl.low") / F.col("low") - 1) * 100
    needed = F.col("_adv") * obv_threshold_adv
    df = df.withColumn(
        "_pt",
        F.when(
            is_high & F.col("_ph").isNotNull(),
            F.struct(
                F.lit("bear").alias("side"),
                high_move.alias("move"),
                (F.col("_ph.obv") - F.col("obv")).alias("change"),
                needed.alias("needed"),
            ),
        ).when(
            is_low & F.col("_pl").isNotNull(),
            F.struct(
                F.lit("bull").alias("side"),
                low_move.alias("move"),
                (F.col("obv") - F.col("_pl.obv")).alias("change"),
                needed.alias("needed"),
            ),
        ),
    )
    df = df.withColumn("_at", ax.lag("_pt", right_bars))
    ready = F.col("rn") > max(average_volume_period, left_bars + min_separation) + right_bars
    hit = (F.col("_at.move") >= price_threshold_pct) & (F.col("_at.change") >= F.col("_at.needed"))
    return df.withColumns(
        {
            "obv_change": F.when(ready, F.col("_at.change")),
            "obv_needed": F.when(ready, F.col("_at.needed")),
            "_bear": F.when(ready, F.coalesce(hit & (F.col("_at.side") == "bear"), F.lit(False))),
            "_bull": F.when(ready, F.coalesce(hit & (F.col("_at.side") == "bull"), F.lit(False))),
        }
    ).drop("_hp", "_lp", "_adv", "_ph", "_pl", "_pt", "_at")


# Admissible range of each parameter, by study.
BOUNDS = {
    "technical.macd": {"fast": (1, 500), "slow": (2, 1000), "signal": (1, 500)},
    "technical.ma": {"period": (1, 1000)},
    "technical.rsi": {"period": (2, 1000)},
    "market.volume": {"baseline_period": (1, 1000)},
    "technical.ema": {"period": (1, 1000)},
    "technical.ma_cross": {"fast_period": (1, 500), "slow_period": (2, 1000)},
    "technical.bollinger": {"period": (2, 1000), "stddev_multiplier": (0.000001, 100)},
    "technical.kdj": {"period": (2, 1000), "k_smoothing": (1, 500), "d_smoothing": (1, 500)},
    "technical.cci": {"period": (2, 1000), "constant": (0.000000001, 100)},
    "technical.bbi": {"period_1": (1, 1000), "period_2": (1, 1000), "period_3": (1, 1000), "period_4": (1, 1000)},
    "technical.ema_bias": {"period": (1, 1000)},
    "price.return_pct": {"period": (1, 1000)},
    "price.rolling_high": {"period": (1, 1000)},
    "price.consecutive_up": {"days": (1, 1000)},
    "amount.average": {"period": (1, 1000)},
    "volume.relative": {"baseline_period": (1, 1000), "consecutive_days": (1, 100)},
    "volume.price_confirmation": {"baseline_period": (1, 1000), "volume_multiple": (0.000001, 1000), "return_threshold_pct": (0, 1000)},
    "volume.price_divergence": {"left_bars": (1, 100), "right_bars": (1, 100), "min_separation": (1, 1000), "max_separation": (1, 5000),
                                "price_threshold_pct": (0, 1000), "obv_threshold_adv": (0, 1000), "average_volume_period": (1, 1000)},
    "technical.trend_regime": {"short_period": (1, 1000), "long_period": (2, 5000), "slope_lookback": (1, 1000), "adx_period": (2, 1000),
                               "adx_threshold": (0, 100), "confirmation_days": (1, 100), "stability_bars": (2, 10000)},
    "technical.atr": {"period": (1, 1000)},
    "technical.natr": {"period": (1, 1000)},
    "technical.adx": {"period": (2, 1000)},
    "technical.dmi": {"period": (2, 1000)},
    "technical.bias": {"period": (1, 1000)},
    "technical.roc": {"period": (1, 1000)},
    "technical.momentum": {"period": (1, 1000)},
    "technical.stochastic": {"k_period": (2, 1000), "d_period": (1, 500)},
    "technical.williams_r": {"period": (2, 1000)},
    "technical.donchian": {"period": (1, 1000)},
    "technical.return_stddev": {"period": (2, 1000)},
    "technical.historical_volatility": {"period": (2, 1000), "annualization_sessions": (1, 1000)},
}
# Parameters that must stay in order; the second pair member may equal the first only for separations.
ORDERED = (
    ("fast", "slow"), ("fast_period", "slow_period"), ("short_period", "long_period"), ("period_1", "period_2"),
    ("period_2", "period_3"), ("period_3", "period_4"),
)
# Admissible range of the comparison value; 0 itself is excluded where marked.
PERCENT, RATIO, NEGATIVE, AMOUNT = (0, 100), (0, None), (-100, 0), (0, None)
VALUES = {
    "technical.rsi": PERCENT, "technical.adx": PERCENT, "technical.stochastic": PERCENT, "technical.williams_r": NEGATIVE,
    "market.volume": RATIO, "volume.relative": RATIO, "price.close": RATIO, "price.amplitude": AMOUNT, "market.amount": AMOUNT,
    "market.turnover_rate": AMOUNT, "amount.average": AMOUNT, "price.true_range": AMOUNT, "technical.atr": AMOUNT,
    "technical.natr": AMOUNT, "technical.return_stddev": AMOUNT, "technical.historical_volatility": AMOUNT,
}
ABOVE_ZERO = ("market.volume", "volume.relative", "price.close")
