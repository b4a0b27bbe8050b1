"""Vectorised signal atoms: one 0/1 column per atom, for all instruments in one pass.

Unlike the studies, an atom never says "unknown": missing operands mean 0, and
the first ``warmup`` rows of an instrument are 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.market_rules import is_limit_down, is_limit_up
from tidemark.functions.recurrence import discounted_sums, ema_impulse
from tidemark.functions.windows import DAILY, Axis
from tidemark.operators.indicators import macd_lines

CATEGORIES = ("technical", "price_action", "volume", "fundamental", "event_time", "benchmark")
DEPENDENCIES = ("ohlcv", "valuation", "financial", "dividend", "index")


@dataclass(frozen=True)
class Atom:
    id: str
    category: str
    deps: tuple[str, ...]
    warmup: int
    family: str


Family = Callable[[DataFrame, Axis], tuple[DataFrame, dict[str, Column]]]
ATOMS: dict[str, Atom] = {}
FAMILIES: dict[str, Family] = {}


def register(atom: Atom) -> Atom:
    if atom.id in ATOMS:
        raise ValueError(f"atom {atom.id} is registered twice")
    if atom.category not in CATEGORIES or any(d not in DEPENDENCIES for d in atom.deps):
        raise ValueError(f"atom {atom.id} names an unknown category or dependency")
    ATOMS[atom.id] = atom
    return atom


def family(name: str, category: str, warmups: dict[str, int], deps: tuple[str, ...] = ("ohlcv",)):
    """Declare a family: a function that returns the staged frame and a Column per atom id."""

    def add(build: Family) -> Family:
        FAMILIES[name] = build
        for id, warmup in warmups.items():
            register(Atom(id, category, deps, warmup, name))
        return build

    return add


def with_atoms(bars: DataFrame, ids: Iterable[str], axis: Axis = DAILY) -> DataFrame:
    """Add the named atoms as 0/1 integer columns."""
    ids = list(ids)
    df = bars.withColumn("rn", axis.row())
    keep = list(bars.columns)
    for name in dict.fromkeys(ATOMS[i].family for i in ids):
        df, columns = FAMILIES[name](df, axis)
        mine = [i for i in ids if ATOMS[i].family == name]
        df = df.withColumns(
            {
                i: ((F.col("rn") > ATOMS[i].warmup) & F.coalesce(columns[i], F.lit(False))).cast("int")
                for i in mine
            }
        )
    return df.select(*keep, *ids)


# ---- technical ------------------------------------------------------------------

UP_PAIRS = [(5, 10), (5, 20), (5, 60), (10, 20), (10, 60), (20, 60), (20, 120), (60, 120), (60, 250)]
DOWN_PAIRS = [(5, 10), (5, 20), (10, 20), (20, 60), (60, 250)]
MA_LEVELS = (20, 60, 250)


def _averages(df: DataFrame, ax: Axis, periods: Iterable[int]) -> DataFrame:
    """Add ``_ma<n>`` for the periods that are not there yet."""
    return df.withColumns({f"_ma{n}": ax.mean("close", n) for n in periods if f"_ma{n}" not in df.columns})


def _pair_atoms(pairs, word: str, before, now):
    def build(df: DataFrame, ax: Axis):
        df = _averages(df, ax, sorted({n for p in pairs for n in p}))
        gaps = {f"_gap_{f}_{s}": F.col(f"_ma{f}") - F.col(f"_ma{s}") for f, s in pairs}
        df = df.withColumns(gaps)
        df = df.withColumns({f"{g}_was": ax.lag(g) for g in gaps})
        return df, {
            f"ma_{f}_cross_{word}_{s}": before(F.col(f"_gap_{f}_{s}_was")) & now(F.col(f"_gap_{f}_{s}"))
            for f, s in pairs
        }

    return build


family("ma_cross_up", "technical", {f"ma_{f}_cross_up_{s}": s + 1 for f, s in UP_PAIRS})(
    _pair_atoms(UP_PAIRS, "up", lambda g: g <= 0, lambda g: g > 0)
)
family("ma_cross_down", "technical", {f"ma_{f}_cross_down_{s}": s + 1 for f, s in DOWN_PAIRS})(
    _pair_atoms(DOWN_PAIRS, "down", lambda g: g >= 0, lambda g: g < 0)
)


@family("close_ma", "technical", {f"close_{w}_ma_{n}": n + 1 for w in ("above", "below") for n in MA_LEVELS})
def close_ma(df, ax):
    df = _averages(df, ax, MA_LEVELS)
    out = {f"close_above_ma_{n}": F.col("close") > F.col(f"_ma{n}") for n in MA_LEVELS}
    return df, out | {f"close_below_ma_{n}": F.col("close") < F.col(f"_ma{n}") for n in MA_LEVELS}


MACD_ATOMS = ("macd_golden_cross", "macd_death_cross", "macd_above_zero", "macd_below_zero", "macd_hist_turn_positive")


@family("macd", "technical", {i: 26 + 9 + 2 for i in MACD_ATOMS})
def macd_atoms(df, ax):
    df = macd_lines(df, ax, 12, 26, 9)
    df = df.withColumn("_hist", F.col("dif") - F.col("dea"))
    df = df.withColumns({"_hist_was": ax.lag("_hist"), "_dif_was": ax.lag("dif")})
    h, h0, d, d0 = F.col("_hist"), F.col("_hist_was"), F.col("dif"), F.col("_dif_was")
    return df, {
        "macd_golden_cross": (h0 <= 0) & (h > 0),
        "macd_death_cross": (h0 >= 0) & (h < 0),
        "macd_above_zero": (d0 <= 0) & (d > 0),
        "macd_below_zero": (d0 >= 0) & (d < 0),
        "macd_hist_turn_positive": (h0 < 0) & (h > 0),
    }


def simple_rsi(df: DataFrame, ax: Axis, period: int, out: str) -> DataFrame:
    """RSI over plain means of gains and losses; a zero loss counts as 1e-9."""
    df = df.withColumn("_d", F.col("close") - ax.lag("close"))
    # greatest() skips NULLs, so the first row has to stay unknown explicitly
    seen = F.col("_d").isNotNull()
    df = df.withColumns(
        {"_g": F.when(seen, F.greatest("_d", F.lit(0.0))), "_l": F.when(seen, F.greatest(-F.col("_d"), F.lit(0.0)))}
    )
    df = df.withColumns({"_ag": ax.mean("_g", period), "_al": ax.mean("_l", period)})
    al = F.when(F.col("_al") == 0, 1e-9).otherwise(F.col("_al"))
    return df.withColumn(out, 100 - 100 / (1 + F.col("_ag") / al)).drop("_d", "_g", "_l", "_ag", "_al")


RSI_ATOMS = ("rsi_oversold_recover_30", "rsi_oversold_recover_20", "rsi_overbought_decline_70",
             "rsi_overbought_decline_80", "rsi_below_30", "rsi_above_70")


@family("rsi", "technical", {i: 14 + 2 for i in RSI_ATOMS})
def rsi_atoms(df, ax):
    df = simple_rsi(df, ax, 14, "_rsi")
    df = df.withColumn("_rsi_was", ax.lag("_rsi"))
    r, r0 = F.col("_rsi"), F.col("_rsi_was")
    return df, {
        "rsi_oversold_recover_30": (r0 < 30) & (r >= 30),
        "rsi_oversold_recover_20": (r0 < 20) & (r >= 20),
        "rsi_overbought_decline_70": (r0 > 70) & (r <= 70),
        "rsi_overbought_decline_80": (r0 > 80) & (r <= 80),
        "rsi_below_30": r < 30,
        "rsi_above_70": r > 70,
    }


KDJ_ATOMS = ("kdj_golden_cross_low", "kdj_death_cross_high", "kdj_j_above_100", "kdj_j_below_0")


@family("kdj", "technical", {i: 9 + 15 for i in KDJ_ATOMS})
def kdj_atoms(df, ax):
    df = df.withColumns({"_ll": ax.rolling(F.min, "low", 9), "_hh": ax.rolling(F.max, "high", 9)})
    span = F.col("_hh") - F.col("_ll")
    df = df.withColumn("_raw", F.when(span != 0, (F.col("close") - F.col("_ll")) / span * 100))
    df = df.withColumn("_rsv", F.coalesce(F.last("_raw", ignorenulls=True).over(ax.so_far()), F.lit(50.0)))
    df = discounted_sums(df, ax, {"_k": (ema_impulse(F.col("_rsv"), 1 / 3, "rn"), 2 / 3)}, "rn")
    df = discounted_sums(df, ax, {"_d": (ema_impulse(F.col("_k"), 1 / 3, "rn"), 2 / 3)}, "rn")
    df = df.withColumn("_kd", F.col("_k") - F.col("_d"))
    df = df.withColumn("_kd_was", ax.lag("_kd"))
    k, g, g0 = F.col("_k"), F.col("_kd"), F.col("_kd_was")
    j = 3 * k - 2 * F.col("_d")
    return df, {
        "kdj_golden_cross_low": (g0 <= 0) & (g > 0) & (k < 30),
        "kdj_death_cross_high": (g0 >= 0) & (g < 0) & (k > 70),
        "kdj_j_above_100": j > 100,
        "kdj_j_below_0": j < 0,
    }


def bands(df: DataFrame, ax: Axis, period: int, multiplier: float) -> DataFrame:
    df = df.withColumns({"_mid": ax.mean("close", period), "_sd": ax.rolling(F.stddev_pop, "close", period)})
    return df.withColumns(
        {"_up": F.col("_mid") + multiplier * F.col("_sd"), "_low": F.col("_mid") - multiplier * F.col("_sd")}
    )


BAND_ATOMS = ("bollinger_lower_touch", "bollinger_upper_touch", "bollinger_lower_break", "bollinger_upper_break")


@family("bollinger", "technical", {**{i: 20 + 1 for i in BAND_ATOMS}, "bollinger_squeeze": 20 + 120})
def bollinger_atoms(df, ax):
    df = bands(df, ax, 20, 2.0)
    df = df.withColumn("_bw", F.when(F.col("_mid") != 0, (F.col("_up") - F.col("_low")) / F.col("_mid")))
    df = df.withColumn("_bw_min", ax.rolling(F.min, "_bw", 120))
    c = F.col("close")
    return df, {
        "bollinger_lower_touch": c <= F.col("_low") + 1e-9,
        "bollinger_upper_touch": c >= F.col("_up") - 1e-9,
        "bollinger_lower_break": c < F.col("_low"),
        "bollinger_upper_break": c > F.col("_up"),
        "bollinger_squeeze": F.col("_bw") <= F.col("_bw_min"),
    }


# ---- price action -----------------------------------------------------------------

EXTREMES = (5, 10, 20, 60, 120)


@family("extremes", "price_action", {f"new_{w}_{n}d": n + 1 for w in ("high", "low") for n in EXTREMES})
def extremes(df, ax):
    df = df.withColumns({f"_max{n}": ax.prior(F.max, "close", n) for n in EXTREMES})
    df = df.withColumns({f"_min{n}": ax.prior(F.min, "close", n) for n in EXTREMES})
    out = {f"new_high_{n}d": F.col("close") > F.col(f"_max{n}") for n in EXTREMES}
    return df, out | {f"new_low_{n}d": F.col("close") < F.col(f"_min{n}") for n in EXTREMES}


@family("alltime", "price_action", {"new_high_alltime": 250})
def alltime(df, ax):
    df = df.withColumn("_peak", F.max("close").over(ax.so_far(-1)))
    return df, {"new_high_alltime": F.col("close") > F.col("_peak")}


def change_pct(df: DataFrame, ax: Axis) -> DataFrame:
    return df if "_chg" in df.columns else df.withColumn("_chg", (F.col("close") / ax.lag("close") - 1) * 100)


@family("limits", "price_action", {"limit_up": 2, "limit_down": 2})
def limits(df, ax):
    df = change_pct(df, ax)
    return df, {
        "limit_up": is_limit_up(F.col("_chg"), F.col("stock_code")),
        "limit_down": is_limit_down(F.col("_chg"), F.col("stock_code")),
    }


MOVES = (3, 5, 7)


@family("single_day", "price_action", {f"single_day_{w}_{n}": 2 for w in ("up", "down") for n in MOVES})
def single_day(df, ax):
    df = change_pct(df, ax)
    out = {f"single_day_up_{n}": F.col("_chg") >= n for n in MOVES}
    return df, out | {f"single_day_down_{n}": F.col("_chg") <= -n for n in MOVES}


@family("runs", "price_action", {"consecutive_up_2": 3, "consecutive_up_3": 4, "consecutive_up_5": 6, "consecutive_down_3": 4})
def runs(df, ax):
    was = ax.lag("close")
    df = df.withColumns(
        {
            "_rose": F.coalesce(F.col("close") > was, F.lit(False)).cast("int"),
            "_fell": F.coalesce(F.col("close") < was, F.lit(False)).cast("int"),
        }
    )
    df = df.withColumns({f"_rose{n}": ax.rolling(F.sum, "_rose", n) for n in (2, 3, 5)})
    df = df.withColumn("_fell3", ax.rolling(F.sum, "_fell", 3))
    out = {f"consecutive_up_{n}": F.col(f"_rose{n}") >= n for n in (2, 3, 5)}
    return df, out | {"consecutive_down_3": F.col("_fell3") >= 3}


@family("gaps", "price_action", {"gap_up": 2, "gap_down": 2})
def gaps(df, ax):
    df = df.withColumns({"_ph": ax.lag("high"), "_pl": ax.lag("low")})
    return df, {"gap_up": F.col("open") > F.col("_ph"), "gap_down": F.col("open") < F.col("_pl")}


CANDLES = ("doji", "hammer", "inverted_hammer", "long_upper_shadow", "long_lower_shadow")


@family("candles", "price_action", {i: 1 for i in CANDLES})
def candles(df, ax):
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body, span = F.abs(c - o), h - l
    upper, lower = h - F.greatest(o, c), F.least(o, c) - l
    return df, {
        "doji": (span > 0) & (F.try_divide(body, span) < 0.1),
        "hammer": (span > 0) & (lower >= 2 * body) & (upper <= body),
        "inverted_hammer": (span > 0) & (upper >= 2 * body) & (lower <= body),
        "long_upper_shadow": (body > 0) & (upper >= 2 * body),
        "long_lower_shadow": (body > 0) & (lower >= 2 * body),
    }


@family("one_word", "price_action", {"one_word_limit": 2})
def one_word(df, ax):
    df = change_pct(df, ax)
    flat = F.try_divide(F.col("high") - F.col("low"), F.col("close")) < 0.005
    return df, {"one_word_limit": flat & is_limit_up(F.col("_chg"), F.col("stock_code"))}


# ---- volume -----------------------------------------------------------------------


def _volume_mean(df: DataFrame, ax: Axis) -> DataFrame:
    return df if "_vma20" in df.columns else df.withColumn("_vma20", ax.mean("volume", 20))


@family("volume_multiple", "volume",
        {"volume_2x_ma20": 21, "volume_3x_ma20": 21, "volume_5x_ma20": 21, "volume_below_half_ma20": 21})
def volume_multiple(df, ax):
    df = _volume_mean(df, ax)
    v, m = F.col("volume"), F.col("_vma20")
    return df, {**{f"volume_{n}x_ma20": v >= m * float(n) for n in (2, 3, 5)}, "volume_below_half_ma20": v < m * 0.5}


@family("volume_max", "volume", {"volume_max_60d": 60})
def volume_max(df, ax):
    df = df.withColumn("_vmax", ax.prior(F.max, "volume", 59))
    return df, {"volume_max_60d": F.col("volume") >= F.col("_vmax")}


@family("volume_price", "volume",
        {i: 21 for i in ("vol_up_price_up", "vol_up_price_down", "vol_down_price_up", "vol_down_price_down")})
def volume_price(df, ax):
    df = _volume_mean(df, ax).withColumn("_pc", ax.lag("close"))
    more, less = F.col("volume") > F.col("_vma20") * 1.2, F.col("volume") < F.col("_vma20") * 0.8
    rose, fell = F.col("close") > F.col("_pc"), F.col("close") < F.col("_pc")
    return df, {"vol_up_price_up": more & rose, "vol_up_price_down": more & fell,
                "vol_down_price_up": less & rose, "vol_down_price_down": less & fell}


@family("turnover", "volume", {"turnover_above_5": 1, "turnover_above_10": 1, "turnover_below_1": 1})
def turnover(df, ax):
    t = F.col("turnover_rate") if "turnover_rate" in df.columns else F.lit(None).cast("double")
    return df, {"turnover_above_5": t > 5, "turnover_above_10": t > 10, "turnover_below_1": t < 1}


# ---- fundamental ------------------------------------------------------------------


def pe_below_history(df: DataFrame, ax: Axis, percentiles: tuple[int, ...], lookback: int) -> tuple[DataFrame, dict]:
    """PE under its own rolling percentile, linearly interpolated. The frame is bounded by ``lookback`` rows.

    The value is one of its frame, so its rank alone tells: of n values with e at or below it, the p-th percentile stands at k = p (n - 1) / 100.
    It is above the value if e is k at most, or if k is no whole number and the value is the last one before it. No percentile is formed.
    """
    frame = ax.frame(-(lookback - 1), 0)
    df = df.withColumn("_pe", F.last("pe_ttm", ignorenulls=True).over(ax.so_far()))
    df = df.withColumn("_seen", F.collect_list("_pe").over(frame))
    rank = F.size(F.filter("_seen", lambda y: y <= F.col("_pe")))
    df = df.withColumns({"_pe_n": F.size("_seen"), "_pe_rank": rank}).drop("_seen")
    ready = (F.col("_pe") > 0) & (F.col("_pe_n") >= lookback // 2)
    at = lambda p: F.lit(p) * (F.col("_pe_n") - 1)  # noqa: E731  k in hundredths
    return df, {f"pe_below_history_{p}pct": ready & (100 * (F.col("_pe_rank") - 1) < at(p)) for p in percentiles}


@family("pe_history", "fundamental", {"pe_below_history_10pct": 625, "pe_below_history_30pct": 625}, ("ohlcv", "valuation"))
def pe_history(df, ax):
    return pe_below_history(df, ax, (10, 30), 1250)


# Which atom closes a position opened by which.
REVERSE_OF = {
    "macd_golden_cross": "macd_death_cross",
    "macd_above_zero": "macd_below_zero",
    "macd_hist_turn_positive": "macd_death_cross",
    "rsi_oversold_recover_30": "rsi_overbought_decline_70",
    "rsi_oversold_recover_20": "rsi_overbought_decline_80",
    "rsi_below_30": "rsi_above_70",
    "bollinger_lower_touch": "bollinger_upper_touch",
    "bollinger_lower_break": "bollinger_upper_break",
    **{f"ma_{f}_cross_up_{s}": f"ma_{f}_cross_down_{s}" for f, s in ((5, 10), (5, 20), (10, 20), (60, 250))},
    **{f"close_above_ma_{n}": f"close_below_ma_{n}" for n in MA_LEVELS},
    **{f"new_high_{n}d": f"new_low_{n}d" for n in EXTREMES},
    "limit_up": "limit_down",
    **{f"single_day_up_{n}": f"single_day_down_{n}" for n in MOVES},
    "consecutive_up_3": "consecutive_down_3",
    "gap_up": "gap_down",
}
