"""Published signal atoms and strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import DAILY
from tidemark.operators import atoms as A
from tidemark.operators.strategies import STRATEGIES, signals
from tidemark.plans.indicators import MACD_CTES
from tidemark.plans.registry import query
from tidemark.plans.sql import BARS, NUMBERED, frame, lag, prior, recur, roll
from tidemark.sources.market import bars_by_instrument, bars_daily, listed_code, series_parts, valuation

CODE = "['600', '300', '688', '830'][instrument % 4 + 1] || lpad(CAST(instrument AS VARCHAR), greatest(3, length(CAST(instrument AS VARCHAR)))::INTEGER, '0')"
LIMIT = f"CASE WHEN substr({CODE}, 1, 3) IN ('300', '688') THEN 19.6 WHEN substr({CODE}, 1, 2) = '83' THEN 29.4 ELSE 9.8 END"
BASE = f"WITH RECURSIVE {BARS}, {NUMBERED}"


def coded_bars(spark, folder):
    return bars_by_instrument(spark, folder).withColumns(
        {"stock_code": listed_code(), "turnover_rate": F.col("volume") / 10}
    )


def publish(name: str, ids: list[str], exprs: dict[str, str], ctes: str = "", stage: str = "v") -> None:
    cols = ", ".join(
        f"CAST(rn > {A.ATOMS[i].warmup} AND coalesce({exprs[i]}, false) AS INT) AS {i}" for i in ids
    )
    sql = f"{BASE}{', ' + ctes if ctes else ''} SELECT instrument, session_date, {cols} FROM {stage}"

    @query(name, sql)
    def plan(spark, folder):
        return A.with_atoms(coded_bars(spark, folder), ids).select("instrument", "session_date", *ids)


def _gap(f, s):
    return f"(({roll('avg', 'close', f)}) - ({roll('avg', 'close', s)}))"


def _cross_family(pairs, word, a, b):
    ids = [f"ma_{f}_cross_{word}_{s}" for f, s in pairs]
    stage = "g AS (SELECT *, " + ", ".join(f"{_gap(f, s)} AS g_{f}_{s}" for f, s in pairs) + " FROM v)"
    return ids, {f"ma_{f}_cross_{word}_{s}": f"{lag(f'g_{f}_{s}')} {a} 0 AND g_{f}_{s} {b} 0" for f, s in pairs}, stage, "g"


publish("t01_ma_cross_up", *_cross_family(A.UP_PAIRS, "up", "<=", ">"))
publish("t02_ma_cross_down", *_cross_family(A.DOWN_PAIRS, "down", ">=", "<"))
publish("t03_close_vs_ma", [f"close_{w}_ma_{n}" for w in ("above", "below") for n in A.MA_LEVELS],
        {f"close_{w}_ma_{n}": f"close {o} ({roll('avg', 'close', n)})"
         for w, o in (("above", ">"), ("below", "<")) for n in A.MA_LEVELS})
_H = "(dif0 - dea0)"
publish("t04_macd", list(A.MACD_ATOMS), {
    "macd_golden_cross": f"{lag(_H)} <= 0 AND {_H} > 0", "macd_death_cross": f"{lag(_H)} >= 0 AND {_H} < 0",
    "macd_above_zero": f"{lag('dif0')} <= 0 AND dif0 > 0", "macd_below_zero": f"{lag('dif0')} >= 0 AND dif0 < 0",
    "macd_hist_turn_positive": f"{lag(_H)} < 0 AND {_H} > 0"}, MACD_CTES, "md")


def simple_rsi_sql(n: int = 14) -> str:
    return f"""ch AS (SELECT *, close - {lag('close')} AS chg FROM v),
gl AS (SELECT *, CASE WHEN chg IS NOT NULL THEN greatest(chg, 0.0) END AS up, CASE WHEN chg IS NOT NULL THEN greatest(-chg, 0.0) END AS dn FROM ch),
sm AS (SELECT *, {roll('avg', 'up', n)} AS su, {roll('avg', 'dn', n)} AS sn FROM gl),
rx AS (SELECT *, 100 - 100 / (1 + su / CASE WHEN sn = 0 THEN 1e-9 ELSE sn END) AS rsi FROM sm)"""


_R0 = lag("rsi")
publish("t05_rsi", list(A.RSI_ATOMS), {
    "rsi_oversold_recover_30": f"{_R0} < 30 AND rsi >= 30", "rsi_oversold_recover_20": f"{_R0} < 20 AND rsi >= 20",
    "rsi_overbought_decline_70": f"{_R0} > 70 AND rsi <= 70", "rsi_overbought_decline_80": f"{_R0} > 80 AND rsi <= 80",
    "rsi_below_30": "rsi < 30", "rsi_above_70": "rsi > 70"}, simple_rsi_sql(), "rx")
KDJ_SQL = f"""f AS (SELECT *, {roll('min', 'low', 9)} AS lo, {roll('max', 'high', 9)} AS hi FROM v),
r0 AS (SELECT *, CASE WHEN hi <> lo THEN (close - lo) / (hi - lo) * 100 END AS raw FROM f),
rs AS (SELECT *, coalesce(last_value(raw IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY session_date), 50.0) AS rsv FROM r0),
{recur('kk', 'rs', 's.rsv', 'r.y + (s.rsv - r.y) / 3')},
rk AS (SELECT rs.*, kk.y AS k FROM rs JOIN kk USING (instrument, rn)),
{recur('dd', 'rk', 's.k', 'r.y + (s.k - r.y) / 3')},
kd AS (SELECT rk.*, dd.y AS d FROM rk JOIN dd USING (instrument, rn))"""
publish("t06_kdj", list(A.KDJ_ATOMS), {
    "kdj_golden_cross_low": f"{lag('(k - d)')} <= 0 AND k - d > 0 AND k < 30",
    "kdj_death_cross_high": f"{lag('(k - d)')} >= 0 AND k - d < 0 AND k > 70",
    "kdj_j_above_100": "3 * k - 2 * d > 100", "kdj_j_below_0": "3 * k - 2 * d < 0"}, KDJ_SQL, "kd")
BAND_SQL = f"""bb AS (SELECT *, {roll('avg', 'close', 20)} AS mid, {roll('stddev_pop', 'close', 20)} AS sd FROM v),
bw AS (SELECT *, mid + 2 * sd AS up, mid - 2 * sd AS lo, ((mid + 2 * sd) - (mid - 2 * sd)) / mid AS bw FROM bb)"""
publish("t07_bollinger", [*A.BAND_ATOMS, "bollinger_squeeze"], {
    "bollinger_lower_touch": "close <= lo + 1e-9", "bollinger_upper_touch": "close >= up - 1e-9",
    "bollinger_lower_break": "close < lo", "bollinger_upper_break": "close > up",
    "bollinger_squeeze": f"bw <= ({roll('min', 'bw', 120)})"}, BAND_SQL, "bw")

publish("b01_new_extremes", [f"new_{w}_{n}d" for w in ("high", "low") for n in A.EXTREMES],
        {f"new_high_{n}d": f"close > ({prior('max', 'close', n)})" for n in A.EXTREMES}
        | {f"new_low_{n}d": f"close < ({prior('min', 'close', n)})" for n in A.EXTREMES})
publish("b02_new_high_alltime", ["new_high_alltime"], {
    "new_high_alltime": "close > max(close) OVER (PARTITION BY instrument ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"})
CHG = f"((close / {lag('close')} - 1) * 100)"
publish("b03_limits", ["limit_up", "limit_down"], {"limit_up": f"{CHG} >= {LIMIT}", "limit_down": f"{CHG} <= -({LIMIT})"})
publish("b04_single_day", [f"single_day_{w}_{n}" for w in ("up", "down") for n in A.MOVES],
        {f"single_day_up_{n}": f"{CHG} >= {n}" for n in A.MOVES} | {f"single_day_down_{n}": f"{CHG} <= -{n}" for n in A.MOVES})
_up1, _dn1 = "coalesce(CAST(close > pc AS INT), 0)", "coalesce(CAST(close < pc AS INT), 0)"
publish("b05_consecutive", ["consecutive_up_2", "consecutive_up_3", "consecutive_up_5", "consecutive_down_3"],
        {f"consecutive_up_{n}": f"({roll('sum', _up1, n)}) >= {n}" for n in (2, 3, 5)}
        | {"consecutive_down_3": f"({roll('sum', _dn1, 3)}) >= 3"},
        f"pc AS (SELECT *, {lag('close')} AS pc FROM v)", "pc")
publish("b06_gaps", ["gap_up", "gap_down"], {"gap_up": f"open > {lag('high')}", "gap_down": f"open < {lag('low')}"})
_body, _upper, _lower = "abs(close - open)", "(high - greatest(open, close))", "(least(open, close) - low)"
publish("b07_candles", list(A.CANDLES), {
    "doji": f"high > low AND {_body} / nullif(high - low, 0) < 0.1",
    "hammer": f"high > low AND {_lower} >= 2 * {_body} AND {_upper} <= {_body}",
    "inverted_hammer": f"high > low AND {_upper} >= 2 * {_body} AND {_lower} <= {_body}",
    "long_upper_shadow": f"{_body} > 0 AND {_upper} >= 2 * {_body}",
    "long_lower_shadow": f"{_body} > 0 AND {_lower} >= 2 * {_body}"})
publish("b08_one_word_limit", ["one_word_limit"], {"one_word_limit": f"(high - low) / close < 0.005 AND {CHG} >= {LIMIT}"})
_vm = f"({roll('avg', 'volume', 20)})"
publish("v01_volume_multiple", ["volume_2x_ma20", "volume_3x_ma20", "volume_5x_ma20", "volume_below_half_ma20"],
        {f"volume_{n}x_ma20": f"volume >= {_vm} * {n}" for n in (2, 3, 5)} | {"volume_below_half_ma20": f"volume < {_vm} * 0.5"})
publish("v02_volume_max", ["volume_max_60d"], {"volume_max_60d": f"volume >= ({prior('max', 'volume', 59)})"})
publish("v03_volume_price", ["vol_up_price_up", "vol_up_price_down", "vol_down_price_up", "vol_down_price_down"], {
    f"vol_{a}_price_{b}": f"volume {o} {_vm} * CAST({m} AS DOUBLE) AND close {p} {lag('close')}"
    for a, o, m in (("up", ">", 1.2), ("down", "<", 0.8)) for b, p in (("up", ">"), ("down", "<"))})
publish("v04_turnover", ["turnover_above_5", "turnover_above_10", "turnover_below_1"],
        {"turnover_above_5": "volume / 10 > 5", "turnover_above_10": "volume / 10 > 10", "turnover_below_1": "volume / 10 < 1"})

VALUATION = """val AS (SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS session_date,
  min(p_retailprice) FILTER (WHERE l_returnflag = 'A') - 950 AS pe_ttm, max(p_retailprice) FILTER (WHERE l_returnflag = 'A') / 500 AS pb
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)"""
FFILL_PE = f"""{VALUATION},
vp AS (SELECT v.*, last_value(pe_ttm IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY session_date) AS pe
  FROM v LEFT JOIN val USING (instrument, session_date))"""
_FR = "OVER (PARTITION BY instrument ORDER BY session_date ROWS BETWEEN 249 PRECEDING AND CURRENT ROW)"
_PEQ = ", ".join(
    f"CAST(rn > 125 AND coalesce(pe > 0 AND count(pe) {_FR} >= 125 AND pe < quantile_cont(pe, {p / 100}) {_FR}, false) AS INT) AS pe_below_history_{p}pct"
    for p in (10, 30))


@query("f01_pe_history", f"{BASE}, {FFILL_PE} SELECT instrument, session_date, {_PEQ} FROM vp")
def f01(spark, folder):
    parts, day = series_parts(spark, folder), ["instrument", "session_date"]
    bars, ratios = (side.repartition(parts, *day) for side in (bars_daily(spark, folder), valuation(spark, folder)))
    bars = bars.join(ratios, day, "left").repartition(parts, "instrument")
    df, columns = A.pe_below_history(bars.withColumn("rn", DAILY.row()), DAILY, (10, 30), 250)
    return df.select("instrument", "session_date", *[
        ((F.col("rn") > 125) & F.coalesce(c, F.lit(False))).cast("int").alias(i) for i, c in columns.items()
    ])


# ---- strategies -------------------------------------------------------------------


def publish_strategy(name: str, id: str, first: tuple[str, int], second: tuple[str, int] | None = None, ctes: str = "",
                     stage: str = "v", **params) -> None:
    branches = f"WHEN {first[0]} THEN {first[1]}" + (f" WHEN {second[0]} THEN {second[1]}" if second else "")
    sql = f"{BASE}{', ' + ctes if ctes else ''} SELECT instrument, session_date, CASE {branches} ELSE 0 END AS signal FROM {stage}"

    @query(name, sql)
    def plan(spark, folder):
        return signals(coded_bars(spark, folder), id, **params).select("instrument", "session_date", "signal")


def _x(g: str) -> tuple[tuple[str, int], tuple[str, int]]:
    return (f"{lag(g)} <= 0 AND {g} > 0", 1), (f"{lag(g)} >= 0 AND {g} < 0", 2)


publish_strategy("g01_dual_ma", "dual_ma", *_x("g"), f"g AS (SELECT *, {_gap(5, 20)} AS g FROM v)", "g")
publish_strategy("g02_macd", "macd", *_x(_H), MACD_CTES, "md")
publish_strategy("g03_rsi", "rsi", (f"{_R0} > 70 AND rsi <= 70", 2), (f"{_R0} < 30 AND rsi >= 30", 1), simple_rsi_sql(), "rx")
G_KDJ = f"""f AS (SELECT *, {roll('min', 'low', 9)} AS lo, {roll('max', 'high', 9)} AS hi FROM v),
rs AS (SELECT *, (close - lo) / CASE WHEN hi = lo THEN 1e-9 ELSE hi - lo END * 100 AS rsv FROM f WHERE rn >= 9),
{recur('kk', 'rs', '(50.0 * 2 + s.rsv) / 3', '(r.y * 2 + s.rsv) / 3', 's.rn = 9')},
rk AS (SELECT rs.*, kk.y AS k FROM rs JOIN kk USING (instrument, rn)),
{recur('dd', 'rk', '(50.0 * 2 + s.k) / 3', '(r.y * 2 + s.k) / 3', 's.rn = 9')},
kd AS (SELECT v.*, rk.k AS k, dd.y AS d FROM v LEFT JOIN rk USING (instrument, rn) LEFT JOIN dd USING (instrument, rn))"""
publish_strategy("g04_kdj", "kdj", (f"{lag('(k - d)')} >= 0 AND k - d < 0 AND k > 70", 2),
                 (f"{lag('(k - d)')} <= 0 AND k - d > 0 AND k < 30", 1), G_KDJ, "kd")
publish_strategy("g05_bollinger", "bollinger", (f"{lag('close')} < {lag('up')} AND close >= up", 2),
                 (f"{lag('close')} > {lag('lo')} AND close <= lo", 1), BAND_SQL, "bw")
publish_strategy("g05_bollinger_breakout", "bollinger", (f"{lag('close')} >= {lag('lo')} AND close < lo", 2),
                 (f"{lag('close')} <= {lag('up')} AND close > up", 1), BAND_SQL, "bw", direction="breakout")
MA20 = f"m AS (SELECT *, {roll('avg', 'close', 20)} AS m, {_vm} AS vm FROM v)"
publish_strategy("g06_mean_reversion", "mean_reversion", ("m > 0 AND (m - close) / m >= 0.03", 1),
                 (f"{lag('close')} < {lag('m')} AND close >= m", 2), MA20, "m")
publish_strategy("g07_n_day_high", "n_day_high", (f"close < ({prior('min', 'close', 10)})", 2),
                 (f"close > ({prior('max', 'close', 20)})", 1))
publish_strategy("g08_volume_breakout", "volume_breakout", (f"{lag('close')} >= {lag('m')} AND close < m", 2),
                 (f"{lag('close')} <= {lag('m')} AND close > m AND vm > 0 AND volume >= vm * 1.5", 1), MA20, "m")
_ms = {n: f"({roll('avg', 'close', n)})" for n in (5, 10, 20, 60)}
STACK = f"""st AS (SELECT *, coalesce({_ms[5]} > {_ms[20]} AND {_ms[20]} > {_ms[60]} AND {_ms[5]} > {_ms[10]} AND {_ms[10]} > {_ms[20]}, false) AS st FROM v),
s2 AS (SELECT *, coalesce({lag('st')}, false) AS st0 FROM st)"""
publish_strategy("g09_ma_stack", "ma_stack", ("NOT st0 AND st", 1), ("st0 AND NOT st", 2), STACK, "s2")
publish_strategy("g10_trend_oversold", "trend_oversold", (f"close > m60 AND {_R0} < 40 AND rsi >= 40", 1),
                 (f"{_R0} > 70 AND rsi <= 70", 2),
                 simple_rsi_sql() + f", rm AS (SELECT *, {roll('avg', 'close', 60)} AS m60 FROM rx)", "rm")
publish_strategy("g11_dual_confirm", "dual_confirm", (f"{lag(_H)} <= 0 AND {_H} > 0 AND close > m20", 1),
                 (f"{lag(_H)} >= 0 AND {_H} < 0", 2), MACD_CTES + f", mm AS (SELECT *, {roll('avg', 'close', 20)} AS m20 FROM md)", "mm")
LB = f"""lc AS (SELECT *, {CHG} AS chg, {LIMIT} AS lim FROM v), lu AS (SELECT *, coalesce(chg >= lim, false) AS up FROM lc)"""
publish_strategy("g12_limit_board", "limit_board", (f"chg < lim AND {lag('up')} AND {lag('up', 2)}", 1), None, LB, "lu")
publish_strategy("g13_always_hold", "always_hold", ("true", 1))
assert len(STRATEGIES) == 13 and len(A.ATOMS) == 85
_ = frame
