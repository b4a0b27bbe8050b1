"""Published studies: every line and trigger on every instrument and session."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.indicators import CATALOG, evaluate
from tidemark.plans.registry import query
from tidemark.plans.sql import SUSP, cross, frame, lag, prior, recur, roll
from tidemark.sources.market import bars_suspended

TEXT_LINES = {"regime"}


def _threshold_sql(line: str, value: float, six: bool = False) -> dict[str, str]:
    v = repr(float(value))
    out = {
        "crosses_above": cross(line, v, True, const=True),
        "crosses_below": cross(line, v, False, const=True),
        "above": f"{line} > {v}",
        "below": f"{line} < {v}",
    }
    if six:
        out |= {"at_least": f"{line} >= {v}", "at_most": f"{line} <= {v}"}
    return out


def _lines_sql(l: str, r: str, names: tuple[str, str, str, str]) -> dict[str, str]:
    return {names[0]: cross(l, r, True), names[1]: cross(l, r, False), names[2]: f"{l} > {r}", names[3]: f"{l} < {r}"}


PRICE = ("price_crosses_above", "price_crosses_below", "price_above", "price_below")


def publish(name: str, id: str, lines: dict[str, str] | None, triggers: dict[str, str], value: float | None = None,
            ctes: str = "", stage: str | None = None, prepare=None, base: str = SUSP, nudge: float = 0.0) -> None:
    """Register one study. ``lines`` are SQL expressions over ``v`` (or over CTE ``stage``).

    ``nudge`` moves values off exact rounding halves, which two engines may round apart."""
    s = CATALOG[id]
    src = stage or "v"
    lines = lines if lines is not None else {c: c for c in s.lines}
    shown = ", ".join(f"{c} AS {c}" if c in TEXT_LINES else f"round(t.{c} + {nudge}, 4) AS {c}" for c in s.lines)
    trig = ", ".join(f"{sql} AS {t}" for t, sql in triggers.items())
    sql = f"""WITH RECURSIVE {base}{', ' + ctes if ctes else ''},
s AS (SELECT {src}.*, {', '.join(f'{e} AS {c}' for c, e in lines.items()) if lines else '1 AS one'} FROM {src}),
t AS (SELECT instrument, session_date, {', '.join(s.lines)}, {trig} FROM s)
SELECT b.instrument, b.session_date, {shown}, {', '.join('t.' + t for t in triggers)}
FROM susp b LEFT JOIN t ON t.instrument = b.instrument AND t.session_date = b.session_date"""

    @query(name, sql)
    def plan(spark, folder):
        bars = bars_suspended(spark, folder)
        if prepare:
            bars = prepare(bars)
        out = evaluate(bars, id, value=value)
        return out.select(
            "instrument",
            "session_date",
            *[F.col(c) if c in TEXT_LINES else F.round(F.col(c) + nudge, 4).alias(c) for c in s.lines],
            *s.triggers,
        )


publish("i01_ma", "technical.ma", {"ma": roll("avg", "close", 20)}, _lines_sql("close", "ma", PRICE))

EMA28 = recur("e", "v", "s.close", "r.y + 2.0/29 * (s.close - r.y)")
WITH_EMA = EMA28 + ", es AS (SELECT v.*, CASE WHEN v.rn >= 28 THEN e.y END AS ema FROM v JOIN e USING (instrument, rn))"
publish("i02_ema", "technical.ema", {}, _lines_sql("close", "ema", PRICE), ctes=WITH_EMA, stage="es")

publish("i03_ma_cross", "technical.ma_cross",
        {"fast": f"CASE WHEN rn >= 20 THEN {roll('avg', 'close', 5)} END", "slow": roll("avg", "close", 20)},
        _lines_sql("fast", "slow", ("golden_cross", "death_cross", "fast_above_slow", "fast_below_slow")))

_mid, _sd = roll("avg", "close", 20), roll("stddev_pop", "close", 20)
_bands = {}
for _b in ("upper", "middle", "lower"):
    _bands[f"price_crosses_above_{_b}"] = cross("close", _b, True)
    _bands[f"price_crosses_below_{_b}"] = cross("close", _b, False)
publish("i04_bollinger", "technical.bollinger",
        {"middle": _mid, "upper": f"({_mid}) + 2 * ({_sd})", "lower": f"({_mid}) - 2 * ({_sd})"}, _bands)

KDJ = f"""f AS (SELECT *, {roll('min', 'low', 9)} AS lo, {roll('max', 'high', 9)} AS hi FROM v),
rs AS (SELECT *, CASE WHEN hi = lo THEN 50.0 ELSE (close - lo) / (hi - lo) * 100 END AS rsv FROM f WHERE rn >= 9),
{recur('kk', 'rs', '(50.0 * 2 + s.rsv) / 3', '(r.y * 2 + s.rsv) / 3', 's.rn = 9')},
rk AS (SELECT rs.*, kk.y AS k FROM rs JOIN kk USING (instrument, rn)),
{recur('dd', 'rk', '(50.0 * 2 + s.k) / 3', '(r.y * 2 + s.k) / 3', 's.rn = 9')},
kd AS (SELECT rk.*, dd.y AS d, 3 * rk.k - 2 * dd.y AS j FROM rk JOIN dd USING (instrument, rn))"""
publish("i05_kdj", "technical.kdj", {},
        {"golden_cross": cross("k", "d", True), "death_cross": cross("k", "d", False), "j_above": "j > 90.0",
         "j_below": "j < 90.0"}, value=90.0, ctes=KDJ, stage="kd")

CCI = f"""tp AS (SELECT *, (high + low + close) / 3 AS tp FROM v),
mm AS (SELECT *, {roll('avg', 'tp', 14)} AS m,
  list(tp) OVER (PARTITION BY instrument ORDER BY session_date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS xs FROM tp),
cc AS (SELECT *, list_sum(list_transform(xs, lambda x: abs(x - m))) / 14 AS mad FROM mm),
c2 AS (SELECT *, CASE WHEN m IS NOT NULL THEN CASE WHEN mad = 0 THEN 0.0 ELSE (tp - m) / (0.015 * mad) END END AS cci FROM cc)"""
publish("i06_cci", "technical.cci", {}, _threshold_sql("cci", 100), value=100.0, ctes=CCI, stage="c2")

publish("i07_bbi", "technical.bbi",
        {"bbi": "(" + " + ".join(f"({roll('avg', 'close', n)})" for n in (3, 6, 12, 24)) + ") / 4"},
        _lines_sql("close", "bbi", PRICE), nudge=0.00003)

publish("i08_ema_bias", "technical.ema_bias", {"ema_bias": "(close / ema - 1) * 100"}, _threshold_sql("ema_bias", 5),
        value=5.0, ctes=WITH_EMA, stage="es")

MACD_CTES = f"""{recur('ef', 'v', 's.close', 'r.y + 2.0/13 * (s.close - r.y)')},
{recur('es', 'v', 's.close', 'r.y + 2.0/27 * (s.close - r.y)')},
df AS (SELECT v.*, ef.y - es.y AS dif0 FROM v JOIN ef USING (instrument, rn) JOIN es USING (instrument, rn)),
{recur('de', 'df', 's.dif0', 'r.y + 2.0/10 * (s.dif0 - r.y)')},
md AS (SELECT df.*, de.y AS dea0 FROM df JOIN de USING (instrument, rn))"""
publish("i09_macd", "technical.macd",
        {"dif": "CASE WHEN rn >= 34 THEN dif0 END", "dea": "CASE WHEN rn >= 34 THEN dea0 END",
         "hist": "CASE WHEN rn >= 34 THEN 2 * (dif0 - dea0) END"},
        {"golden_cross": cross("dif", "dea", True), "death_cross": cross("dif", "dea", False),
         "crosses_above_zero": cross("dif", "0.0", True, True), "crosses_below_zero": cross("dif", "0.0", False, True)},
        ctes=MACD_CTES, stage="md")

RSI_CTES = f"""ch AS (SELECT *, close - {lag('close')} AS chg FROM v),
gl AS (SELECT *, greatest(chg, 0.0) AS up, greatest(-chg, 0.0) AS dn FROM ch WHERE chg IS NOT NULL),
sd AS (SELECT *, {roll('avg', 'up', 14)} AS su, {roll('avg', 'dn', 14)} AS sn FROM gl),
{recur('ag', 'sd', 's.su', '(r.y * 13 + s.up) / 14', 's.rn = 15')},
{recur('al', 'sd', 's.sn', '(r.y * 13 + s.dn) / 14', 's.rn = 15')},
rsx AS (SELECT v.*, CASE WHEN ag.y = 0 AND al.y = 0 THEN 50.0 WHEN al.y = 0 THEN 100.0 WHEN ag.y = 0 THEN 0.0
  ELSE 100 - 100 / (1 + ag.y / al.y) END AS rsi FROM v LEFT JOIN ag USING (instrument, rn) LEFT JOIN al USING (instrument, rn)),
rsy AS (SELECT * REPLACE (CASE WHEN rn >= 15 THEN rsi END AS rsi) FROM rsx)"""
publish("i10_rsi", "technical.rsi", {}, _threshold_sql("rsi", 50), value=50.0, ctes=RSI_CTES, stage="rsy")

OBV_CTES = f"""pc AS (SELECT *, {lag('close')} AS pc FROM v),
ob AS (SELECT *, sum(CASE WHEN pc IS NULL OR close > pc THEN volume WHEN close < pc THEN -volume ELSE 0 END)
  OVER (PARTITION BY instrument ORDER BY session_date) AS obv FROM pc)"""
publish("i11_obv", "technical.obv", {}, {"rising": f"obv > {lag('obv')}", "falling": f"obv < {lag('obv')}"},
        ctes=OBV_CTES, stage="ob")

TR_CTES = f"""pc AS (SELECT *, {lag('close')} AS pc FROM v),
tr AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM pc)"""
ATR_CTES = f"""{TR_CTES},
ts AS (SELECT *, {roll('avg', 'tr', 14)} AS seed FROM tr),
{recur('ar', 'ts', 's.seed', '(r.y * 13 + s.tr) / 14', 's.rn = 15')},
ax AS (SELECT tr.*, ar.y AS atr FROM tr LEFT JOIN ar USING (instrument, rn))"""
publish("i12_atr", "technical.atr", {}, _threshold_sql("atr", 30000), value=30000.0, ctes=ATR_CTES, stage="ax")
publish("i13_natr", "technical.natr", {"natr": "100 * atr / close"}, _threshold_sql("natr", 150), value=150.0,
        ctes=ATR_CTES, stage="ax")

_S = "s.instrument, s.rn"
DMI_CTES = f"""{TR_CTES},
mv AS (SELECT *, high - {lag('high')} AS um, {lag('low')} - low AS dm FROM tr),
dx0 AS (SELECT *, CASE WHEN um > dm AND um > 0 THEN um ELSE 0 END AS pdm,
  CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0 END AS mdm FROM mv WHERE um IS NOT NULL),
dx1 AS (SELECT *, {roll('sum', 'tr', 14)} AS s1, {roll('sum', 'pdm', 14)} AS s2, {roll('sum', 'mdm', 14)} AS s3 FROM dx0),
{recur('r1', 'dx1', 's.s1', 'r.y - r.y / 14 + s.tr', 's.rn = 15')},
{recur('r2', 'dx1', 's.s2', 'r.y - r.y / 14 + s.pdm', 's.rn = 15')},
{recur('r3', 'dx1', 's.s3', 'r.y - r.y / 14 + s.mdm', 's.rn = 15')},
di AS (SELECT dx1.*, CASE WHEN r1.y = 0 THEN 0.0 ELSE 100 * r2.y / r1.y END AS pdi,
  CASE WHEN r1.y = 0 THEN 0.0 ELSE 100 * r3.y / r1.y END AS mdi
  FROM dx1 JOIN r1 USING (instrument, rn) JOIN r2 USING (instrument, rn) JOIN r3 USING (instrument, rn)),
dx AS (SELECT *, CASE WHEN pdi + mdi = 0 THEN 0.0 ELSE 100 * abs(pdi - mdi) / (pdi + mdi) END AS dx FROM di),
dy AS (SELECT *, {roll('avg', 'dx', 14)} AS seed FROM dx),
{recur('ra', 'dy', 's.seed', '(r.y * 13 + s.dx) / 14', 's.rn = 28')},
dz AS (SELECT v.*, ra.y AS adx, CASE WHEN v.rn >= 28 THEN dy.pdi END AS plus_di, CASE WHEN v.rn >= 28 THEN dy.mdi END AS minus_di
  FROM v LEFT JOIN ra USING (instrument, rn) LEFT JOIN dy USING (instrument, rn))"""
publish("i14_adx", "technical.adx", {}, _threshold_sql("adx", 15), value=15.0, ctes=DMI_CTES, stage="dz")
publish("i15_dmi", "technical.dmi", {},
        _lines_sql("plus_di", "minus_di",
                   ("plus_crosses_above_minus", "plus_crosses_below_minus", "plus_above_minus", "plus_below_minus")),
        ctes=DMI_CTES, stage="dz")

publish("i16_bias", "technical.bias", {"bias": f"(close / ({roll('avg', 'close', 20)}) - 1) * 100"},
        _threshold_sql("bias", 5), value=5.0)
publish("i17_roc", "technical.roc", {"roc": f"(close / {lag('close', 12)} - 1) * 100"}, _threshold_sql("roc", 10), value=10.0)
publish("i18_momentum", "technical.momentum", {"momentum": f"close - {lag('close', 10)}"},
        _threshold_sql("momentum", 100), value=100.0)

_span = f"(({roll('max', 'high', 14)}) - ({roll('min', 'low', 14)}))"
STOCH = f"""sk AS (SELECT *, CASE WHEN {_span} = 0 THEN 50.0
  ELSE 100 * (close - ({roll('min', 'low', 14)})) / {_span} END AS k0 FROM v),
sx AS (SELECT *, {roll('avg', 'k0', 3)} AS stoch_d FROM sk)"""
publish("i19_stochastic", "technical.stochastic", {"stoch_k": "CASE WHEN stoch_d IS NOT NULL THEN k0 END"},
        {"k_crosses_above_d": cross("stoch_k", "stoch_d", True), "k_crosses_below_d": cross("stoch_k", "stoch_d", False),
         "k_above": "stoch_k > 80.0", "k_below": "stoch_k < 80.0"}, value=80.0, ctes=STOCH, stage="sx")
publish("i20_williams_r", "technical.williams_r",
        {"williams_r": f"CASE WHEN {_span} = 0 THEN -50.0 ELSE -100 * (({roll('max', 'high', 14)}) - close) / {_span} END"},
        _threshold_sql("williams_r", -80), value=-80.0)
_up, _lo = prior("max", "high", 20), prior("min", "low", 20)
publish("i21_donchian", "technical.donchian",
        {"upper": _up, "lower": _lo, "middle": f"(({_up}) + ({_lo})) / 2"},
        {"price_crosses_above_upper": cross("close", "upper", True),
         "price_crosses_below_lower": cross("close", "lower", False),
         "price_above_upper": "close > upper", "price_below_lower": "close < lower"})
publish("i22_return_stddev", "technical.return_stddev", {"return_stddev": roll("stddev_pop", "r1", 20)},
        _threshold_sql("return_stddev", 100), value=100.0,
        ctes=f"rr AS (SELECT *, 100 * (close / {lag('close')} - 1) AS r1 FROM v)", stage="rr")
publish("i23_historical_volatility", "technical.historical_volatility",
        {"historical_volatility": f"({roll('stddev_pop', 'r1', 20)}) * sqrt(252.0) * 100"},
        _threshold_sql("historical_volatility", 1500), value=1500.0,
        ctes=f"rr AS (SELECT *, ln(close / {lag('close')}) AS r1 FROM v)", stage="rr")

TREND = DMI_CTES + f""",
ma AS (SELECT *, {roll('avg', 'close', 20)} AS s20, {roll('avg', 'close', 60)} AS l60 FROM dz),
mb AS (SELECT *, {lag('s20', 5)} AS s0 FROM ma),
mc AS (SELECT *, rn >= 120 AND s20 IS NOT NULL AND l60 IS NOT NULL AND s0 IS NOT NULL AND adx IS NOT NULL AS ready FROM mb),
mr AS (SELECT *, CASE
  WHEN ready AND close > s20 AND s20 > l60 AND s20 > s0 AND adx >= 25 AND plus_di > minus_di THEN 'up'
  WHEN ready AND close < s20 AND s20 < l60 AND s20 < s0 AND adx >= 25 AND minus_di > plus_di THEN 'down'
  ELSE 'range' END AS raw FROM mc)"""
publish("i24_trend_regime", "technical.trend_regime",
        {"regime": f"CASE WHEN ready THEN CASE WHEN raw = {lag('raw')} THEN raw ELSE 'range' END END"},
        {"uptrend": "regime = 'up'", "downtrend": "regime = 'down'", "\"range\"": "regime = 'range'"}, ctes=TREND, stage="mr")

publish("i25_price_close", "price.close", {"price": "close"}, _threshold_sql("price", 4000, True), value=4000.0)
publish("i26_return_pct", "price.return_pct", {"return_pct": f"(close / {lag('close', 5)} - 1) * 100"},
        _threshold_sql("return_pct", 10, True), value=10.0)
publish("i27_rolling_high", "price.rolling_high", {"prior_high": prior("max", "close", 20)},
        {"new_high": "close > prior_high"})
STREAK = f"""pc AS (SELECT *, {lag('close')} AS pc FROM v),
br AS (SELECT *, max(CASE WHEN close > pc THEN NULL ELSE rn END) OVER (PARTITION BY instrument ORDER BY session_date) AS brk FROM pc),
st AS (SELECT *, CASE WHEN rn > 3 THEN CAST(rn - brk AS DOUBLE) END AS streak FROM br)"""
publish("i28_consecutive_up", "price.consecutive_up", {}, {"at_least": "streak >= 3"}, ctes=STREAK, stage="st")
publish("i29_amplitude", "price.amplitude", {"amplitude": f"100 * (high - low) / {lag('close')}"},
        _threshold_sql("amplitude", 10), value=10.0)
publish("i30_true_range", "price.true_range", {"true_range": "tr"}, _threshold_sql("true_range", 2000), value=2000.0,
        ctes=TR_CTES, stage="tr")
publish("i31_market_volume", "market.volume", {"volume_average": roll("avg", "volume", 20)},
        {"gte_multiple": "volume >= volume_average * 1.5", "lte_multiple": "volume <= volume_average * 1.5"}, value=1.5)
publish("i32_market_amount", "market.amount", {"turnover": "amount"}, _threshold_sql("turnover", 60000), value=60000.0)


def _with_rate(bars):
    sourced = F.when(F.col("instrument") % 3 != 0, F.lit("desk"))
    return bars.withColumns({
        "turnover_rate_pct": F.col("volume") / 10,
        "turnover_rate_provider": sourced,
        "turnover_rate_methodology": F.lit("shares_traded"),
    })


publish("i33_turnover_rate", "market.turnover_rate", {"turnover_rate": "CASE WHEN instrument % 3 <> 0 THEN volume / 10 END"},
        _threshold_sql("turnover_rate", 3), value=3.0, prepare=_with_rate)
publish("i34_amount_average", "amount.average", {"amount_average": roll("avg", "amount", 20)},
        _threshold_sql("amount_average", 60000), value=60000.0)
_rv = f"volume / nullif(({prior('avg', 'volume', 20)}), 0)"
publish("i35_relative_volume", "volume.relative", {"rvol": _rv},
        {"gt_multiple": "rvol > 1.2", "gte_multiple": "rvol >= 1.2", "lte_multiple": "rvol <= 1.2",
         "consecutive_gte_multiple": f"({roll('min', 'rvol', 3)}) >= 1.2"}, value=1.2)
publish("i36_price_confirmation", "volume.price_confirmation",
        {"rvol": _rv, "return_1": f"CASE WHEN rn > 20 THEN (close / {lag('close')} - 1) * 100 END"},
        {"surge_up": "rvol >= 1.5 AND return_1 >= 5", "surge_down": "rvol >= 1.5 AND return_1 <= -5"})

_hi = (f"high > ({frame('max', 'high', '3 PRECEDING', '1 PRECEDING', 3)}) AND "
       f"high > ({frame('max', 'high', '1 FOLLOWING', '3 FOLLOWING', 3)})")
_low = (f"low < ({frame('min', 'low', '3 PRECEDING', '1 PRECEDING', 3)}) AND "
        f"low < ({frame('min', 'low', '1 FOLLOWING', '3 FOLLOWING', 3)})")
DIV = OBV_CTES + f""",
pv AS (SELECT *, coalesce({_hi}, false) AS hp, coalesce({_low}, false) AS lp, {prior('avg', 'volume', 20)} AS adv FROM ob),
pk AS (SELECT *, CASE WHEN hp THEN 'high' WHEN lp THEN 'low' END AS kind FROM pv),
pp AS (SELECT p.instrument, p.rn, p.kind, p.high, p.low, p.obv, p.adv, max(q.rn) AS prev
  FROM pk p JOIN pk q ON q.instrument = p.instrument AND q.kind = p.kind AND p.rn - q.rn BETWEEN 5 AND 60
  GROUP BY ALL),
pq AS (SELECT pp.instrument, pp.rn + 3 AS rn, pp.kind,
  CASE WHEN pp.kind = 'high' THEN (pp.high / q.high - 1) * 100 ELSE (q.low / pp.low - 1) * 100 END AS move,
  CASE WHEN pp.kind = 'high' THEN q.obv - pp.obv ELSE pp.obv - q.obv END AS obv_change, pp.adv AS obv_needed
  FROM pp JOIN pk q ON q.instrument = pp.instrument AND q.rn = pp.prev),
pz AS (SELECT v.*, pq.kind, pq.move, CASE WHEN v.rn > 23 THEN pq.obv_change END AS obv_change,
  CASE WHEN v.rn > 23 THEN pq.obv_needed END AS obv_needed FROM v LEFT JOIN pq USING (instrument, rn))"""
_hit = "coalesce(move >= 2 AND obv_change >= obv_needed AND kind = '{}', false)"
publish("i37_price_divergence", "volume.price_divergence", {},
        {"bearish": f"CASE WHEN rn > 23 THEN {_hit.format('high')} END",
         "bullish": f"CASE WHEN rn > 23 THEN {_hit.format('low')} END"}, ctes=DIV, stage="pz")
