"""Published bar aggregation, factor, ledger and ranking queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import bars as RB
from tidemark.operators import factors as FA
from tidemark.operators import ledger as L
from tidemark.plans.joins import ACT, FACTS, KEYS
from tidemark.plans.registry import query
from tidemark.plans.atoms import VALUATION
from tidemark.plans.sql import BARS, NUMBERED, PX, TICK_NO, lag, roll
from tidemark.session import materialise
from tidemark.sources import market as mk
from tidemark.sources.tables import table

HOURS = """hb AS (SELECT event_type, date_trunc('hour', ts) AS bar_start, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, event_id) AS close, count(*) AS volume, sum(CAST(value AS DECIMAL(18,2))) AS amount FROM events GROUP BY 1, 2)"""
M1 = "(hour(bar_start) * 60 + minute(bar_start))"


@query("a01_resample", f"""WITH {HOURS}, b AS (SELECT *, CAST(bar_start AS DATE) AS day, CASE WHEN hour(bar_start) < 12 THEN 'am' ELSE 'pm' END AS half,
  (hour(bar_start) % 12) // 4 AS bucket FROM hb)
SELECT event_type, min(bar_start) AS bar_start, max(bar_start) + INTERVAL 1 HOUR AS bar_end, arg_min(open, bar_start) AS open, max(high) AS high, min(low) AS low,
 arg_max(close, bar_start) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(amount) AS DOUBLE) AS amount FROM b GROUP BY event_type, day, half, bucket HAVING count(*) = 4""")
def a01(spark, folder):
    """Four-hour bars from hourly ones; a bucket that misses an hour is dropped."""
    out = RB.resample(mk.bars_hour(spark, folder), ["event_type"], "bar_start", 60, 240, 0, 720).filter("complete")
    return out.select("event_type", "bar_start", "bar_end", "open", "high", "low", "close", "volume", F.col("amount").cast("double").alias("amount"))


@query("a01_dropped_buckets", f"""WITH {HOURS}, b AS (SELECT event_type, CAST(bar_start AS DATE) AS day, hour(bar_start) // 4 AS k, count(*) AS n FROM hb GROUP BY ALL)
SELECT event_type, count(*) FILTER (WHERE n < 4) AS dropped, count(*) FILTER (WHERE n = 4) AS kept FROM b GROUP BY 1""")
def a01_dropped(spark, folder):
    out = RB.resample(mk.bars_hour(spark, folder), ["event_type"], "bar_start", 60, 240, 0, 720)
    return out.groupBy("event_type").agg(F.count_if(~F.col("complete")).alias("dropped"), F.count_if("complete").alias("kept"))


@query("a02_opening_auction", f"""WITH {HOURS}, m AS (SELECT *, hour(bar_start) = 0 AS auc, CASE WHEN hour(bar_start) = 0 THEN bar_start + INTERVAL 1 HOUR ELSE bar_start END AS s FROM hb)
SELECT event_type, s AS bar_start, arg_min(open, bar_start) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_start) AS close,
 CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(amount) AS DOUBLE) AS amount, CAST(max(CAST(auc AS INT)) AS INT) AS has_auction FROM m GROUP BY 1, 2""")
def a02(spark, folder):
    first = F.hour("bar_start") == 0
    out = RB.merge_opening_auction(mk.bars_hour(spark, folder), ["event_type"], "bar_start", first,
                                   F.col("bar_start") + F.make_dt_interval(hours=F.lit(1)))
    return out.withColumn("amount", F.col("amount").cast("double"))


@query("a03_completeness", f"""WITH {HOURS}, d AS (SELECT event_type, CAST(bar_start AS DATE) AS day, count(*) FILTER (WHERE hour(bar_start) BETWEEN 1 AND 22) AS n,
 count(*) FILTER (WHERE hour(bar_start) NOT BETWEEN 1 AND 22) AS extra FROM hb GROUP BY 1, 2) SELECT event_type, day, 22 - n AS missing, extra FROM d""")
def a03(spark, folder):
    return RB.completeness(mk.bars_hour(spark, folder), ["event_type"], "bar_start", [h * 60 for h in range(1, 23)])


SNAP = f"""fb AS (SELECT v.*, volume / 10 AS tr, close / {lag('close')} - 1 AS r FROM v),
fs AS (SELECT instrument, session_date, close, close / {lag('close', 60)} - 1 AS momentum_60, ({roll('stddev_samp', 'r', 60)}) * sqrt(252.0) AS volatility_60, {roll('avg', 'tr', 20)} AS turnover_avg_20 FROM fb),
fl AS (SELECT instrument, max(session_date) AS latest_date, arg_max(close, session_date) AS latest_close, max({{'d': session_date, 'x': momentum_60}}).x AS momentum_60,
  max({{'d': session_date, 'x': volatility_60}}).x AS volatility_60, max({{'d': session_date, 'x': turnover_avg_20}}).x AS turnover_avg_20 FROM fs GROUP BY 1),
xd AS (SELECT max(session_date) AS d FROM bars),
vl AS (SELECT instrument, arg_max(pe_ttm, session_date) AS pe, arg_max(pb, session_date) AS pb FROM val GROUP BY 1),
fr AS (SELECT instrument, max({{'n': notice_date, 'r': revision_id, 'v': value}}).v AS report_value FROM fx, xd WHERE notice_date <= xd.d GROUP BY 1),
dy AS (SELECT instrument, sum(gross_cash) AS cash FROM act, xd WHERE status = 'F' AND ex_date BETWEEN xd.d - 365 AND xd.d GROUP BY 1),
snap AS (SELECT fl.*, latest_date >= xd.d - 30 AS is_active, CASE WHEN pe > 0 THEN pe END AS pe_ttm, CASE WHEN pb > 0 THEN pb END AS pb, report_value,
  round(coalesce(cash, 0) / latest_close, 8) AS dividend_yield FROM fl CROSS JOIN xd LEFT JOIN vl USING (instrument) LEFT JOIN fr USING (instrument) LEFT JOIN dy USING (instrument))"""
SNAP_CTES = f"WITH {BARS}, {NUMBERED}, {VALUATION}, {ACT}, {SNAP}"
SIX = ("momentum_60", "volatility_60", "turnover_avg_20", "pe_ttm", "pb")


def snapshot(spark, folder):
    bars = materialise(mk.bars_daily(spark, folder).withColumn("turnover_rate", F.col("volume") / 10), "bars")
    return FA.latest_factors(bars, mk.valuation(spark, folder), mk.facts(spark, folder), mk.corporate_actions(spark, folder))


@query("a04_factor_snapshot", f"""{SNAP_CTES} SELECT instrument, latest_date, latest_close, is_active, {', '.join(f'round({c}, 6) AS {c}' for c in SIX)}, report_value, dividend_yield FROM snap""")
def a04(spark, folder):
    return snapshot(spark, folder).select("instrument", "latest_date", "latest_close", "is_active", *[F.round(c, 6).alias(c) for c in SIX],
                                          "report_value", "dividend_yield")


@query("k06_factor_screen", f"""{SNAP_CTES} SELECT instrument, latest_close, round(momentum_60, 6) AS momentum_60, round(pe_ttm, 6) AS pe_ttm FROM snap
WHERE is_active AND pe_ttm > 0 AND volatility_60 IS NOT NULL ORDER BY momentum_60 DESC, instrument LIMIT 20""")
def k06(spark, folder):
    """Top twenty by momentum among active instruments with a positive PE."""
    s = snapshot(spark, folder).filter("is_active and pe_ttm > 0 and volatility_60 is not null")
    return s.orderBy(F.desc("momentum_60"), "instrument").limit(20).select(
        "instrument", "latest_close", F.round("momentum_60", 6).alias("momentum_60"), F.round("pe_ttm", 6).alias("pe_ttm"))


@query("a17_daily_bars", f"WITH {BARS} SELECT * FROM bars")
def a17(spark, folder):
    return mk.bars_daily(spark, folder)


NUDGE = 0.0000317  # keeps exact rounding halves apart in both engines

# ---- ledger ---------------------------------------------------------------------------

TRADES = f"""td AS (SELECT l_suppkey AS account, l_partkey % 5 AS symbol, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side, CAST(l_shipdate AS DATE) AS trade_date,
 {TICK_NO} AS seq, l_quantity AS quantity, {PX} AS price, l_extendedprice AS amount, l_extendedprice * l_tax AS fees,
 CASE WHEN l_linestatus = 'O' THEN 'date_only' ELSE 'exact' END AS precision FROM lineitem)"""
FIFO = f"""{TRADES},
am AS (SELECT account, symbol, trade_date FROM td GROUP BY ALL HAVING count(DISTINCT side) > 1 AND bool_or(precision = 'date_only')),
c AS (SELECT td.*, am.trade_date IS NOT NULL AS mixed, sum(CASE WHEN side = 'buy' THEN quantity ELSE 0 END) OVER w AS b1, sum(CASE WHEN side = 'sell' THEN quantity ELSE 0 END) OVER w AS s1
  FROM td LEFT JOIN am USING (account, symbol, trade_date) WINDOW w AS (PARTITION BY account, symbol ORDER BY trade_date, seq)),
f AS (SELECT *, bool_or(mixed OR (side = 'sell' AND s1 > b1)) OVER (PARTITION BY account, symbol ORDER BY trade_date, seq) AS broken FROM c),
lots AS (SELECT account, symbol, b1 - quantity AS b0, b1, (quantity * price + fees) / quantity AS unit FROM c WHERE side = 'buy'),
pn AS (SELECT f.account, f.symbol, f.trade_date, f.seq, any_value(f.quantity * f.price - f.fees) - sum((least(f.s1, l.b1) - greatest(f.s1 - f.quantity, l.b0)) * l.unit) AS pnl
  FROM f JOIN lots l ON l.account = f.account AND l.symbol = f.symbol AND l.b0 < f.s1 AND l.b1 > f.s1 - f.quantity WHERE f.side = 'sell' AND NOT f.broken GROUP BY 1, 2, 3, 4),
rp AS (SELECT f.*, pn.pnl AS fifo_pnl, CASE WHEN f.seq % 7 = 0 AND f.side = 'sell' THEN f.amount * 0.1 END AS broker FROM f LEFT JOIN pn USING (account, symbol, trade_date, seq)),
at AS (SELECT account, symbol, trade_date, seq, coalesce(broker, fifo_pnl) AS pnl, broker IS NOT NULL AS is_broker FROM rp WHERE side = 'sell')""".replace("\nat AS", "\natt AS")


def fifo_rows(spark, folder):
    return L.fifo(mk.trades(spark, folder))


def attributed(spark, folder):
    """Sells with their realised P&L; the broker's own figure wins over the derived one."""
    r = fifo_rows(spark, folder).filter(F.col("side") == "sell")
    broker = F.when(F.col("seq") % 7 == 0, F.col("amount") * 0.1)
    return r.select("account", "symbol", "trade_date", "seq", F.coalesce(broker, F.col("fifo_pnl")).alias("pnl"), broker.isNotNull().alias("is_broker"))


@query("l04_fifo_pnl", f"WITH {FIFO} SELECT account, symbol, trade_date, CAST(seq AS VARCHAR) AS seq, NOT broken AS complete, round(fifo_pnl + {NUDGE}, 4) AS fifo_pnl FROM rp WHERE side = 'sell'")
def l04(spark, folder):
    return fifo_rows(spark, folder).filter(F.col("side") == "sell").select(
        "account", "symbol", "trade_date", F.col("seq").cast("string").alias("seq"), "complete", F.round(F.col("fifo_pnl") + NUDGE, 4).alias("fifo_pnl"))


@query("j16_lot_consumption", f"""WITH {FIFO} SELECT account, symbol, count(*) FILTER (WHERE side = 'sell') AS sells, count(*) FILTER (WHERE side = 'sell' AND NOT broken) AS covered,
 round(coalesce(sum(CASE WHEN side = 'sell' AND NOT broken THEN quantity END), 0), 2) AS shares_consumed, round(coalesce(sum(quantity * price - fees - fifo_pnl), 0) + {NUDGE}, 4) AS cost_consumed FROM rp GROUP BY 1, 2""")
def j16(spark, folder):
    sold = F.when((F.col("side") == "sell") & F.col("complete"), F.col("quantity"))
    return fifo_rows(spark, folder).groupBy("account", "symbol").agg(
        F.count_if(F.col("side") == "sell").alias("sells"), F.count(sold).alias("covered"),
        F.round(F.coalesce(F.sum(sold), F.lit(0.0)), 2).alias("shares_consumed"), F.round(F.coalesce(F.sum("fifo_cost"), F.lit(0.0)) + NUDGE, 4).alias("cost_consumed"))


@query("l02_running_position", f"""WITH {TRADES}, p AS (SELECT account, symbol, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) OVER (PARTITION BY account, symbol ORDER BY trade_date, seq) AS q,
 CASE WHEN side = 'buy' THEN quantity ELSE -quantity END AS d FROM td) SELECT account, symbol, min(q) AS lowest, sum(d) AS final_position, min(q) < 0 AS sells_before_buys FROM p GROUP BY 1, 2""")
def l02(spark, folder):
    return L.oversold(mk.trades(spark, folder)).withColumn("sells_before_buys", F.col("lowest") < 0)


@query("l03_last_balance", f"""WITH {TRADES} SELECT account, symbol, arg_max(quantity * 3, {{'d': trade_date, 's': seq}}) AS reported_balance,
 sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) AS net_traded, arg_max(quantity * 3, {{'d': trade_date, 's': seq}}) = sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) AS reconstructable FROM td GROUP BY 1, 2""")
def l03(spark, folder):
    """Last balance the broker printed per holding, and whether the trades alone rebuild it."""
    t = mk.trades(spark, folder)
    d = t.groupBy("account", "symbol", "trade_date").agg(
        F.max_by(F.col("quantity") * 3, "seq").alias("b"), F.sum(L.qty("buy") - L.qty("sell")).alias("n"))
    g = d.groupBy("account", "symbol").agg(F.max_by("b", "trade_date").alias("reported_balance"), F.sum("n").alias("net_traded"))
    return g.withColumn("reconstructable", F.col("reported_balance") == F.col("net_traded"))


HOLD = f"""{TRADES}, h AS (SELECT account, symbol, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) AS q, arg_max(price, {{'d': trade_date, 's': seq}}) AS px,
 sum(CASE WHEN side = 'buy' THEN quantity * price + fees END) / sum(CASE WHEN side = 'buy' THEN quantity END) AS ac FROM td GROUP BY 1, 2 HAVING q > 0)"""


@query("a11_holdings", f"WITH {HOLD} SELECT account, symbol, q AS quantity, round(q * px, 2) AS market_value, round((px - ac) * q, 2) AS unrealized_pnl, round(q * px / sum(q * px) OVER (PARTITION BY account) * 100, 6) AS weight_pct FROM h")
def a11(spark, folder):
    t = mk.trades(spark, folder)
    d = t.groupBy("account", "symbol", "trade_date").agg(
        F.max_by("price", "seq").alias("px"), F.sum(L.qty("buy") - L.qty("sell")).alias("q"), F.sum(L.qty("buy")).alias("b"), F.sum(L.buy_cost()).alias("c"))
    h = d.groupBy("account", "symbol").agg(F.sum("q").alias("quantity"), F.max_by("px", "trade_date").alias("px"),
                                           F.try_divide(F.sum("c"), F.sum("b")).alias("ac")).filter("quantity > 0")
    h = h.withColumn("mv", F.col("quantity") * F.col("px"))
    total = h.groupBy("account").agg(F.sum("mv").alias("total"))
    return h.join(total, "account").select(
        "account", "symbol", "quantity", F.round("mv", 2).alias("market_value"), F.round((F.col("px") - F.col("ac")) * F.col("quantity"), 2).alias("unrealized_pnl"),
        F.round(F.col("mv") / F.col("total") * 100, 6).alias("weight_pct"))


@query("a12_attribution", f"""WITH {FIFO}, g AS (SELECT account, count(*) AS sells, count(pnl) AS attributed, count(*) FILTER (WHERE is_broker) AS broker_count,
 count(*) FILTER (WHERE NOT is_broker AND pnl IS NOT NULL) AS fifo_count, sum(pnl) AS p, sum(pnl) FILTER (WHERE is_broker) AS bp FROM att GROUP BY 1)
SELECT account, sells, attributed, broker_count, fifo_count, round(p + {NUDGE}, 4) AS verified_pnl, round(bp / p, 6) AS broker_share,
 CASE WHEN attributed = 0 THEN 'unavailable' WHEN attributed = sells THEN 'available' ELSE 'partial' END AS coverage FROM g""")
def a12(spark, folder):
    g = attributed(spark, folder).groupBy("account").agg(
        F.count(F.lit(1)).alias("sells"), F.count("pnl").alias("attributed"), F.count_if("is_broker").alias("broker_count"),
        F.count_if(~F.col("is_broker") & F.col("pnl").isNotNull()).alias("fifo_count"), F.sum("pnl").alias("p"),
        F.sum(F.when(F.col("is_broker"), F.col("pnl"))).alias("bp"))
    cover = F.when(F.col("attributed") == 0, "unavailable").when(F.col("attributed") == F.col("sells"), "available").otherwise("partial")
    return g.select("account", "sells", "attributed", "broker_count", "fifo_count", F.round(F.col("p") + NUDGE, 4).alias("verified_pnl"),
                    F.round(F.try_divide("bp", "p"), 6).alias("broker_share"), cover.alias("coverage"))


@query("k01_top_gains", f"""WITH {FIFO} SELECT account, symbol, trade_date, CAST(att.seq AS VARCHAR) AS seq, round(pnl + {NUDGE}, 4) AS pnl FROM att WHERE pnl > 0
QUALIFY row_number() OVER (PARTITION BY account ORDER BY round(pnl, 6) DESC, trade_date, symbol, att.seq) <= 5""")
def k01(spark, folder):
    """Five largest realised gains per account; the rank limit is applied before the shuffle."""
    gains = attributed(spark, folder).filter("pnl > 0").withColumn("_k", F.round("pnl", 6))
    w = Window.partitionBy("account").orderBy(F.desc("_k"), "trade_date", "symbol", "seq")
    top = gains.withColumn("_n", F.row_number().over(w)).filter("_n <= 5")
    return top.select("account", "symbol", "trade_date", F.col("seq").cast("string").alias("seq"), F.round(F.col("pnl") + NUDGE, 4).alias("pnl"))


FLOWS = """fw AS (SELECT user_id AS account, CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'signup' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS inflow,
 sum(CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS outflow FROM events WHERE event_type IN ('signup', 'error') GROUP BY 1, 2),
eq0 AS (SELECT user_id AS account, CAST(ts AS DATE) AS day, sum(CAST(value AS DECIMAL(18,2))) AS v, bool_or(event_type IN ('view', 'click')) AS marked FROM events GROUP BY 1, 2),
eq AS (SELECT account, day, CAST(1000 + sum(v) OVER (PARTITION BY account ORDER BY day) AS DOUBLE) AS equity, marked FROM eq0)"""


def flow_rows(spark, folder):
    e = table(spark, folder, "events").filter(F.col("event_type").isin("signup", "error"))
    v = F.col("value").cast("decimal(18,2)")
    return e.groupBy(F.col("user_id").alias("account"), F.to_date("ts").alias("day")).agg(
        F.coalesce(F.sum(F.when(F.col("event_type") == "signup", v)), F.lit(0)).cast("double").alias("inflow"),
        F.coalesce(F.sum(F.when(F.col("event_type") == "error", v)), F.lit(0)).cast("double").alias("outflow"))


def equity_rows(spark, folder):
    """Daily equity of each account on the days its broker marked it."""
    e = table(spark, folder, "events").groupBy(F.col("user_id").alias("account"), F.to_date("ts").alias("day")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).alias("v"), F.bool_or(F.col("event_type").isin("view", "click")).alias("marked"))
    w = Window.partitionBy("account").orderBy("day")
    return e.withColumn("equity", (F.sum("v").over(w) + 1000).cast("double")).filter("marked").select("account", "day", "equity")


@query("a13_external_flows", f"WITH {FLOWS} SELECT account, CAST(sum(inflow) AS DOUBLE) AS inflow, CAST(sum(outflow) AS DOUBLE) AS outflow, CAST(sum(inflow - outflow) AS DOUBLE) AS net_external FROM fw GROUP BY 1")
def a13(spark, folder):
    g = flow_rows(spark, folder).groupBy("account").agg(F.round(F.sum("inflow"), 2).alias("inflow"), F.round(F.sum("outflow"), 2).alias("outflow"))
    return g.withColumn("net_external", F.round(F.col("inflow") - F.col("outflow"), 2))


TWR = f"""{FLOWS}, q AS (SELECT account, day, equity, lag(equity) OVER (PARTITION BY account ORDER BY day) AS pe, lag(day) OVER (PARTITION BY account ORDER BY day) AS pd FROM eq WHERE marked),
m AS (SELECT q.account, q.day, q.equity, q.pe, coalesce(CAST(sum(inflow) AS DOUBLE), 0) AS inflow, coalesce(CAST(sum(outflow) AS DOUBLE), 0) AS outflow FROM q LEFT JOIN fw ON fw.account = q.account AND fw.day <= q.day AND (q.pd IS NULL OR fw.day > q.pd) GROUP BY 1, 2, 3, 4),
b AS (SELECT *, coalesce(bool_or(pe IS NOT NULL AND (equity + outflow <= 0 OR pe + inflow <= 0)) OVER (PARTITION BY account ORDER BY day), false) AS bad FROM m),
r AS (SELECT *, CASE WHEN pe IS NOT NULL AND NOT bad THEN (equity + outflow) / (pe + inflow) - 1 END AS period_return FROM b),
x AS (SELECT *, CASE WHEN NOT bad THEN exp(coalesce(sum(ln(1 + period_return)) OVER (PARTITION BY account ORDER BY day), 0)) END AS idx FROM r)"""


@query("j15_flow_intervals", f"WITH {TWR} SELECT account, day, round(inflow, 2) AS inflow, round(outflow, 2) AS outflow FROM m")
def j15(spark, folder):
    out = L.linked_returns(equity_rows(spark, folder), flow_rows(spark, folder))
    return out.select("account", "day", F.round("inflow", 2).alias("inflow"), F.round("outflow", 2).alias("outflow"))


@query("l05_time_weighted", f"""WITH {TWR} SELECT account, day, round(equity, 2) AS equity, round(period_return, 8) AS period_return, round(idx, 8) AS linked_index,
 round(idx / max(idx) OVER (PARTITION BY account ORDER BY day) - 1, 8) AS drawdown, CASE WHEN bad THEN 'equity_not_positive' END AS problem FROM x""")
def l05(spark, folder):
    out = L.linked_returns(equity_rows(spark, folder), flow_rows(spark, folder))
    return out.select("account", "day", F.round("equity", 2).alias("equity"), *[F.round(c, 8).alias(c) for c in ("period_return", "linked_index", "drawdown")], "problem")


@query("l06_capability", f"""WITH {FLOWS}, p AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS z FROM events), g AS (SELECT account, count(*) AS points, min(day) AS a, max(day) AS z FROM eq WHERE marked GROUP BY 1)
SELECT account, points, CASE WHEN points < 2 THEN 'unavailable' WHEN points >= 3 AND g.a = p.a AND g.z = p.z THEN 'available' ELSE 'partial' END AS grade FROM g, p""")
def l06(spark, folder):
    """Is the linked return backed by the whole period, part of it, or not at all?"""
    e = table(spark, folder, "events")
    first, last = e.agg(F.to_date(F.min("ts"))).scalar(), e.agg(F.to_date(F.max("ts"))).scalar()
    g = equity_rows(spark, folder).groupBy("account").agg(F.count(F.lit(1)).alias("points"), F.min("day").alias("a"), F.max("day").alias("z"))
    whole = (F.col("points") >= 3) & (F.col("a") == first) & (F.col("z") == last)
    return g.select("account", "points", F.when(F.col("points") < 2, "unavailable").when(whole, "available").otherwise("partial").alias("grade"))


@query("l07_reconciliation", f"""WITH {TRADES}, g AS (SELECT account, count(DISTINCT precision) > 1 AS mixed, min(CASE WHEN side = 'sell' THEN trade_date END) < min(CASE WHEN side = 'buy' THEN trade_date END) AS gap,
 count(DISTINCT symbol % 2) > 1 AS cur, bool_or(symbol = 3) AS fx FROM td GROUP BY 1)
SELECT account, concat_ws('|', CASE WHEN mixed THEN 'mixed_snapshot_times' END, CASE WHEN gap THEN 'opening_position_gap' END, CASE WHEN fx THEN 'missing_fx' END, CASE WHEN cur THEN 'mixed_currency' END) AS reasons FROM g""")
def l07(spark, folder):
    """Every reason why a ledger cannot be reconciled as it stands."""
    side, d = F.col("side"), F.col("trade_date")
    g = mk.trades(spark, folder).groupBy("account").agg(
        (F.min("precision") != F.max("precision")).alias("mixed"),
        (F.min(F.when(side == "sell", d)) < F.min(F.when(side == "buy", d))).alias("gap"),
        (F.min(F.col("symbol") % 2) != F.max(F.col("symbol") % 2)).alias("cur"), F.bool_or(F.col("symbol") == 3).alias("fx"))
    return g.select("account", F.concat_ws("|", F.when(F.col("mixed"), "mixed_snapshot_times"), F.when(F.col("gap"), "opening_position_gap"),
                                           F.when(F.col("fx"), "missing_fx"), F.when(F.col("cur"), "mixed_currency")).alias("reasons"))


@query("l08_price_context", f"""WITH {BARS}, {FACTS}
SELECT fx.instrument, fx.revision_id, arg_max(b.close, b.session_date) AS last_close, max(b.session_date) AS close_date,
 round(arg_max(b.close, b.session_date) / arg_min(b.close, b.session_date) - 1, 6) AS window_change
FROM fx JOIN bars b ON b.instrument = fx.instrument AND b.session_date BETWEEN fx.notice_date - 30 AND fx.notice_date GROUP BY 1, 2""")
def l08(spark, folder):
    """Last close at or before a highlight and the change over the thirty days before it."""
    from tidemark.operators.asof import latest_known, next_own_session

    bars = materialise(mk.bars_daily(spark, folder).select(*KEYS, "close"), "closes")
    h = mk.facts(spark, folder).select("instrument", "revision_id", "notice_date", F.date_sub("notice_date", 30).alias("from_date"))
    h = latest_known(h, bars, ["instrument"], "notice_date", "session_date", ["session_date"], ["close"])
    h = next_own_session(h, bars, ["instrument"], "from_date", "first_date")
    first = bars.select("instrument", F.col("session_date").alias("first_date"), F.col("close").alias("first_close"))
    h = h.filter(F.col("fact_session_date") >= F.col("from_date")).join(first, ["instrument", "first_date"])
    return h.select("instrument", "revision_id", F.col("fact_close").alias("last_close"), F.col("fact_session_date").alias("close_date"),
                    F.round(F.col("fact_close") / F.col("first_close") - 1, 6).alias("window_change"))


@query("a14_rollup_counts", f"WITH {FACTS} SELECT status, priority, count(*) AS n, grouping(status) + grouping(priority) AS level FROM fx GROUP BY ROLLUP (status, priority)")
def a14(spark, folder):
    g = mk.facts(spark, folder).rollup("status", "priority").agg(
        F.count(F.lit(1)).alias("n"), (F.grouping("status").cast("int") + F.grouping("priority").cast("int")).alias("level"))
    return g.select("status", "priority", "n", F.col("level").cast("long").alias("level"))


REV = "l_orderkey, l_linenumber"


@query("a19_revision_duplicates", f"""WITH g AS (SELECT {REV}, count(*) AS copies, count(DISTINCT (l_partkey, l_quantity)) AS versions FROM lineitem GROUP BY 1, 2)
SELECT {REV}, copies, versions, CASE WHEN versions > 1 THEN 'contradiction' WHEN copies > 1 THEN 'duplicate' ELSE 'unique' END AS kind FROM g""")
def a19(spark, folder):
    """Copies of one provider revision: identical ones collapse, differing ones contradict."""
    versions = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").agg(F.count(F.lit(1)).alias("c"))
    g = versions.groupBy("l_orderkey", "l_linenumber").agg(F.sum("c").alias("copies"), F.count(F.lit(1)).alias("versions"))
    return g.withColumn("kind", F.when(F.col("versions") > 1, "contradiction").when(F.col("copies") > 1, "duplicate").otherwise("unique"))


@query("u05_collapse_duplicates", "SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem")
def u05(spark, folder):
    return table(spark, folder, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus").dropDuplicates()


@query("u01_replay_frames", f"""WITH {TRADES}, {FLOWS}
SELECT 'trade' AS frame, account, trade_date AS day, CAST(seq AS VARCHAR) AS seq, round(quantity * price, 2) AS amount, side AS detail FROM td
UNION ALL SELECT 'flow', account, day, NULL, round(CAST(inflow - outflow AS DOUBLE), 2), NULL FROM fw UNION ALL SELECT 'equity', account, day, NULL, round(equity, 2), NULL FROM eq WHERE marked""")
def u01(spark, folder):
    """Trades, flows and equity points as one frame stream."""
    t = mk.trades(spark, folder).select(F.lit("trade").alias("frame"), "account", F.col("trade_date").alias("day"), F.col("seq").cast("string").alias("seq"),
                                        F.round(F.col("quantity") * F.col("price"), 2).alias("amount"), F.col("side").alias("detail"))
    f = flow_rows(spark, folder).select(F.lit("flow").alias("frame"), "account", "day", F.round(F.col("inflow") - F.col("outflow"), 2).alias("amount"))
    e = equity_rows(spark, folder).select(F.lit("equity").alias("frame"), "account", "day", F.round("equity", 2).alias("amount"))
    return t.unionByName(f, allowMissingColumns=True).unionByName(e, allowMissingColumns=True)


@query("k05_event_order", """SELECT user_id, CAST(ts AS DATE) AS day, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS rank, event_id FROM events""")
def k05(spark, folder):
    """Total order of all observations; a range-partitioned sort, so no subject is held by one task."""
    from tidemark.operators.events import provider_rank

    e = table(spark, folder, "events").select("user_id", F.to_date("ts").alias("day"), provider_rank(F.col("event_type")).alias("rank"), "event_id")
    return e.orderBy("user_id", "day", "rank", "event_id")


@query("k02_directory_search", """WITH k AS (SELECT p_partkey, unnest([lower(p_name), lower(p_brand), CAST(p_partkey AS VARCHAR)]) AS k FROM part),
r AS (SELECT p_partkey, min(CASE WHEN k = 'red' THEN 0 WHEN starts_with(k, 'red') THEN 1 WHEN contains(k, 'red') THEN 2 END) AS rank FROM k GROUP BY 1) SELECT p_partkey, rank FROM r WHERE rank IS NOT NULL""")
def k02(spark, folder):
    from tidemark.operators.directory import search

    return search(table(spark, folder, "part"), "p_partkey", ["p_name", "p_brand", "p_partkey"], "red")


@query("k02_directory_terms", """WITH p AS (SELECT p_partkey, list_distinct([lower(p_name), lower(p_brand), CAST(p_partkey AS VARCHAR), array_to_string(list_transform(list_filter(string_split(lower(p_name), ' '), lambda w: w <> ''), lambda w: w[1]), '')]) AS ks FROM part),
k AS (SELECT p_partkey, unnest(ks) AS k FROM p), w AS (SELECT unnest(string_split(lower(p_name), ' ')) AS w FROM part),
t AS (SELECT w AS term FROM w UNION SELECT substr(w, 1, 2) FROM w UNION SELECT substr(w, 2, 4) FROM w UNION SELECT CAST(p_partkey % 100 AS VARCHAR) FROM part UNION SELECT lower(p_brand) FROM part),
m AS (SELECT t.term, k.p_partkey, min(CASE WHEN k = term THEN 0 WHEN starts_with(k, term) THEN 1 ELSE 2 END) AS rank FROM t JOIN k ON contains(k, term) WHERE term <> '' GROUP BY 1, 2)
SELECT term, p_partkey, rank, row_number() OVER (PARTITION BY term ORDER BY rank, p_partkey) AS position FROM m""")
def k02_terms(spark, folder):
    """Words of the names, pieces of them, brands and ends of numbers, all looked up at once."""
    from tidemark.operators.directory import initials, search_terms

    p = table(spark, folder, "part").withColumn("initials", initials(F.col("p_name")))
    words = p.select(F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    terms = words.select(F.explode(F.array("w", F.substring("w", 1, 2), F.substring("w", 2, 4))).alias("term"))
    terms = terms.unionAll(p.select((F.col("p_partkey") % 100).cast("string"))).unionAll(p.select(F.lower("p_brand")))
    return search_terms(p, "p_partkey", ["p_name", "p_brand", "p_partkey", "initials"], terms)


@query("k03_exact_aliases", """WITH k AS (SELECT p_partkey, unnest([lower(p_name), lower(p_type)]) AS alias FROM part)
SELECT alias, count(DISTINCT p_partkey) AS matches, count(DISTINCT p_partkey) > 1 AS ambiguous FROM k GROUP BY 1""")
def k03(spark, folder):
    from tidemark.operators.directory import aliases

    return aliases(table(spark, folder, "part"), "p_partkey", ["p_name", "p_type"])

