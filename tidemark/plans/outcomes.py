"""Published exits, outcomes, curves and trade statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.windows import DAILY, Axis
from tidemark.operators import metrics as M
from tidemark.operators import outcomes as O
from tidemark.operators.atoms import REVERSE_OF, with_atoms
from tidemark.operators.indicators import ma as study_ma
from tidemark.plans.registry import query
from tidemark.plans.sql import BARS, NUMBERED, SUSP, lag, roll
from tidemark.functions.windows import TRADED
from tidemark.session import materialise
from tidemark.sources.market import bars_by_instrument, bars_daily, bars_suspended, calendar
from tidemark.sources.tables import table

BUY, REV = "ma_5_cross_up_10", "ma_5_cross_down_10"
_G = f"(({roll('avg', 'close', 5)}) - ({roll('avg', 'close', 10)}))"
TRIG = f"""{BARS}, {NUMBERED},
g AS MATERIALIZED (SELECT *, {_G} AS g, max(rn) OVER (PARTITION BY instrument) AS last_rn, lead(open) OVER (PARTITION BY instrument ORDER BY session_date) AS buy_price,
  lead(session_date) OVER (PARTITION BY instrument ORDER BY session_date) AS next_date FROM v),
a AS MATERIALIZED (SELECT *, coalesce(rn > 11 AND {lag('g')} <= 0 AND g > 0, false) AS buy,
             coalesce(rn > 11 AND {lag('g')} >= 0 AND g < 0, false) AS rev FROM g),
tr AS MATERIALIZED (SELECT * FROM a WHERE buy AND rn < last_rn AND buy_price > 0)"""


def flagged(spark, folder):
    """Bars with the entry and reverse atoms, stored once: exits read them several times."""
    return materialise(with_atoms(bars_by_instrument(spark, folder), [BUY, REV]), "flagged-bars")


def future(cond: str) -> str:
    return f"(SELECT min(f.rn) FROM a f WHERE f.instrument = tr.instrument AND f.rn > tr.rn AND {cond})"


# rule name -> (Spark rule, SQL of the hit bar, reason when hit, reason when not)
RULES = {
    "hold": (O.Hold(10), "CASE WHEN tr.rn + 10 <= tr.last_rn THEN tr.rn + 10 END", "hit_hold_n_days_10",
             "force_close_end_hold_n_days_overflow"),
    "stop": (O.StopLoss(30.0), future("f.close <= tr.close * (1 + -1 * CAST(30 AS DOUBLE) / 100)"), "hit_stop_loss_30pct",
             "force_close_end_stop_loss_not_hit"),
    "profit": (O.TakeProfit(50.0), future("f.close >= tr.close * (1 + 1 * CAST(50 AS DOUBLE) / 100)"), "hit_take_profit_50pct",
               "force_close_end_take_profit_not_hit"),
    "trail": (O.TrailingStop(60.0), "td.at", "hit_trailing_stop_60pct", "force_close_end_trailing_stop_not_hit"),
    "reverse": (O.OnSignal(REV), future("f.rev"), "hit_reverse_signal", "force_close_end_reverse_signal_not_seen"),
    "atom": (O.on_atom(REV), future("f.rev"), f"hit_sell_on_{REV}", f"force_close_end_{REV}_not_seen"),
    "month": (O.PeriodEnd("month_end"), future("date_trunc('month', f.session_date) <> date_trunc('month', f.next_date)"),
              "hit_hold_until_month_end", "force_close_end_no_month_end_seen"),
    "quarter": (O.PeriodEnd("quarter_end"), future("date_trunc('quarter', f.session_date) <> date_trunc('quarter', f.next_date)"),
                "hit_hold_until_quarter_end", "force_close_end_no_quarter_end_seen"),
}
TRAIL = """pk AS MATERIALIZED (SELECT tr.instrument, tr.rn AS t0, f.rn, f.close,
  max(f.close) OVER (PARTITION BY tr.instrument, tr.rn ORDER BY f.rn) AS peak
  FROM tr JOIN a f ON f.instrument = tr.instrument AND f.rn > tr.rn),
td AS (SELECT instrument, t0, min(rn) AS at FROM pk WHERE close <= peak * (1 - CAST(60 AS DOUBLE) / 100) GROUP BY 1, 2)"""


def outcome_ctes(names: list[str]) -> str:
    trail = "trail" in names
    structs = ", ".join(
        f"{{'idx': coalesce({RULES[n][1]}, tr.last_rn), 'rule': {i}, "
        f"'reason': CASE WHEN {RULES[n][1]} IS NULL THEN '{RULES[n][3]}' ELSE '{RULES[n][2]}' END}}"
        for i, n in enumerate(names)
    )
    join = "LEFT JOIN td ON td.instrument = tr.instrument AND td.t0 = tr.rn" if trail else ""
    return f"""{TRIG}{', ' + TRAIL if trail else ''},
ex AS (SELECT tr.*, list_min([{structs}]) AS x FROM tr {join}),
oc AS (SELECT ex.instrument, ex.session_date, ex.rn, ex.buy_price, ex.x.idx AS exit_rn, ex.x.reason AS exit_reason,
  c.session_date AS exit_date, c.close AS exit_price, (c.close / ex.buy_price - 1) * 100 AS return_pct
  FROM ex JOIN a c ON c.instrument = ex.instrument AND c.rn = ex.x.idx)"""


SHOW = "instrument, session_date, exit_date, exit_reason, buy_price, exit_price, round(return_pct, 4) AS return_pct"


def publish(name: str, names: list[str]) -> None:
    @query(name, f"WITH {outcome_ctes(names)} SELECT {SHOW} FROM oc")
    def plan(spark, folder):
        out = O.outcomes(flagged(spark, folder), BUY, [RULES[n][0] for n in names])
        return out.select("instrument", "session_date", "exit_date", "exit_reason", "buy_price", "exit_price",
                          F.round("return_pct", 4).alias("return_pct"))


publish("o01_outcomes", ["hold", "stop", "profit"])
publish("o02_hold_sessions", ["hold"])
publish("o03_stop_loss", ["stop"])
publish("o04_take_profit", ["profit"])
publish("o05_trailing_stop", ["trail"])
publish("o06_reverse_signal", ["reverse"])
publish("o07_named_atom", ["atom"])
publish("o08_month_end", ["month"])
publish("o08_quarter_end", ["quarter"])
publish("o09_earliest_of", ["stop", "trail", "profit", "reverse", "quarter", "hold"])

EXITS = ["stop", "profit", "hold"]
CHAIN = f"""{outcome_ctes(EXITS)},
nx AS (SELECT o.*, row_number() OVER (PARTITION BY instrument ORDER BY rn) AS k,
  (SELECT min(n.rn) FROM oc n WHERE n.instrument = o.instrument AND n.rn > o.exit_rn) AS nxt FROM oc o),
ch AS (SELECT * FROM nx WHERE k = 1 UNION ALL SELECT n.* FROM ch JOIN nx n ON n.instrument = ch.instrument AND n.rn = ch.nxt)"""


def chosen(bars):
    """Non-overlapping outcomes of every instrument."""
    return O.non_overlapping(O.outcomes(bars, BUY, [RULES[n][0] for n in EXITS]))


@query("o10_non_overlapping", f"WITH RECURSIVE {CHAIN} SELECT {SHOW} FROM ch")
def o10(spark, folder):
    return chosen(flagged(spark, folder)).select("instrument", "session_date", "exit_date", "exit_reason", "buy_price", "exit_price",
                                        F.round("return_pct", 4).alias("return_pct"))


@query("o11_combined_entry", f"""WITH {TRIG}
SELECT instrument, session_date, CAST(buy AND coalesce(rn > 21 AND close > ({roll('avg', 'close', 20)}), false) AS INT) AS entry FROM a""")
def o11(spark, folder):
    df = with_atoms(bars_by_instrument(spark, folder), [BUY, "close_above_ma_20"])
    return df.select("instrument", "session_date",
                     ((F.col(BUY) == 1) & (F.col("close_above_ma_20") == 1)).cast("int").alias("entry"))


@query("o12_position_anchor", f"""WITH {TRIG},
h AS (SELECT tr.instrument, tr.session_date, tr.buy_price AS anchor, f.rn, f.session_date AS d, f.close,
  greatest(tr.buy_price, max(f.close) OVER (PARTITION BY tr.instrument, tr.rn ORDER BY f.rn)) AS peak
  FROM tr JOIN a f ON f.instrument = tr.instrument AND f.rn > tr.rn),
s AS (SELECT *, CASE WHEN close >= anchor * 1.5 THEN 'take_profit' WHEN close <= anchor * (1 - CAST(30 AS DOUBLE) / 100) THEN 'stop_loss'
  WHEN close <= peak * (1 - CAST(60 AS DOUBLE) / 100) THEN 'trailing' END AS rule FROM h)
SELECT instrument, session_date, anchor, min(d) AS exit_date, arg_min(rule, d) AS exit_rule FROM s WHERE rule IS NOT NULL GROUP BY ALL""")
def o12(spark, folder):
    """Return and drawdown exits relative to the fill price of each entry."""
    ax = DAILY
    bars = flagged(spark, folder).withColumns({"rn": ax.row(), "anchor": ax.lead("open")})
    entry = F.coalesce((F.col(BUY) == 1) & (F.col("anchor") > 0), F.lit(False))
    b = O.with_reach(O.with_records(bars, entry, ax), ax).withColumn("_entry", entry)
    low = 1 - 60.0 / 100
    falls_from = F.col("_record") & (F.col("close") * low >= F.col("_lowest"))
    b = b.withColumn("_trails", F.coalesce(falls_from, F.lit(False))).filter("_entry or _trails")
    b = materialise(b.select("instrument", "session_date", "rn", "close", "anchor", "_lowest", "_highest", "_entry", "_trails"), "exit-starts")
    asked = F.col("_entry")
    found = O.first_passages(bars.select("instrument", "rn", "close"), b, {
        "_tp": (F.col("anchor") * 1.5, False, asked & (F.col("anchor") * 1.5 <= F.col("_highest"))),
        "_sl": (F.col("anchor") * (1 - 30.0 / 100), True, asked & (F.col("anchor") * (1 - 30.0 / 100) >= F.col("_lowest"))),
        "_tr": (F.col("anchor") * low, True, asked & (F.col("anchor") * low >= F.col("_lowest"))), "_drop": (F.col("close") * low, True, F.col("_trails"))})
    t = b.join(found.hint("merge"), ["instrument", "rn"], "left").withColumn("_trail", F.min("_drop").over(ax.ahead(1)))
    t = t.filter("_entry").withColumn("_tr", F.least("_tr", "_trail"))
    first = F.array_min(F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("rn"), F.lit(i).alias("i"), F.lit(n).alias("rule")))
        for i, (c, n) in enumerate((("_tp", "take_profit"), ("_sl", "stop_loss"), ("_tr", "trailing")))
    ]))
    t = t.withColumn("_x", first).filter(F.col("_x").isNotNull()).select(
        "instrument", "session_date", "anchor", F.col("_x.rn").alias("rn"), F.col("_x.rule").alias("exit_rule"))
    dates = bars.select("instrument", "rn", F.col("session_date").alias("exit_date"))
    return t.join(dates.hint("merge"), ["instrument", "rn"]).drop("rn")


@query("o13_first_available_exit", f"""WITH {TRIG},
c AS (SELECT instrument, session_date, {RULES['stop'][1]} AS hit, 'stop' AS ref FROM tr UNION ALL
      SELECT instrument, session_date, {RULES['profit'][1]}, 'profit' FROM tr UNION ALL
      SELECT instrument, session_date, {RULES['month'][1]}, 'month' FROM tr)
SELECT instrument, session_date, min(hit) AS available_rn, arg_min(ref, {{'a': hit, 'r': ref}}) AS ref FROM c WHERE hit IS NOT NULL GROUP BY 1, 2""")
def o13(spark, folder):
    names = ["stop", "profit", "month"]
    t = O.label_exits(flagged(spark, folder), BUY, [RULES[n][0] for n in names])
    rows = F.array(*[F.struct(F.col(f"exit_{i}.idx").alias("available_rn"), F.lit(n).alias("ref"),
                              F.col(f"exit_{i}.reason").alias("reason")) for i, n in enumerate(names)])
    c = t.select("instrument", "session_date", F.explode(rows).alias("c")).select("instrument", "session_date", "c.*")
    c = c.filter(F.col("reason").startswith("hit_"))
    return O.first_available(c, ["instrument", "session_date"], "available_rn", "ref")


@query("o14_entry_occurrences", f"""WITH {SUSP},
s AS (SELECT *, close > ({roll('avg', 'close', 20)}) AS st FROM v),
p AS (SELECT b.instrument, b.session_date, s.st FROM susp b LEFT JOIN s USING (instrument, session_date)),
q AS (SELECT *, last_value(st IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p)
SELECT instrument, session_date, CASE WHEN NOT st THEN false WHEN st AND NOT coalesce(prev, false) THEN true END AS occurrence FROM q""")
def o14(spark, folder):
    df = study_ma(bars_suspended(spark, folder), TRADED, 20, "close")
    df = df.withColumn("st", F.when(F.col("tradable"), F.col("close") > F.col("ma")))
    return O.entry_occurrences(df, "st", DAILY).select("instrument", "session_date", "occurrence")


@query("o15_event_occurrences", """WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, json_extract_string(props, '$.k') AS k FROM events),
f AS (SELECT user_id, k, min(day) AS day FROM e GROUP BY 1, 2)
SELECT user_id, day, count(DISTINCT k) AS evidence_keys, count(DISTINCT k) FILTER (WHERE f_day = day) > 0 AS fresh
FROM (SELECT e.*, f.day AS f_day FROM e JOIN f USING (user_id, k)) GROUP BY 1, 2""")
def o15(spark, folder):
    """An event row counts only if it brings evidence its subject has not shown before."""
    e = table(spark, folder, "events").select(
        "user_id", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").alias("k"))
    seen = e.groupBy("user_id", "day", "k").agg(F.lit(1).alias("_one"))
    new = e.groupBy("user_id", "k").agg(F.min("day").alias("day")).groupBy("user_id", "day").agg(F.lit(True).alias("fresh"))
    days = seen.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("evidence_keys"))
    return days.join(new, ["user_id", "day"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))


@query("o16_investment_schedule", """WITH s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem),
r AS (SELECT min(d) AS lo, max(d) AS hi FROM s),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day, lo, hi FROM r),
p AS (SELECT day, 'weekly' AS frequency, 100 AS budget FROM days WHERE isodow(day) = 3 UNION ALL
      SELECT day, 'monthly', 1000 FROM days WHERE day(day) = least(31, day(last_day(day)))),
t AS (SELECT p.frequency, p.budget, (SELECT min(d) FROM s WHERE d >= p.day) AS session_date FROM p)
SELECT frequency, session_date, CAST(sum(budget) AS BIGINT) AS budget FROM t WHERE session_date IS NOT NULL GROUP BY 1, 2""")
def o16(spark, folder):
    """Weekly and monthly plan dates rolled forward to a session; budgets on one session merge."""
    s = calendar(spark, folder).select("session_date")
    span = s.agg(F.min("session_date").alias("lo"), F.max("session_date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    weekly = days.filter(F.weekday("day") + 1 == 3).select("day", F.lit("weekly").alias("frequency"), F.lit(100).alias("budget"))
    monthly = days.filter(F.dayofmonth("day") == F.least(F.lit(31), F.dayofmonth(F.last_day("day")))).select(
        "day", F.lit("monthly").alias("frequency"), F.lit(1000).alias("budget"))
    from tidemark.operators.asof import next_session

    planned = next_session(weekly.unionByName(monthly), s, "day", "session_date", strict=False)
    return planned.filter(F.col("session_date").isNotNull()).groupBy("frequency", "session_date").agg(
        F.sum("budget").alias("budget"))


# ---- curves and statistics -----------------------------------------------------------

INDEX = "ix AS (SELECT session_date, CAST(sum(CAST(close AS DECIMAL(18,2))) AS DOUBLE) AS benchmark FROM bars GROUP BY 1)"
CURVE = f"""{BARS}, {INDEX},
cv AS (SELECT b.instrument, b.session_date, b.close AS equity, ix.benchmark FROM bars b JOIN ix USING (session_date)),
cp AS (SELECT *, equity / max(equity) OVER (PARTITION BY instrument ORDER BY session_date) - 1 AS dd, equity / {lag('equity')} - 1 AS ret FROM cv),
cs AS (SELECT instrument, arg_min(equity, session_date) AS e0, arg_max(equity, session_date) AS e1, count(*) AS n, min(dd) AS dd,
  avg(ret) AS mu, stddev_samp(ret) AS sd, count(ret) AS nr, max(session_date) - min(session_date) AS days,
  arg_min(benchmark, session_date) AS b0, arg_max(benchmark, session_date) AS b1 FROM cp GROUP BY 1)"""


def curves(bars):
    """Each instrument's close as its curve, against the sum of all closes of the day."""
    bars = bars.select("instrument", "session_date", "close")
    index = bars.groupBy("session_date").agg(F.sum(F.col("close").cast("decimal(18,2)")).cast("double").alias("benchmark"))
    return bars.withColumnRenamed("close", "equity").join(index, "session_date")


@query("a05_classic_metrics", f"""WITH {CURVE}
SELECT instrument, round(e1 / e0 - 1, 6) AS total_return, round(power(e1 / e0, 252.0 / n) - 1, 6) AS annual_return,
  round(dd, 6) AS max_drawdown, round((mu - 0.025 / 252) / sd * sqrt(252.0), 6) AS sharpe, round(b1 / b0 - 1, 6) AS benchmark_return FROM cs""")
def a05(spark, folder):
    m = M.classic_metrics(M.curve_summary(curves(stored_bars(spark, folder)), benchmark="benchmark"))
    names = ("total_return", "annual_return", "max_drawdown", "sharpe", "benchmark_return")
    return m.select("instrument", *[F.round(c, 6).alias(c) for c in names])


def stored_bars(spark, folder):
    return materialise(bars_daily(spark, folder), "bars")


def round_trips(bars):
    return chosen(bars).select(
        "instrument",
        (F.col("exit_price") - F.col("buy_price")).cast("decimal(18,2)").cast("double").alias("net_pnl"),
        F.datediff("exit_date", "session_date").alias("holding_days"),
    )


@query("a06_calendar_metrics", f"""WITH RECURSIVE {CHAIN}, {CURVE.replace(BARS + ', ', '')},
rt AS (SELECT instrument, CAST(CAST(exit_price - buy_price AS DECIMAL(18,2)) AS DOUBLE) AS pnl, exit_date - session_date AS hd FROM ch),
ts AS (SELECT instrument, count(*) AS nt, avg(CAST(pnl > 0 AS INT)) AS wr, coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS gp,
  coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0) AS gl, avg(hd) AS ah FROM rt GROUP BY 1)
SELECT cs.instrument, round(e1 / e0 - 1, 6) AS total_return, round(power(e1 / e0, 365.2425 / days) - 1, 6) AS annualized_return,
  round(sd * sqrt(252.0), 6) AS annualized_volatility, round(mu / sd * sqrt(252.0), 6) AS sharpe_ratio, round(dd, 6) AS max_drawdown,
  round((e1 / e0 - 1) - (b1 / b0 - 1), 6) AS excess_return, coalesce(nt, 0) AS trade_count, round(wr, 6) AS win_rate,
  CASE WHEN gl > 0 THEN round(gp / gl, 4) WHEN gp > 0 THEN CAST('inf' AS DOUBLE) END AS profit_factor, round(ah, 4) AS average_holding_days,
  CASE WHEN coalesce(nt, 0) < 30 THEN 'sample_too_small_for_strong_inference' END AS warning
FROM cs LEFT JOIN ts USING (instrument)""")
def a06(spark, folder):
    bars = flagged(spark, folder)
    m = M.calendar_metrics(M.curve_summary(curves(bars), benchmark="benchmark"), round_trips(bars))
    six = ("total_return", "annualized_return", "annualized_volatility", "sharpe_ratio", "max_drawdown", "excess_return", "win_rate")
    return m.select("instrument", *[F.round(c, 6).alias(c) for c in six], F.round("profit_factor", 4).alias("profit_factor"),
                    F.round("average_holding_days", 4).alias("average_holding_days"), "trade_count", "warning")


def trade_log(bars):
    """BUY and SELL rows of the non-overlapping trades, 100 shares each."""
    t = chosen(bars)
    legs = F.array(
        F.struct(F.lit("BUY").alias("action"), F.col("session_date").alias("date"), F.col("rn").alias("at"),
                 F.col("buy_price").alias("price"), F.lit("signal").alias("reason")),
        F.struct(F.lit("SELL").alias("action"), F.col("exit_date").alias("date"), F.col("exit_rn").alias("at"),
                 F.col("exit_price").alias("price"), F.col("exit_reason").alias("reason")),
    )
    return t.select("instrument", F.explode(legs).alias("l")).select("instrument", "l.*")


LOG_AXIS = Axis(("instrument",), ("at", "action"))


@query("a07_round_trips", f"""WITH RECURSIVE {CHAIN},
p AS (SELECT instrument, (exit_price - buy_price) / buy_price AS r, exit_date - session_date AS hd FROM ch),
q AS (SELECT instrument, count(*) AS closed_trades, avg(CAST(r > 0 AS INT)) AS wr, coalesce(avg(r) FILTER (WHERE r > 0), 0) AS w,
  abs(coalesce(avg(r) FILTER (WHERE r <= 0), 0)) AS l, count(*) FILTER (WHERE r > 0) AS nw, avg(hd) AS h FROM p GROUP BY 1)
SELECT instrument, closed_trades, round(wr, 6) AS win_rate, round(CASE WHEN l > 0 THEN w / l WHEN nw = 0 THEN 0 END, 6) AS profit_loss_ratio,
  round(h, 4) AS avg_holding_days FROM q""")
def a07(spark, folder):
    s = M.round_trip_stats(M.pair_trades(trade_log(flagged(spark, folder)), LOG_AXIS), "instrument")
    return s.select("instrument", "closed_trades", F.round("win_rate", 6).alias("win_rate"),
                    F.round("profit_loss_ratio", 6).alias("profit_loss_ratio"), F.round("avg_holding_days", 4).alias("avg_holding_days"))


@query("a08_trade_summary", f"""WITH RECURSIVE {CHAIN},
p AS (SELECT instrument, session_date, exit_date, exit_reason, (exit_price - buy_price) / buy_price AS r, exit_date - session_date AS hd FROM ch),
m AS (SELECT instrument, count(DISTINCT date_trunc('month', d)) AS active_months FROM
  (SELECT instrument, session_date AS d FROM p UNION ALL SELECT instrument, exit_date FROM p) GROUP BY 1)
SELECT instrument, count(*) AS total_buys, count(*) AS total_sells, count(*) FILTER (WHERE r > 0) AS profitable_trades,
  count(*) FILTER (WHERE r < 0) AS losing_trades, CAST(max(hd) AS INT) AS max_holding_days, round(max(r), 4) AS best_trade_pct,
  round(min(r), 4) AS worst_trade_pct, any_value(active_months) AS active_months,
  count(*) FILTER (WHERE exit_reason LIKE 'hit_stop_loss%') AS stop_loss_count,
  count(*) FILTER (WHERE exit_reason LIKE 'hit_take_profit%') AS stop_profit_count FROM p JOIN m USING (instrument) GROUP BY 1""")
def a08(spark, folder):
    log = materialise(trade_log(flagged(spark, folder)), "trade-log")
    pairs = M.pair_trades(log, LOG_AXIS).groupBy("instrument").agg(
        F.count_if(F.col("ret") > 0).alias("profitable_trades"), F.count_if(F.col("ret") < 0).alias("losing_trades"),
        F.max("hold_days").alias("max_holding_days"), F.round(F.max("ret"), 4).alias("best_trade_pct"),
        F.round(F.min("ret"), 4).alias("worst_trade_pct"))
    totals = log.groupBy("instrument").agg(
        F.count_if(F.col("action") == "BUY").alias("total_buys"), F.count_if(F.col("action") == "SELL").alias("total_sells"),
        F.count_distinct(F.trunc("date", "month")).alias("active_months"),
        F.count_if(F.col("reason").startswith("hit_stop_loss")).alias("stop_loss_count"),
        F.count_if(F.col("reason").startswith("hit_take_profit")).alias("stop_profit_count"))
    return totals.join(pairs, "instrument")


@query("a09_month_end_curve", f"""WITH {BARS},
m AS (SELECT instrument, date_trunc('month', session_date) AS mo, max(session_date) AS date, arg_max(close, session_date) AS val FROM bars GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY mo) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS n,
  first_value(val) OVER (PARTITION BY instrument ORDER BY mo) AS base FROM m),
k AS (SELECT DISTINCT instrument, CAST(floor(g * (n - 1) / 59.0 + 1e-9) AS BIGINT) AS i FROM n, generate_series(0, 59) t(g) WHERE n > 60)
SELECT instrument, date, round(val / base * 100, 2) AS value FROM n
WHERE n <= 60 OR EXISTS (SELECT 1 FROM k WHERE k.instrument = n.instrument AND k.i = n.i)""")
def a09(spark, folder):
    return M.month_end_curve(bars_daily(spark, folder).withColumnRenamed("close", "equity"))


@query("a10_result_series", f"""WITH {CURVE}
SELECT instrument, session_date, round(equity / first_value(equity) OVER w * 100, 4) AS equity_index,
  round(benchmark / first_value(benchmark) OVER w * 100, 4) AS benchmark_index, round(dd, 6) AS drawdown FROM cp
WINDOW w AS (PARTITION BY instrument ORDER BY session_date)""")
def a10(spark, folder):
    s = M.result_series(curves(stored_bars(spark, folder)))
    return s.select("instrument", "session_date", F.round("equity_index", 4).alias("equity_index"),
                    F.round("benchmark_index", 4).alias("benchmark_index"), F.round("drawdown", 6).alias("drawdown"))


@query("a16_scenario_sweep", f"""WITH {outcome_ctes(EXITS)},
sc AS (SELECT * FROM (VALUES ('base', 10.0, 0.05), ('slippage_1_5x', 15.0, 0.05), ('slippage_2x', 20.0, 0.05),
  ('participation_2_5pct', 10.0, 0.025), ('participation_10pct', 10.0, 0.1)) t(scenario_id, bps, rate)),
n AS (SELECT scenario_id, CAST(bps AS DOUBLE) AS slippage_bps, CAST(rate AS DOUBLE) AS participation_rate,
  (exit_price * (1 - bps / 10000) / (oc.buy_price * (1 + bps / 10000)) - 1) * least(1.0, rate * a.volume / 100.0) AS net
  FROM oc JOIN a USING (instrument, session_date) CROSS JOIN sc),
p AS (SELECT scenario_id, slippage_bps, participation_rate, count(*) AS trade_count, avg(net) AS mr, min(net) AS wr FROM n GROUP BY ALL)
SELECT scenario_id, slippage_bps, participation_rate, trade_count, round(mr, 8) AS mean_return, round(wr, 8) AS worst_return,
  round(min(mr) OVER (), 8) AS range_min, round(max(mr) OVER (), 8) AS range_max FROM p""")
def a16(spark, folder):
    bars = flagged(spark, folder)
    oc = O.outcomes(bars, BUY, [RULES[n][0] for n in EXITS]).join(
        bars.select("instrument", "session_date", "volume"), ["instrument", "session_date"])
    s = M.stress(oc, M.scenarios(10.0, 0.05))
    return s.select("scenario_id", "slippage_bps", "participation_rate", "trade_count",
                    *[F.round(c, 8).alias(c) for c in ("mean_return", "worst_return", "range_min", "range_max")])


@query("a18_mark_to_market", f"""WITH RECURSIVE {CHAIN},
l AS (SELECT instrument, rn + 1 AS rn, -100 * buy_price AS cash, 100 AS sh FROM ch UNION ALL
      SELECT instrument, exit_rn, 100 * exit_price, -100 FROM ch),
f AS (SELECT instrument, rn, sum(cash) AS cash, sum(sh) AS sh FROM l GROUP BY 1, 2)
SELECT a.instrument, a.session_date, round(1000000 + coalesce(sum(f.cash) OVER w, 0), 2) AS cash, CAST(coalesce(sum(f.sh) OVER w, 0) AS BIGINT) AS shares,
  round(1000000 + coalesce(sum(f.cash) OVER w, 0) + coalesce(sum(f.sh) OVER w, 0) * a.close, 2) AS equity
FROM a LEFT JOIN f USING (instrument, rn) WINDOW w AS (PARTITION BY a.instrument ORDER BY a.session_date)""")
def a18(spark, folder):
    bars = flagged(spark, folder)
    numbered = bars.withColumn("at", DAILY.row()).select("instrument", "at", "session_date")
    log = trade_log(bars).withColumn("at", F.when(F.col("action") == "BUY", F.col("at") + 1).otherwise(F.col("at")))
    buys = F.col("action") == "BUY"
    log = log.join(numbered.hint("merge"), ["instrument", "at"]).select(
        "instrument", "session_date",
        F.when(buys, -100 * F.col("price")).otherwise(100 * F.col("price")).alias("cash_flow"),
        F.when(buys, 100).otherwise(-100).alias("share_change"))
    e = M.mark_to_market(log, bars, 1000000.0)
    return e.select("instrument", "session_date", F.round("cash", 2).alias("cash"), "shares", F.round("equity", 2).alias("equity"))


PAIRS = ", ".join(f"('{b}', '{s}')" for b, s in REVERSE_OF.items())


@query("j22_reverse_pairs", f"""WITH {TRIG}, p AS (SELECT * FROM (VALUES {PAIRS}) t(buy_atom, sell_atom)),
x AS (SELECT instrument, 'ma_5_cross_up_10' AS atom FROM a WHERE buy UNION ALL SELECT instrument, 'ma_5_cross_down_10' FROM a WHERE rev),
c AS (SELECT instrument, atom, count(*) AS n FROM x GROUP BY 1, 2)
SELECT b.instrument, p.buy_atom, p.sell_atom, b.n AS buys, coalesce(s.n, 0) AS sells FROM c b JOIN p ON p.buy_atom = b.atom
LEFT JOIN c s ON s.instrument = b.instrument AND s.atom = p.sell_atom""")
def j22(spark, folder):
    pairs = spark.createDataFrame(list(REVERSE_OF.items()), "buy_atom string, sell_atom string")
    fired = flagged(spark, folder).select("instrument", F.explode(F.array(*[
        F.when(F.col(a) == 1, F.lit(a)) for a in (BUY, REV)])).alias("atom")).filter("atom is not null")
    n = fired.groupBy("instrument", "atom").agg(F.count(F.lit(1)).alias("n"))
    b = n.join(F.broadcast(pairs), n.atom == pairs.buy_atom).select("instrument", "buy_atom", "sell_atom", F.col("n").alias("buys"))
    s = n.select("instrument", F.col("atom").alias("sell_atom"), F.col("n").alias("sells"))
    return b.join(s, ["instrument", "sell_atom"], "left").fillna(0, ["sells"])
