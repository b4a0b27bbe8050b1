"""Published point-in-time, alignment, reconciliation and set joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.kleene import compare
from tidemark.functions.windows import DAILY
from tidemark.operators import asof
from tidemark.operators.atoms import with_atoms
from tidemark.plans.outcomes import BUY, TRIG
from tidemark.operators.coverage import calendar_gaps
from tidemark.plans.registry import query
from tidemark.plans.sql import BARS, NUMBERED
from tidemark.plans.atoms import FFILL_PE
from tidemark.sources import market as mk
from tidemark.sources.tables import table

KEYS = ["instrument", "session_date"]
FACTS = """fx AS (SELECT o_custkey % (SELECT count(*) FROM supplier) AS instrument,
  CAST(date_trunc('quarter', o_orderdate) - INTERVAL 1 DAY AS DATE) AS report_period, CAST(o_orderdate AS DATE) AS notice_date,
  o_totalprice AS value, o_orderkey AS revision_id, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"""


def bars_sql(name: str, where: str) -> str:
    from tidemark.plans.sql import PX, TICK, TICK_NO

    return f"""{name} AS (SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS session_date,
  first({PX} ORDER BY {TICK}) AS open, max({PX}) AS high, min({PX}) AS low, last({PX} ORDER BY {TICK}) AS close, sum(l_quantity) AS volume,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, count(*) AS ticks, max({TICK_NO}) AS available_no
  FROM lineitem WHERE {where} GROUP BY 1, 2)"""


def lines(status: str):
    return F.col("l_linestatus") == status



@query("j01_alignment", f"""WITH {bars_sql('e', 'true')}, {bars_sql('s', "l_linestatus = 'O'")}
SELECT coalesce(e.instrument, s.instrument) AS instrument, coalesce(e.session_date, s.session_date) AS session_date,
  CASE WHEN s.instrument IS NULL THEN 'missing_signal' WHEN e.instrument IS NULL THEN 'missing_execution'
       WHEN e.available_no <> s.available_no THEN 'availability_differs' END AS violation
FROM e FULL JOIN s ON e.instrument = s.instrument AND e.session_date = s.session_date""")
def j01(spark, folder):
    """Execution and signal bars must pair one to one and become known together."""
    e = mk.bars_of(spark, folder, F.lit(True)).select(*KEYS, F.col("available_no").alias("e_at"))
    s = mk.bars_of(spark, folder, lines("O")).select(*KEYS, F.col("available_no").alias("s_at"))
    bad = (F.when(F.col("s_at").isNull(), "missing_signal").when(F.col("e_at").isNull(), "missing_execution")
           .when(F.col("e_at") != F.col("s_at"), "availability_differs"))
    return e.join(s, KEYS, "full_outer").select(*KEYS, bad.alias("violation"))


PIT = f"""{BARS}, {FACTS},
pit AS (SELECT b.instrument, b.session_date, max({{'p': report_period, 'n': notice_date, 'r': revision_id,
   'v': CASE WHEN status <> 'P' THEN value END}}) AS m
  FROM bars b LEFT JOIN fx ON fx.instrument = b.instrument AND fx.notice_date <= b.session_date GROUP BY 1, 2)"""


def pit_rows(spark, folder):
    f = mk.facts(spark, folder).withColumn("value", F.when(F.col("status") != "P", F.col("value")))
    return asof.latest_known(mk.bars_daily(spark, folder), f, ["instrument"], "session_date", "notice_date",
                             ["report_period", "notice_date", "revision_id"], ["value"])


@query("j02_point_in_time", f"""WITH {PIT}
SELECT instrument, session_date, m.p AS report_period, m.r AS revision_id, m.v AS value, m.v > 200000 AS signal FROM pit""")
def j02(spark, folder):
    return pit_rows(spark, folder).select(
        *KEYS, F.col("fact_report_period").alias("report_period"), F.col("fact_revision_id").alias("revision_id"),
        F.col("fact_value").alias("value"), (F.col("fact_value") > 200000).alias("signal"))


OPS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "=", "ne": "<>"}


@query("p02_financial_comparators", f"""WITH {PIT}
SELECT instrument, session_date, {', '.join(f'm.v {s} 241837.37 AS {n}' for n, s in OPS.items())} FROM pit""")
def p02(spark, folder):
    v, t = F.col("fact_value").cast("decimal(18,2)"), F.lit("241837.37").cast("decimal(18,2)")
    return pit_rows(spark, folder).select(*KEYS, *[compare(n, v, t).alias(n) for n in OPS])


DISC = """rp AS (SELECT instrument, report_period, min(notice_date) AS notice_date,
  arg_min(value, {'n': notice_date, 'r': revision_id}) AS value FROM fx GROUP BY 1, 2)"""


@query("j03_disclosed_reports", f"""WITH {BARS}, {FACTS}, {DISC}
SELECT b.instrument, b.session_date, max({{'p': report_period, 'n': notice_date, 'v': value}}).p AS report_period,
  max({{'p': report_period, 'n': notice_date, 'v': value}}).v AS value
FROM bars b LEFT JOIN rp ON rp.instrument = b.instrument AND rp.notice_date < b.session_date GROUP BY 1, 2""")
def j03(spark, folder):
    """Date-only disclosures count from the session after publication; an old period never comes back."""
    reports = mk.facts(spark, folder).groupBy("instrument", "report_period").agg(
        F.min("notice_date").alias("notice_date"),
        F.min(F.struct("notice_date", "revision_id", "value")).alias("_first")
    ).select("instrument", "report_period", "notice_date", F.col("_first.value").alias("value"))
    out = asof.latest_known(mk.bars_daily(spark, folder), reports, ["instrument"], "session_date", "notice_date",
                            ["report_period", "notice_date"], ["value"], strict=True)
    return out.select(*KEYS, F.col("fact_report_period").alias("report_period"), F.col("fact_value").alias("value"))


def sessions_of(spark, folder):
    return mk.ticks(spark, folder).select(*KEYS).distinct()


SESS = f"{FACTS}, ss AS (SELECT DISTINCT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS d FROM lineitem)"


def next_sql(op: str, day: str = "fx.notice_date") -> str:
    return f"(SELECT min(d) FROM ss WHERE ss.instrument = fx.instrument AND ss.d {op} {day})"


@query("j04_event_session", f"WITH {SESS} SELECT instrument, revision_id, notice_date, {next_sql('>=')} AS session_date FROM fx")
def j04(spark, folder):
    f = mk.facts(spark, folder).select("instrument", "revision_id", "notice_date")
    return asof.next_own_session(f, sessions_of(spark, folder), ["instrument"], "notice_date", "session_date")


@query("j05_earliest_tradable", f"""WITH {SESS},
t AS (SELECT fx.instrument, fx.revision_id, CAST(notice_date AS TIMESTAMP) + to_seconds(revision_id * 7919 % 86400) AS t_at,
  notice_date, {next_sql('>=')} AS s0, {next_sql('>')} AS s1 FROM fx),
u AS (SELECT *, t_at - CAST(notice_date AS TIMESTAMP) AS c FROM t)
SELECT instrument, revision_id, t_at AS available_at, CASE
  WHEN s0 IS NULL THEN NULL WHEN s0 <> notice_date THEN CAST(s0 AS TIMESTAMP) + INTERVAL 570 MINUTE
  WHEN c < INTERVAL 570 MINUTE THEN CAST(s0 AS TIMESTAMP) + INTERVAL 570 MINUTE WHEN c < INTERVAL 690 MINUTE THEN t_at
  WHEN c < INTERVAL 780 MINUTE THEN CAST(s0 AS TIMESTAMP) + INTERVAL 780 MINUTE WHEN c < INTERVAL 900 MINUTE THEN t_at
  ELSE CAST(s1 AS TIMESTAMP) + INTERVAL 570 MINUTE END AS tradable_at FROM u""")
def j05(spark, folder):
    f = mk.facts(spark, folder).select("instrument", "revision_id", (
        F.col("notice_date").cast("timestamp_ntz")
        + F.make_dt_interval(secs=(F.col("revision_id") * 7919 % 86400).cast("decimal(18,6)"))).alias("available_at"))
    return asof.earliest_tradable(f, sessions_of(spark, folder), ["instrument"], "available_at", "tradable_at")


@query("j06_next_session", f"WITH {SESS} SELECT instrument, revision_id, notice_date, {next_sql('>')} AS next_session FROM fx")
def j06(spark, folder):
    f = mk.facts(spark, folder).select("instrument", "revision_id", "notice_date")
    return asof.next_own_session(f, sessions_of(spark, folder), ["instrument"], "notice_date", "next_session", strict=True)


@query("j07_holding_due", f"""WITH {BARS}, c AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS n FROM (SELECT DISTINCT session_date FROM bars))
SELECT b.instrument, b.session_date, d.session_date AS due_session FROM bars b JOIN c USING (session_date) LEFT JOIN c d ON d.n = c.n + 20""")
def j07(spark, folder):
    """The 20th market session after a fill; the instrument's own suspensions do not matter."""
    c = mk.calendar(spark, folder)
    due = c.select((F.col("session_no") - 20).alias("session_no"), F.col("session_date").alias("due_session"))
    map_ = c.join(due, "session_no", "left").drop("session_no")
    return mk.bars_daily(spark, folder).select(*KEYS).join(map_, "session_date")


@query("j08_report_announcement", f"""WITH {FACTS},
r AS (SELECT instrument, report_period, count(*) AS reports FROM fx WHERE status = 'F' GROUP BY 1, 2),
a AS (SELECT instrument, report_period, count(DISTINCT priority) AS signatures, min(notice_date) AS published, min(priority) AS signature
  FROM fx WHERE status = 'O' GROUP BY 1, 2)
SELECT r.instrument, r.report_period, reports, CASE WHEN signatures IS NULL THEN 'missing' WHEN signatures = 1 THEN 'matched' ELSE 'ambiguous' END AS status,
  CASE WHEN signatures = 1 THEN published END AS published, CASE WHEN signatures = 1 THEN signature END AS signature
FROM r LEFT JOIN a USING (instrument, report_period)""")
def j08(spark, folder):
    """A report takes its publication from exactly one semantically distinct announcement."""
    f, k = mk.facts(spark, folder), ["instrument", "report_period"]
    r = f.filter(F.col("status") == "F").groupBy(*k).agg(F.count(F.lit(1)).alias("reports"))
    a = f.filter(F.col("status") == "O").groupBy(*k).agg(
        F.count_distinct("priority").alias("n"), F.min("notice_date").alias("p"), F.min("priority").alias("s"))
    one = F.col("n") == 1
    return r.join(a, k, "left").select(
        *k, "reports", F.when(F.col("n").isNull(), "missing").when(one, "matched").otherwise("ambiguous").alias("status"),
        F.when(one, F.col("p")).alias("published"), F.when(one, F.col("s")).alias("signature"))


@query("j09_publication_times", f"""WITH {FACTS}, p AS (SELECT instrument, report_period, min(notice_date) AS published FROM fx WHERE status = 'O' GROUP BY 1, 2)
SELECT fx.instrument, fx.report_period, fx.revision_id, p.published, p.published IS NULL AS missing
FROM fx LEFT JOIN p USING (instrument, report_period) WHERE fx.status = 'F'""")
def j09(spark, folder):
    f, k = mk.facts(spark, folder), ["instrument", "report_period"]
    p = f.filter(F.col("status") == "O").groupBy(*k).agg(F.min("notice_date").alias("published"))
    return f.filter(F.col("status") == "F").join(p, k, "left").select(
        *k, "revision_id", "published", F.col("published").isNull().alias("missing"))


@query("j10_two_series", f"""WITH {BARS}, {bars_sql('o', "l_linestatus = 'O'")}
SELECT b.instrument, b.session_date, b.close AS left_value, o.close AS right_value,
  CAST(b.session_date + CAST(b.instrument % 2 AS INT) AS DATE) AS available_on, b.close > o.close AS signal
FROM bars b JOIN o USING (instrument, session_date)
WHERE CASE WHEN b.instrument % 5 = 0 THEN 'USD' ELSE 'CNY' END = 'CNY'""")
def j10(spark, folder):
    """Two dated series compare only where their units agree; known with the later side."""
    unit = F.when(F.col("instrument") % 5 == 0, "USD").otherwise("CNY")
    a = mk.bars_daily(spark, folder).select(*KEYS, F.col("close").alias("left_value"), unit.alias("unit"), F.col("session_date").alias("a_on"))
    b = mk.bars_of(spark, folder, lines("O")).select(
        *KEYS, F.col("close").alias("right_value"), F.lit("CNY").alias("unit"),
        F.date_add("session_date", (F.col("instrument") % 2).cast("int")).alias("b_on"))
    return a.join(b, [*KEYS, "unit"]).select(
        *KEYS, "left_value", "right_value", F.greatest("a_on", "b_on").alias("available_on"),
        (F.col("left_value") > F.col("right_value")).alias("signal"))


@query("j11_valuation_fill", f"WITH {BARS}, {NUMBERED}, {FFILL_PE} SELECT instrument, session_date, round(pe, 4) AS pe_ttm FROM vp")
def j11(spark, folder):
    out = asof.forward_fill(mk.bars_daily(spark, folder), mk.valuation(spark, folder), ["instrument"], "session_date", ["pe_ttm"],
                            mk.series_parts(spark, folder))
    return out.select(*KEYS, F.round("pe_ttm", 4).alias("pe_ttm"))


@query("j12_axis_union", f"""WITH {bars_sql('e', "l_linestatus = 'O'")}, {bars_sql('m', "l_linestatus = 'F'")},
u AS (SELECT instrument, session_date, e.close AS equity, m.close AS benchmark FROM e FULL JOIN m USING (instrument, session_date))
SELECT instrument, session_date, last_value(equity IGNORE NULLS) OVER w AS equity, last_value(benchmark IGNORE NULLS) OVER w AS benchmark
FROM u WINDOW w AS (PARTITION BY instrument ORDER BY session_date)""")
def j12(spark, folder):
    e = mk.bars_of(spark, folder, lines("O")).select(*KEYS, F.col("close").alias("equity"))
    m = mk.bars_of(spark, folder, lines("F")).select(*KEYS, F.col("close").alias("benchmark"))
    return asof.axis_union(e, m, ["instrument"], "session_date", ["equity", "benchmark"])


RECON = f"""{bars_sql('d', 'true')}, {bars_sql('m', 'l_linenumber < 7')},
rc AS (SELECT instrument, session_date, d.open <> m.open OR d.high <> m.high OR d.low <> m.low OR d.close <> m.close AS price_differs,
  abs(d.volume - m.volume) AS dv, abs(d.amount - m.amount) AS da, d.volume AS volume, d.amount AS amount, m.ticks AS n,
  m.instrument IS NULL OR m.open IS NULL AS no_minutes, d.open IS NULL AS no_daily FROM d FULL JOIN m USING (instrument, session_date))"""


def reconciled(spark, folder):
    """Daily bars against bars rebuilt from finer records that miss some prints."""
    d = mk.bars_daily(spark, folder)
    m = mk.bars_of(spark, folder, F.col("l_linenumber") < 7)
    m = m.select(*KEYS, *[F.col(c).alias(f"m_{c}") for c in ("open", "high", "low", "close", "volume", "amount", "ticks")])
    j = d.join(m, KEYS, "full_outer")
    differs = F.col("open") != F.col("m_open")
    for c in ("high", "low", "close"):
        differs = differs | (F.col(c) != F.col(f"m_{c}"))
    return j.select(
        *KEYS, "volume", "amount", differs.alias("price_differs"), F.col("m_ticks").alias("n"),
        F.abs(F.col("volume") - F.col("m_volume")).alias("dv"), F.abs(F.col("amount") - F.col("m_amount")).alias("da"),
        F.col("m_open").isNull().alias("no_minutes"), F.col("open").isNull().alias("no_daily"))


@query("j13_minute_daily", f"""WITH {RECON} SELECT instrument, session_date, CASE WHEN no_minutes THEN 'missing_minutes'
  WHEN no_daily THEN 'missing_daily' WHEN price_differs THEN 'price' WHEN dv > 0 OR da > 0 THEN 'quantity' ELSE 'ok' END AS status FROM rc""")
def j13(spark, folder):
    return reconciled(spark, folder).select(*KEYS, (
        F.when(F.col("no_minutes"), "missing_minutes").when(F.col("no_daily"), "missing_daily")
        .when(F.col("price_differs"), "price").when((F.col("dv") > 0) | (F.col("da") > 0), "quantity").otherwise("ok")).alias("status"))


@query("q06_minute_daily_tolerance", f"""WITH {RECON} SELECT instrument, session_date, round(dv, 2) AS volume_gap, round(da, 2) AS amount_gap FROM rc
WHERE dv > least(100.0 * (n + 1), volume / 10000) OR da > least(n + 1.0, amount / 10000)""")
def q06(spark, folder):
    r = reconciled(spark, folder)
    return r.filter(
        (F.col("dv") > F.least(100.0 * (F.col("n") + 1), F.col("volume") / 10000))
        | (F.col("da") > F.least(F.col("n") + 1.0, F.col("amount") / 10000))
    ).select(*KEYS, F.round("dv", 2).alias("volume_gap"), F.round("da", 2).alias("amount_gap"))


CELLS = ("open", "high", "low", "close", "volume", "amount")
PREFIX = f"{bars_sql('f', 'true')}, {bars_sql('p', 'l_linenumber < 7 AND l_shipdate < DATE ' + repr('1998-01-01'))}"


def prefix_pair(spark, folder):
    early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    f = mk.bars_daily(spark, folder).filter(F.col("session_date") < F.lit("1998-01-01").cast("date"))
    p = mk.bars_of(spark, folder, (F.col("l_linenumber") < 7) & early)
    return f, p.select(*KEYS, *[F.col(c).alias(f"p_{c}") for c in CELLS])


@query("j14_prefix_cells", f"""WITH {PREFIX}
SELECT f.instrument, count(*) AS sessions, {', '.join(f'count(*) FILTER (WHERE f.{c} IS DISTINCT FROM p.{c}) AS {c}_changed' for c in CELLS)}
FROM f LEFT JOIN p USING (instrument, session_date) WHERE f.session_date < DATE '1998-01-01' GROUP BY 1""")
def j14(spark, folder):
    """Cell-by-cell comparison of a full snapshot with the snapshot of its prefix."""
    f, p = prefix_pair(spark, folder)
    return f.join(p, KEYS, "left").groupBy("instrument").agg(
        F.count(F.lit(1)).alias("sessions"),
        *[F.count_if(~asof.same(F.col(c), F.col(f"p_{c}"))).alias(f"{c}_changed") for c in CELLS])


@query("q07_prefix_instability", f"""WITH {PREFIX} SELECT f.instrument, f.session_date FROM f LEFT JOIN p USING (instrument, session_date)
WHERE f.session_date < DATE '1998-01-01' AND ({' OR '.join(f'f.{c} IS DISTINCT FROM p.{c}' for c in CELLS)})""")
def q07(spark, folder):
    f, p = prefix_pair(spark, folder)
    bad = F.lit(False)
    for c in CELLS:
        bad = bad | ~asof.same(F.col(c), F.col(f"p_{c}"))
    return f.join(p, KEYS, "left").filter(bad).select(*KEYS)


ACT = f"""{FACTS}, act AS (SELECT instrument, revision_id AS action_id, ['cash', 'bonus', 'split', 'rights', 'transfer'][revision_id % 5 + 1] AS kind,
  notice_date AS record_date, CAST(notice_date + 1 AS DATE) AS ex_date, CAST(notice_date + 10 AS DATE) AS pay_date, CAST(notice_date - 7 AS DATE) AS known_date,
  revision_id % 100 / 100.0 AS gross_cash, 1 + revision_id % 3 * 0.5 AS multiplier, status FROM fx)"""
POS = """dq AS (SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS d, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS q
  FROM lineitem GROUP BY 1, 2), ps AS (SELECT instrument, d, sum(q) OVER (PARTITION BY instrument ORDER BY d) AS qty FROM dq)"""


def positions(spark, folder):
    """End-of-day position per instrument: daily net first, then a running sum over days."""
    t = mk.trades(spark, folder)
    signed = F.when(F.col("side") == "sell", -F.col("quantity")).otherwise(F.col("quantity"))
    d = t.groupBy(F.col("account").alias("instrument"), F.col("trade_date").alias("session_date")).agg(F.sum(signed).alias("q"))
    return d.withColumn("position", F.sum("q").over(DAILY.so_far())).drop("q")


def entitled(spark, folder):
    a = mk.corporate_actions(spark, folder)
    return asof.latest_known(a, positions(spark, folder), ["instrument"], "record_date", "session_date",
                             ["session_date"], ["position"])


ENT = f"""{ACT}, {POS}, en AS (SELECT act.*, coalesce(arg_max(ps.qty, ps.d), 0) AS qty FROM act
  LEFT JOIN ps ON ps.instrument = act.instrument AND ps.d <= act.record_date GROUP BY ALL)"""


@query("j17_entitlement", f"""WITH {ENT} SELECT instrument, action_id, record_date, qty AS quantity FROM en""")
def j17(spark, folder):
    return entitled(spark, folder).select(
        "instrument", "action_id", "record_date", F.coalesce("fact_position", F.lit(0.0)).alias("quantity"))


@query("l09_entitlement_amounts", f"""WITH {ENT} SELECT instrument, action_id, kind, qty AS quantity, round(gross_cash * greatest(qty, 0), 2) AS cash,
  CASE WHEN qty * multiplier = floor(qty * multiplier) THEN qty * multiplier END AS shares, qty * multiplier <> floor(qty * multiplier) AS rejected FROM en""")
def l09(spark, folder):
    """Cash and share entitlements; a fractional share result is rejected."""
    q = F.coalesce("fact_position", F.lit(0.0))
    out = q * F.col("multiplier")
    return entitled(spark, folder).select(
        "instrument", "action_id", "kind", q.alias("quantity"), F.round(F.col("gross_cash") * F.greatest(q, F.lit(0.0)), 2).alias("cash"),
        F.when(out == F.floor(out), out).alias("shares"), (out != F.floor(out)).alias("rejected"))


@query("l10_entitlement_stage", f"""WITH {BARS}, {ACT},
x AS (SELECT max(session_date) AS d FROM bars)
SELECT instrument, action_id, CASE WHEN x.d < record_date THEN 'announced' WHEN x.d < ex_date THEN 'captured'
  WHEN x.d <= pay_date THEN 'accrued' ELSE 'settled' END AS stage FROM act, x""")
def l10(spark, folder):
    """Stage of each entitlement on the last market date."""
    last = mk.ticks(spark, folder).agg(F.max("session_date")).scalar()
    a = mk.corporate_actions(spark, folder).withColumn("d", last)
    stage = (F.when(F.col("d") < F.col("record_date"), "announced").when(F.col("d") < F.col("ex_date"), "captured")
             .when(F.col("d") <= F.col("pay_date"), "accrued").otherwise("settled"))
    return a.select("instrument", "action_id", stage.alias("stage"))


@query("j18_latest_revision", f"""WITH {FACTS},
g AS (SELECT instrument, report_period, max({{'n': notice_date, 'r': revision_id, 'v': value, 's': status}}) AS m, count(*) AS revisions, count(DISTINCT status) AS kinds
  FROM fx WHERE notice_date <= report_period + 60 GROUP BY 1, 2)
SELECT instrument, report_period, m.r AS revision_id, m.v AS value, revisions, kinds > 1 AS inconsistent FROM g""")
def j18(spark, folder):
    """Latest revision known by a cut-off of its own period, and whether revisions agree on identity."""
    f = mk.facts(spark, folder).filter(F.col("notice_date") <= F.date_add("report_period", 60))
    g = f.groupBy("instrument", "report_period").agg(
        F.max(F.struct("notice_date", "revision_id", "value")).alias("m"), F.count(F.lit(1)).alias("revisions"),
        F.count_distinct("status").alias("kinds"))
    return g.select("instrument", "report_period", F.col("m.revision_id").alias("revision_id"), F.col("m.value").alias("value"),
                    "revisions", (F.col("kinds") > 1).alias("inconsistent"))


@query("j19_overlay", f"""WITH {bars_sql('b', 'true')}, {bars_sql('s', "l_linestatus = 'O' AND l_tax > 0.04")}
SELECT instrument, session_date, close, 'base' AS origin FROM b ANTI JOIN s USING (instrument, session_date)
UNION ALL SELECT instrument, session_date, close, 'supplement' FROM s""")
def j19(spark, folder):
    b = mk.bars_daily(spark, folder).select(*KEYS, "close", F.lit("base").alias("origin"))
    s = mk.bars_of(spark, folder, lines("O") & (F.col("l_tax") > 0.04)).select(*KEYS, "close", F.lit("supplement").alias("origin"))
    return asof.overlay(b, s, KEYS)


# The calendar is that of the orders, independent of the bars it is held against; bars before its start or after its end are unexpected.
GAPS = f"""{BARS}, c AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session_date FROM orders)),
edge AS (SELECT count(*) + 1 AS z FROM c),
k AS (SELECT instrument, session_date, n FROM bars JOIN c USING (session_date) UNION ALL SELECT DISTINCT instrument, NULL, 0 FROM bars UNION ALL SELECT DISTINCT instrument, NULL, z FROM bars, edge),
h AS (SELECT *, lead(n) OVER w AS nn, lead(session_date) OVER w AS nd FROM k WINDOW w AS (PARTITION BY instrument ORDER BY n)),
gp AS (SELECT instrument, 'missing' AS kind, session_date AS after_session, nd AS before_session, nn - n - 1 AS sessions FROM h WHERE nn > n + 1
 UNION ALL SELECT instrument, 'unexpected', session_date, session_date, 1 FROM bars WHERE session_date NOT IN (SELECT session_date FROM c))"""


def order_calendar(spark, folder):
    return table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("session_date")).distinct()


@query("j20_calendar_coverage", f"WITH {GAPS} SELECT instrument, kind, after_session, before_session, CAST(sessions AS BIGINT) AS sessions FROM gp")
def j20(spark, folder):
    """Runs of expected sessions that an instrument has no bar for, its ends included, and bars outside the calendar."""
    return calendar_gaps(mk.bars_daily(spark, folder).select(*KEYS), order_calendar(spark, folder))


@query("q05_calendar_mismatch", f"""WITH {GAPS} SELECT instrument, CAST(coalesce(sum(sessions) FILTER (WHERE kind = 'missing'), 0) AS BIGINT) AS missing,
 CAST(coalesce(sum(sessions) FILTER (WHERE kind = 'unexpected'), 0) AS BIGINT) AS unexpected FROM gp GROUP BY 1""")
def q05(spark, folder):
    gaps = calendar_gaps(mk.bars_daily(spark, folder).select(*KEYS), order_calendar(spark, folder))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("sessions"))), F.lit(0)).alias(kind)
    return gaps.groupBy("instrument").agg(total("missing"), total("unexpected"))


@query("j21_future_bars", f"""WITH {TRIG} SELECT tr.instrument, tr.session_date, f.rn - tr.rn AS step, f.session_date AS bar_date, f.close
FROM tr JOIN a f ON f.instrument = tr.instrument AND f.rn BETWEEN tr.rn + 1 AND tr.rn + 5""")
def j21(spark, folder):
    b = with_atoms(mk.bars_by_instrument(spark, folder), [BUY]).withColumn("rn", DAILY.row())
    starts = b.filter(F.col(BUY) == 1).select(*KEYS, "rn")
    rows = b.select("instrument", "rn", F.col("session_date").alias("bar_date"), "close")
    return asof.future_rows(starts, rows, ["instrument"], "rn", 5).select(
        *KEYS, F.col("step").cast("long").alias("step"), "bar_date", "close")


@query("j23_dividend_yield", f"""WITH {BARS}, {ACT}, x AS (SELECT max(session_date) AS d FROM bars),
l AS (SELECT instrument, arg_max(close, session_date) AS close FROM bars GROUP BY 1),
y AS (SELECT instrument, sum(gross_cash) AS cash FROM act, x WHERE status = 'F' AND ex_date BETWEEN x.d - 365 AND x.d GROUP BY 1)
SELECT instrument, close AS latest_close, round(coalesce(cash, 0) / close, 8) AS dividend_yield FROM l LEFT JOIN y USING (instrument)""")
def j23(spark, folder):
    from tidemark.operators.factors import dividend_yield

    return dividend_yield(mk.bars_daily(spark, folder), mk.corporate_actions(spark, folder))


@query("j24_presence", """SELECT c_custkey AS instrument, c_custkey IN (SELECT user_id FROM events) AS has_data, c_custkey IN (SELECT o_custkey FROM orders) AS has_facts FROM customer""")
def j24(spark, folder):
    """Semi and anti joins: which instruments have data at all."""
    s = table(spark, folder, "customer").select(F.col("c_custkey").alias("instrument"))
    d = table(spark, folder, "events").select(F.col("user_id").alias("instrument"))
    f = table(spark, folder, "orders").select(F.col("o_custkey").alias("instrument"))
    with_data = s.join(d, "instrument", "left_semi").withColumn("has_data", F.lit(True))
    without = s.join(d, "instrument", "left_anti").withColumn("has_data", F.lit(False))
    fact = f.distinct().withColumn("has_facts", F.lit(True))
    return with_data.unionByName(without).join(fact, "instrument", "left").withColumn("has_facts", F.coalesce("has_facts", F.lit(False)))


@query("u02_date_axis", "SELECT DISTINCT d FROM (SELECT CAST(l_shipdate AS DATE) AS d FROM lineitem UNION SELECT CAST(o_orderdate AS DATE) FROM orders)")
def u02(spark, folder):
    a = table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("d"))
    return a.union(table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d"))).distinct()


@query("u03_key_difference", f"""WITH {FACTS}, s AS (SELECT DISTINCT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS d FROM lineitem),
n AS (SELECT DISTINCT instrument, notice_date AS d FROM fx)
SELECT *, 'no_notice' AS side FROM (SELECT * FROM s EXCEPT SELECT * FROM n) UNION ALL SELECT *, 'no_session' FROM (SELECT * FROM n EXCEPT SELECT * FROM s)""")
def u03(spark, folder):
    s = sessions_of(spark, folder).select("instrument", F.col("session_date").alias("d"))
    n = mk.facts(spark, folder).select("instrument", F.col("notice_date").alias("d")).distinct()
    return s.exceptAll(n).withColumn("side", F.lit("no_notice")).unionByName(n.exceptAll(s).withColumn("side", F.lit("no_session")))


@query("u04_axis_prefix", f"""WITH {BARS}, {bars_sql('e', "l_shipdate < DATE '1998-01-01' OR l_linenumber > 1")},
c AS (SELECT instrument, count(b.close) AS full_n, count(e.close) AS part_n, count(*) FILTER (WHERE b.close IS NOT NULL AND e.close IS NOT NULL) AS both_n,
  min(session_date) FILTER (WHERE e.close IS NULL) AS first_gap, max(session_date) FILTER (WHERE e.close IS NOT NULL) AS last_part
  FROM bars b FULL JOIN e USING (instrument, session_date) GROUP BY 1)
SELECT instrument, full_n, part_n, both_n, full_n = part_n AND both_n = full_n AS equal_axes,
  both_n = part_n AND (first_gap IS NULL OR first_gap > last_part) AS leading_subset FROM c""")
def u04(spark, folder):
    """Is one date axis equal to, or a leading part of, the other?"""
    f = mk.bars_daily(spark, folder).select(*KEYS, F.lit(1).alias("f"))
    cut = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    p = mk.bars_of(spark, folder, cut | (F.col("l_linenumber") > 1)).select(*KEYS, F.lit(1).alias("p"))
    c = f.join(p, KEYS, "full_outer").groupBy("instrument").agg(
        F.count("f").alias("full_n"), F.count("p").alias("part_n"), F.count_if(F.col("f").isNotNull() & F.col("p").isNotNull()).alias("both_n"),
        F.min(F.when(F.col("p").isNull(), F.col("session_date"))).alias("gap"), F.max(F.when(F.col("p").isNotNull(), F.col("session_date"))).alias("last"))
    return c.select("instrument", "full_n", "part_n", "both_n",
                    ((F.col("full_n") == F.col("part_n")) & (F.col("both_n") == F.col("full_n"))).alias("equal_axes"),
                    ((F.col("both_n") == F.col("part_n")) & (F.col("gap").isNull() | (F.col("gap") > F.col("last")))).alias("leading_subset"))


@query("k04_latest_per_key", f"WITH {BARS} SELECT instrument, max(session_date) AS session_date, arg_max(close, session_date) AS close FROM bars GROUP BY 1")
def k04(spark, folder):
    return mk.bars_daily(spark, folder).groupBy("instrument").agg(
        F.max_by("close", "session_date").alias("close"), F.max("session_date").alias("session_date"))

