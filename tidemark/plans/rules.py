"""Published conditions, exchange rules, units, adjustments and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import kleene, units
from tidemark.functions import market_rules as R
from tidemark.functions.windows import DAILY
from tidemark.operators import adjust
from tidemark.operators.conditions import All, Any, Indicator, Not, with_condition
from tidemark.operators.indicators import evaluate
from tidemark.plans.atoms import CHG, CODE, LIMIT
from tidemark.plans.joins import ACT, FACTS, KEYS
from tidemark.plans.registry import query
from tidemark.plans.sql import BARS, NUMBERED, SUSP, W, lag, roll, cross
from tidemark.sources import market as mk
from tidemark.sources.tables import table

B = f"WITH {BARS}, {NUMBERED}"


def decision_day():
    return F.lit("1998-01-01").cast("date")



@query("p01_comparators", f"{B} SELECT instrument, session_date, close > open AS gt, close >= open AS gte, close < open AS lt, close <= open AS lte FROM v")
def p01(spark, folder):
    b = mk.bars_daily(spark, folder)
    return b.select(*KEYS, *[kleene.compare(op, F.col("close"), F.col("open")).alias(op) for op in ("gt", "gte", "lt", "lte")])


@query("p03_crossings", f"{B} SELECT instrument, session_date, {cross('close', 'open', True)} AS above, {cross('close', 'open', False)} AS below FROM v")
def p03(spark, folder):
    from tidemark.functions.windows import crosses_above, crosses_below

    return mk.bars_daily(spark, folder).select(
        *KEYS, crosses_above(DAILY, "close", "open").alias("above"), crosses_below(DAILY, "close", "open").alias("below"))


ABOVE, RISE = Indicator("technical.ma", "price_above"), Indicator("price.return_pct", "above", 10.0)
BREAK = Indicator("price.rolling_high", "new_high")
KL = f"""WITH {SUSP}, l AS (SELECT *, close > ({roll('avg', 'close', 20)}) AS a, (close / {lag('close', 5)} - 1) * 100 > 10 AS r,
  close > (CASE WHEN rn > 20 THEN max(close) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END) AS n FROM v),
k AS (SELECT b.instrument, b.session_date, l.a, l.r, l.n FROM susp b LEFT JOIN l USING (instrument, session_date))"""


def publish_tree(name: str, tree, sql: str) -> None:
    @query(name, f"{KL} SELECT instrument, session_date, {sql} AS signal FROM k")
    def plan(spark, folder):
        return with_condition(mk.bars_suspended(spark, folder), tree, "signal").select(*KEYS, "signal")


publish_tree("p04_all", All((ABOVE, RISE, BREAK)), "a AND r AND n")
publish_tree("p05_any", Any((ABOVE, RISE, BREAK)), "a OR r OR n")
publish_tree("p06_not", All((RISE, Not(Any((ABOVE, Not(BREAK)))))), "r AND NOT (a OR NOT n)")


@query("p07_operands", f"""{B} SELECT instrument, session_date, close > open AS vs_field, close > {lag('close')} AS vs_previous_field, close > 4000 AS vs_value,
 close > open * 1.1 AS vs_scaled_field, close > {lag('close')} * 0.9 AS vs_scaled_previous FROM v""")
def p07(spark, folder):
    """Right-hand operands: a field, its previous value, a constant, each with a multiplier."""
    b = mk.bars_by_instrument(spark, folder).withColumn("_p", DAILY.lag("close"))
    c = F.col("close")
    return b.select(*KEYS, (c > F.col("open")).alias("vs_field"), (c > F.col("_p")).alias("vs_previous_field"), (c > 4000).alias("vs_value"),
                    (c > F.col("open") * 1.1).alias("vs_scaled_field"), (c > F.col("_p") * 0.9).alias("vs_scaled_previous"))


EVID = f"""{FACTS}, e AS (SELECT instrument, report_period, list_sort(list_distinct(list(priority))) AS a, list_sort(list_distinct(list(status))) AS s,
 max(notice_date) AS p, max(notice_date) FILTER (WHERE status = 'F') AS f FROM fx GROUP BY 1, 2)"""


def evidence_rows(spark, folder):
    return mk.facts(spark, folder).groupBy("instrument", "report_period").agg(
        F.collect_set("priority").alias("a"), F.collect_set("status").alias("s"), F.max("notice_date").alias("p"),
        F.max(F.when(F.col("status") == "F", F.col("notice_date"))).alias("f"))


@query("p08_combined_availability", f"WITH {EVID} SELECT instrument, report_period, greatest(p, f) AS available_on FROM e")
def p08(spark, folder):
    return evidence_rows(spark, folder).select("instrument", "report_period", kleene.latest_known(F.col("p"), F.col("f")).alias("available_on"))


@query("p09_evidence_merge", f"WITH {EVID} SELECT instrument, report_period, array_to_string(list_sort(list_distinct(list_concat(a, s))), '|') AS evidence FROM e")
def p09(spark, folder):
    return evidence_rows(spark, folder).select(
        "instrument", "report_period", F.array_join(kleene.merged_evidence(F.col("a"), F.col("s")), "|").alias("evidence"))


@query("p10_suspended_rows", f"""WITH {SUSP}, s AS (SELECT *, {roll('avg', 'close', 5)} AS m FROM v)
SELECT b.instrument, b.session_date, b.volume > 0 AS tradable, round(s.m, 4) AS ma FROM susp b LEFT JOIN s USING (instrument, session_date)""")
def p10(spark, folder):
    out = evaluate(mk.bars_suspended(spark, folder), "technical.ma", (), period=5)
    return out.select(*KEYS, "tradable", F.round("ma", 4).alias("ma"))


@query("p11_typed_attributes", """SELECT event_id, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract(props, '$.k') AS DOUBLE) = 69 AS number_match,
 json_type(props, '$.k') = 'VARCHAR' AND json_extract_string(props, '$.k') = '69' AS text_match, json_type(props, '$.k') = 'BOOLEAN' AS bool_match FROM events""")
def p11(spark, folder):
    """Attribute equality that never equates a number with a text or a truth value."""
    e = table(spark, folder, "events").withColumn("_v", F.try_parse_json("props"))
    kind = F.schema_of_variant(F.variant_get("_v", "$.k", "variant"))
    number = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    return e.select("event_id", (number & (F.try_variant_get("_v", "$.k", "double") == 69)).alias("number_match"),
                    ((kind == "STRING") & (F.try_variant_get("_v", "$.k", "string") == "69")).alias("text_match"), (kind == "BOOLEAN").alias("bool_match"))


@query("p12_limit_threshold", f"SELECT s_suppkey AS instrument, {CODE.replace('instrument', 's_suppkey')} AS stock_code, CAST({LIMIT.replace('instrument', 's_suppkey')} AS DOUBLE) AS threshold FROM supplier")
def p12(spark, folder):
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("instrument"), mk.listed_code("s_suppkey").alias("stock_code"))
    return s.withColumn("threshold", R.limit_threshold(F.col("stock_code")))


@query("p13_limit_flags", f"{B} SELECT instrument, session_date, coalesce({CHG} >= {LIMIT}, false) AS is_limit_up, coalesce({CHG} <= -({LIMIT}), false) AS is_limit_down FROM v")
def p13(spark, folder):
    b = mk.bars_by_instrument(spark, folder).withColumns({"_c": (F.col("close") / DAILY.lag("close") - 1) * 100, "_k": mk.listed_code()})
    return b.select(*KEYS, R.is_limit_up(F.col("_c"), F.col("_k")).alias("is_limit_up"), R.is_limit_down(F.col("_c"), F.col("_k")).alias("is_limit_down"))


@query("p14_range_mask", f"""{B}, s AS (SELECT *, coalesce(close > ({roll('avg', 'close', 20)}), false) AS x FROM v)
SELECT instrument, session_date, CASE WHEN session_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' THEN CAST(x AS INT) ELSE 0 END AS signal FROM s""")
def p14(spark, folder):
    """Windows see the full history; only then is the signal limited to the range."""
    b = mk.bars_by_instrument(spark, folder).withColumn("_x", F.coalesce(F.col("close") > DAILY.mean("close", 20), F.lit(False)).cast("int"))
    inside = F.col("session_date").between(F.lit("1997-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
    return b.select(*KEYS, F.when(inside, F.col("_x")).otherwise(0).alias("signal"))


@query("p15_warmup_mask", f"{B} SELECT instrument, session_date, CASE WHEN rn > 30 THEN CAST(close > open AS INT) ELSE 0 END AS signal FROM v")
def p15(spark, folder):
    return mk.bars_daily(spark, folder).select(
        *KEYS, F.when(DAILY.row() > 30, (F.col("close") > F.col("open")).cast("int")).otherwise(0).alias("signal"))


LABELS = "['万元', '亿元', '元', '股', '手'][CAST(substr(o_orderpriority, 1, 1) AS INT)]"


@query("p16_unit_conversion", f"""WITH u AS (SELECT o_orderkey, o_totalprice AS v, {LABELS} AS unit FROM orders)
SELECT o_orderkey, unit, CASE WHEN unit IN ('股', '手') THEN NULL ELSE round(v * CASE unit WHEN '万元' THEN 1e4 WHEN '亿元' THEN 1e8 ELSE 1 END / 1e4, 4) END AS in_wan,
 unit IN ('股', '手') AS mismatch FROM u""")
def p16(spark, folder):
    label = F.element_at(F.array(*[F.lit(x) for x in ("万元", "亿元", "元", "股", "手")]), F.substring("o_orderpriority", 1, 1).cast("int"))
    o = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"), label.alias("unit"))
    out = units.convert(F.col("v"), F.col("unit"), F.lit("万元"))
    return o.select("o_orderkey", "unit", F.round(out, 4).alias("in_wan"), out.isNull().alias("mismatch"))


@query("p17_inferred_scale", """WITH p AS (SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN o_totalprice WHEN o_custkey % 3 = 1 THEN o_totalprice / 10000 ELSE o_totalprice / (1 + o_orderkey % 2) END AS raw,
  round(o_totalprice / 10000, 2) AS shown FROM orders),
t AS (SELECT o_custkey, count(*) FILTER (WHERE raw <> 0 AND shown <> 0) AS pairs, bool_and(abs(raw * 1 - shown * 10000) <= 0.005 * 10000 + 1e-9) AS s1,
  bool_and(abs(raw * 10000 - shown * 10000) <= 0.005 * 10000 + 1e-9) AS s2, bool_and(abs(raw * 1e8 - shown * 10000) <= 0.005 * 10000 + 1e-9) AS s3 FROM p GROUP BY 1)
SELECT o_custkey, pairs, CASE WHEN pairs >= 2 AND CAST(s1 AS INT) + CAST(s2 AS INT) + CAST(s3 AS INT) = 1 THEN CASE WHEN s1 THEN 1.0 WHEN s2 THEN 1e4 ELSE 1e8 END END AS scale FROM t""")
def p17(spark, folder):
    k = F.col("o_custkey") % 3
    price = F.col("o_totalprice")
    p = table(spark, folder, "orders").select(
        "o_custkey", F.when(k == 0, price).when(k == 1, price / 10000).otherwise(price / (1 + F.col("o_orderkey") % 2)).alias("raw"),
        F.round(price / 10000, 2).alias("shown"))
    return units.infer_scale(p, ["o_custkey"], "raw", "shown", 2, F.lit(1e4))


def factors(spark, folder):
    a = mk.corporate_actions(spark, folder)
    return a.withColumn("factor", 1 - F.col("gross_cash") / 10).filter(F.col("factor") < 1)


@query("p18_front_adjusted", f"""WITH {BARS}, {ACT}, f AS (SELECT instrument, ex_date, ln(1 - gross_cash / 10) AS l FROM act
  WHERE gross_cash > 0 AND ex_date <= DATE '1998-01-01' AND known_date <= DATE '1998-01-01'),
s AS (SELECT b.instrument, b.session_date, coalesce(sum(f.l), 0) AS l FROM bars b LEFT JOIN f ON f.instrument = b.instrument AND f.ex_date > b.session_date GROUP BY 1, 2)
SELECT instrument, session_date, round(exp(l), 6) AS factor, round(close * exp(l), 3) AS close FROM bars JOIN s USING (instrument, session_date)""")
def p18(spark, folder):
    out = adjust.front_adjusted(mk.bars_daily(spark, folder), factors(spark, folder), decision_day())
    return out.select(*KEYS, F.round("factor", 6).alias("factor"), F.round("close", 3).alias("close"))


@query("p19_tick_price", f"{B} SELECT instrument, session_date, round(floor(round(close * 0.937 / 0.01, 6)) * 0.01, 2) AS buy_price, round(ceil(round(close * 0.937 / 0.01, 6)) * 0.01, 2) AS sell_price FROM v")
def p19(spark, folder):
    p = F.col("close") * 0.937
    return mk.bars_daily(spark, folder).select(
        *KEYS, F.round(R.tick_price(p, "buy"), 2).alias("buy_price"), F.round(R.tick_price(p, "sell"), 2).alias("sell_price"))


SHIFT = 8036  # moves the stored dates into the years in which the exchange rules changed
BOARD = f"CASE WHEN substr({CODE}, 1, 3) = '300' THEN 'chinext' WHEN substr({CODE}, 1, 3) = '688' THEN 'star' WHEN substr({CODE}, 1, 2) = '83' THEN 'bse' ELSE 'main' END"
BAND = f"""sn AS (SELECT *, {BOARD} AS board, coalesce({lag('close')}, open) AS pc, CAST(session_date + {SHIFT} AS DATE) AS d, instrument % 10 = 0 AS st,
  CASE WHEN instrument % 3 = 0 THEN DATE '2016-01-01' ELSE CAST(min(session_date) OVER (PARTITION BY instrument) + {SHIFT} + 2200 AS DATE) END AS ld FROM v),
bd AS (SELECT *, CASE board WHEN 'star' THEN CASE WHEN rn > 5 THEN 0.2 END
  WHEN 'chinext' THEN CASE WHEN ld >= DATE '2020-08-24' AND rn <= 5 THEN NULL WHEN d >= DATE '2020-08-24' THEN 0.2 WHEN st THEN 0.05 ELSE 0.1 END
  WHEN 'bse' THEN CASE WHEN rn > 1 THEN 0.3 END
  ELSE CASE WHEN ld >= DATE '2023-04-10' AND rn <= 5 THEN NULL WHEN ld < DATE '2023-04-10' AND rn = 1 THEN 0.44 WHEN st THEN 0.05 ELSE 0.1 END END AS ur,
  CASE WHEN board = 'main' AND ld < DATE '2023-04-10' AND rn = 1 THEN 0.36 END AS lr0 FROM sn)"""
BAND_COLS = """round(CAST(pc AS DECIMAL(18,2)) * (1 + CAST(ur AS DECIMAL(4,2))), 2) AS upper_limit,
  round(CAST(pc AS DECIMAL(18,2)) * (1 - CAST(coalesce(lr0, ur) AS DECIMAL(4,2))), 2) AS lower_limit"""


def session_rows(spark, folder):
    b = mk.bars_suspended(spark, folder).withColumns({"stock_code": mk.listed_code(), "rule_date": F.date_add("session_date", SHIFT)})
    b = b.withColumn("listed", F.when(F.col("instrument") % 3 == 0, F.lit("2016-01-01").cast("date")).otherwise(
        F.date_add(F.min("session_date").over(DAILY.whole), SHIFT + 2200)))
    return adjust.sessions_from_bars(b, F.col("listed"), F.col("instrument") % 10 == 0)


@query("p20_price_band", f"{B}, {BAND} SELECT instrument, session_date, board, {BAND_COLS} FROM bd", doubles=('upper_limit', 'lower_limit'))
def p20(spark, folder):
    return session_rows(spark, folder).select(*KEYS, "board", "upper_limit", "lower_limit")


@query("p21_buy_quantity", f"""{B} SELECT instrument, session_date, CAST(CASE WHEN {BOARD} = 'star' THEN CASE WHEN volume * 17 < 200 THEN 0 ELSE floor(volume * 17) END
  WHEN {BOARD} = 'bse' THEN CASE WHEN volume * 17 < 100 THEN 0 ELSE floor(volume * 17) END
  ELSE CASE WHEN volume * 17 < 100 THEN 0 ELSE 100 + floor((volume * 17 - 100) / 100) * 100 END END AS BIGINT) AS quantity FROM v""")
def p21(spark, folder):
    b = mk.bars_daily(spark, folder)
    return b.select(*KEYS, R.floor_buy_quantity(R.board(mk.listed_code()), F.col("volume") * 17).cast("long").alias("quantity"))


@query("p22_fees", f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS g, CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS side,
  ['SH', 'SZ', 'SH', 'BJ'][l_suppkey % 4 + 1] AS ex, CAST(l_shipdate AS DATE) + {SHIFT} AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(greatest(g * CAST(0.0003 AS DECIMAL(10,6)), CAST(5 AS DECIMAL(18,2))), 2) AS commission,
 round(g * CAST(CASE WHEN side = 'buy' THEN 0 WHEN d >= DATE '2023-08-28' THEN 0.0005 ELSE 0.001 END AS DECIMAL(10,6)), 2) AS stamp_tax,
 round(g * CAST(CASE WHEN d >= DATE '2022-04-29' THEN 0.00001 WHEN ex = 'BJ' THEN NULL ELSE 0.00002 END AS DECIMAL(10,6)), 2) AS transfer_fee FROM t""", doubles=('commission', 'stamp_tax', 'transfer_fee'))
def p22(spark, folder):
    li = table(spark, folder, "lineitem")
    exchange = F.element_at(F.array(*[F.lit(x) for x in ("SH", "SZ", "SH", "BJ")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    side = F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy")
    fees = R.fee_components(side, exchange, F.date_add(F.to_date("l_shipdate"), SHIFT), F.col("l_extendedprice").cast("decimal(18,2)"))
    return li.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", *[c.alias(n) for n, c in fees.items()])


@query("p23_cost_price", f"{B} SELECT instrument, session_date, round(close * (1 + 0.001) * (1 + 0.0003), 6) AS buy_cost, round(close * (1 - 0.001) * (1 - 0.0003 - 0.001), 6) AS sell_net FROM v")
def p23(spark, folder):
    c = F.col("close")
    return mk.bars_daily(spark, folder).select(
        *KEYS, F.round(c * (1 + 0.001) * (1 + 0.0003), 6).alias("buy_cost"), F.round(c * (1 - 0.001) * (1 - 0.0003 - 0.001), 6).alias("sell_net"))


@query("p24_friction_price", f"""{B}, {BAND}, x AS (SELECT *, CAST({BAND_COLS.split(' AS upper_limit')[0]} AS DOUBLE) AS hi,
 CAST({BAND_COLS.split('upper_limit,')[1].split(' AS lower_limit')[0]} AS DOUBLE) AS lo FROM bd)
SELECT instrument, session_date, round(open * 1.5 * greatest(least(open * (1 + CAST(15 AS DOUBLE) / 10000) + 0.02, hi), lo) / open, 7) AS buy_price,
 round(open * 1.5 * greatest(least(open * (1 - CAST(15 AS DOUBLE) / 10000) - 0.02, hi), lo) / open, 7) AS sell_price FROM x""")
def p24(spark, folder):
    """Friction applied in the raw price domain, then carried over by the bar's adjustment ratio."""
    s = session_rows(spark, folder)
    hi, lo = F.col("upper_limit").cast("double"), F.col("lower_limit").cast("double")
    adjusted = F.col("open") * 1.5
    return s.select(*KEYS, *[
        F.round(adjusted * R.friction_price(F.col("open"), side, 15.0, 0.02, hi, lo) / F.col("open"), 7).alias(f"{side}_price")
        for side in ("buy", "sell")])


# ---- adjustment and reference data ---------------------------------------------------

TERMS = """tm AS (SELECT instrument, ex_date AS session_date, coalesce(sum(gross_cash) FILTER (WHERE kind = 'cash'), 0) AS cash,
  coalesce(product(multiplier) FILTER (WHERE kind IN ('bonus', 'split', 'transfer')), 1) AS shares, coalesce(sum(multiplier - 1) FILTER (WHERE kind = 'rights'), 0) AS rights,
  coalesce(sum((multiplier - 1) * gross_cash) FILTER (WHERE kind = 'rights'), 0) AS rv, bool_and(known_date <= ex_date) AS known FROM act GROUP BY 1, 2)"""


@query("n01_ex_date_reference", f"""WITH {BARS}, {ACT}, {TERMS}, b AS (SELECT *, {lag('close')} AS pc FROM bars),
j AS (SELECT instrument, session_date, pc, (pc - cash + rv) / (shares + rights) AS ref, (pc + rv) / (shares + rights) AS cl, known, open AS published FROM tm JOIN b USING (instrument, session_date))
SELECT instrument, session_date, round(ref, 4) AS reference, round(cl, 4) AS cashless, round(published / pc, 6) AS factor,
 CASE WHEN pc IS NULL THEN 'prior_close_missing' WHEN NOT known THEN 'not_known_before_ex_date' WHEN ref <= 0 THEN 'invalid'
 WHEN published < least(ref, cl) - 0.01 OR published > greatest(ref, cl) + 0.01 THEN 'reference_mismatch' ELSE 'ok' END AS status FROM j""")
def n01(spark, folder):
    j = adjust.ex_date_reference(mk.bars_daily(spark, folder), mk.corporate_actions(spark, folder))
    ref, cl, pub = F.col("reference"), F.col("cashless"), F.col("open")
    status = (F.when(F.col("prior_close").isNull(), "prior_close_missing").when(~F.col("known_in_time"), "not_known_before_ex_date")
              .when(ref <= 0, "invalid").when((pub < F.least(ref, cl) - 0.01) | (pub > F.greatest(ref, cl) + 0.01), "reference_mismatch").otherwise("ok"))
    return j.select(*KEYS, F.round(ref, 4).alias("reference"), F.round(cl, 4).alias("cashless"),
                    F.round(pub / F.col("prior_close"), 6).alias("factor"), status.alias("status"))


@query("n02_additive_adjustment", f"""WITH {BARS}, {ACT}, c AS (SELECT instrument, ex_date, sum(gross_cash) AS cash FROM act WHERE kind = 'cash' GROUP BY 1, 2),
o AS (SELECT b.instrument, b.session_date, coalesce(sum(c.cash), 0) AS off FROM bars b LEFT JOIN c ON c.instrument = b.instrument AND c.ex_date > b.session_date GROUP BY 1, 2),
a AS (SELECT bars.*, off, open - off - CASE WHEN instrument % 7 = 0 THEN 0.5 ELSE 0 END AS adj_open, close - off AS adj_close FROM bars JOIN o USING (instrument, session_date))
SELECT instrument, session_date, round(off, 4) AS expected_offset, abs(open - adj_open - off) > 0.005 OR abs(close - adj_close - off) > 0.005 AS violated FROM a""")
def n02(spark, folder):
    """Unadjusted minus adjusted price must equal the cash of later ex-dates, field by field."""
    bars = mk.bars_daily(spark, folder)
    cash = mk.corporate_actions(spark, folder).filter(F.col("kind") == "cash").select(
        "instrument", F.col("ex_date").alias("day"), "gross_cash")
    b = adjust.later_total(bars, cash, "gross_cash", "off")
    flaw = F.when(F.col("instrument") % 7 == 0, 0.5).otherwise(0.0)
    b = b.withColumns({"adj_open": F.col("open") - F.col("off") - flaw, "adj_close": F.col("close") - F.col("off")})
    bad = (F.abs(F.col("open") - F.col("adj_open") - F.col("off")) > 0.005) | (F.abs(F.col("close") - F.col("adj_close") - F.col("off")) > 0.005)
    return b.select(*KEYS, F.round("off", 4).alias("expected_offset"), bad.alias("violated"))


@query("n03_sessions", f"""{B}, {BAND} SELECT bd.instrument, bd.session_date, pc AS previous_close, CASE WHEN (bd.instrument + datediff('day', DATE '1970-01-01', bd.session_date)) % 17 = 0 THEN 'suspended' ELSE 'trading' END AS trading_status,
 CAST(rn AS BIGINT) AS listing_no, {BAND_COLS} FROM bd""", doubles=('upper_limit', 'lower_limit'))
def n03(spark, folder):
    return session_rows(spark, folder).select(*KEYS, "previous_close", "trading_status", F.col("listing_no").cast("long").alias("listing_no"), "upper_limit", "lower_limit")


DIV = """dv AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 50 / 100.0 END AS cash, CASE WHEN o_orderkey % 4 = 0 THEN 0.3 ELSE 0 END AS bonus,
 CASE WHEN o_orderkey % 8 = 0 THEN 0.2 ELSE 0 END AS reserve, CAST(o_orderdate AS DATE) AS record_date, CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE 1 END AS ex_date FROM orders)"""


@query("n04_dividend_actions", f"""WITH {DIV} SELECT id, 'cash' AS kind, cash AS gross_cash, CAST(NULL AS DOUBLE) AS share_multiplier, record_date >= ex_date AS rejected FROM dv WHERE cash > 0
UNION ALL SELECT id, 'shares', NULL, 1.0 + bonus + reserve, record_date >= ex_date FROM dv WHERE bonus + reserve > 0""")
def n04(spark, folder):
    """A dividend row becomes a cash action, a share action, both or none."""
    k = F.col("o_orderkey")
    d = table(spark, folder, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, 0.0).otherwise(k % 50 / 100).alias("cash"), F.when(k % 4 == 0, 0.3).otherwise(0.0).alias("bonus"),
        F.when(k % 8 == 0, 0.2).otherwise(0.0).alias("reserve"), F.to_date("o_orderdate").alias("record_date"),
        F.date_add(F.to_date("o_orderdate"), F.when(k % 11 == 0, 0).otherwise(1)).alias("ex_date"))
    more = F.col("bonus") + F.col("reserve")
    both = F.array(
        F.when(F.col("cash") > 0, F.struct(F.lit("cash").alias("kind"), F.col("cash").alias("gross_cash"), F.lit(None).cast("double").alias("share_multiplier"))),
        F.when(more > 0, F.struct(F.lit("shares").alias("kind"), F.lit(None).cast("double").alias("gross_cash"), (1 + more).alias("share_multiplier"))))
    return d.select("id", F.explode(F.array_compact(both)).alias("a"), (F.col("record_date") >= F.col("ex_date")).alias("rejected")).select("id", "a.*", "rejected")


DIRECTORY = f"""dr AS (SELECT s_suppkey AS instrument, {CODE.replace('instrument', 's_suppkey')} AS code, 'Name' || s_nationkey AS name, s_suppkey % 10 = 9 AS is_index,
 DATE '1995-01-01' + CAST(s_suppkey AS INT) AS listed, CASE WHEN s_suppkey % 6 = 0 THEN DATE '1999-01-01' END AS delisted FROM supplier),
ky AS (SELECT code || CASE WHEN substr(code, 1, 1) = '6' THEN '.SH' WHEN substr(code, 1, 1) = '3' THEN '.SZ' ELSE '.BJ' END AS k, * FROM dr UNION ALL SELECT code, * FROM dr UNION ALL SELECT name, * FROM dr)"""
RQ = """rq AS (SELECT c_custkey, ['600', '300', '688', '830'][c_custkey % 4 + 1] || lpad(CAST(c_custkey AS VARCHAR), greatest(3, length(CAST(c_custkey AS VARCHAR)))::INTEGER, '0') AS code, c_nationkey FROM customer),
rk AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN code || CASE WHEN substr(code, 1, 1) = '6' THEN '.SH' WHEN substr(code, 1, 1) = '3' THEN '.SZ' ELSE '.BJ' END WHEN 1 THEN code ELSE 'Name' || c_nationkey END AS k FROM rq)"""


def symbol_of(code):
    first = F.substring(code, 1, 1)
    return F.concat(code, F.when(first == "6", ".SH").when(first == "3", ".SZ").otherwise(".BJ"))


def directory(spark, folder):
    s = table(spark, folder, "supplier")
    return s.select(
        F.col("s_suppkey").alias("instrument"), mk.listed_code("s_suppkey").alias("code"), F.concat(F.lit("Name"), F.col("s_nationkey").cast("string")).alias("name"),
        (F.col("s_suppkey") % 10 == 9).alias("is_index"), F.date_add(F.lit("1995-01-01").cast("date"), F.col("s_suppkey").cast("int")).alias("listed"),
        F.when(F.col("s_suppkey") % 6 == 0, F.lit("1999-01-01").cast("date")).alias("delisted"))


@query("n05_security_resolution", f"""WITH {DIRECTORY}, {RQ},
g AS (SELECT k, count(*) AS n, min(instrument) AS instrument, bool_or(is_index) AS is_index, min(listed) AS listed, min(delisted) AS delisted FROM ky GROUP BY 1)
SELECT c_custkey, rk.k AS identifier, CASE WHEN n = 1 THEN instrument END AS instrument, CASE WHEN n IS NULL THEN 'unconfirmed' WHEN n > 1 THEN 'ambiguous' WHEN is_index THEN 'index'
 WHEN listed > DATE '1995-03-01' OR delisted <= DATE '1995-03-01' THEN 'not_tradable' ELSE 'ok' END AS status FROM rk LEFT JOIN g ON g.k = rk.k""")
def n05(spark, folder):
    """Identifier to security by symbol, local code or name; ambiguous and index hits are refused."""
    d = directory(spark, folder)
    keys = d.withColumn("k", F.explode(F.array(symbol_of(F.col("code")), F.col("code"), F.col("name"))))
    g = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("instrument").alias("i"), F.bool_or("is_index").alias("x"),
                              F.min("listed").alias("l"), F.min("delisted").alias("e"))
    c = table(spark, folder, "customer").withColumn("code", mk.listed_code("c_custkey"))
    pick = F.col("c_custkey") % 3
    c = c.select("c_custkey", F.when(pick == 0, symbol_of(F.col("code"))).when(pick == 1, F.col("code")).otherwise(
        F.concat(F.lit("Name"), F.col("c_nationkey").cast("string"))).alias("k"))
    on = F.lit("1995-03-01").cast("date")
    status = (F.when(F.col("n").isNull(), "unconfirmed").when(F.col("n") > 1, "ambiguous").when(F.col("x"), "index")
              .when((F.col("l") > on) | F.coalesce(F.col("e") <= on, F.lit(False)), "not_tradable").otherwise("ok"))
    return c.join(g, "k", "left").select("c_custkey", F.col("k").alias("identifier"), F.when(F.col("n") == 1, F.col("i")).alias("instrument"), status.alias("status"))


@query("n06_daily_assembly", f"""{B}, {BAND}, r AS (SELECT instrument, session_date, board, {BAND_COLS}, (instrument + datediff('day', DATE '1970-01-01', session_date)) % 17 = 0 AS halted FROM bd)
SELECT r.instrument, r.session_date, v.close AS raw_close, round(v.close * 1.5, 4) AS adjusted_close, CASE WHEN halted THEN NULL ELSE upper_limit END AS upper_limit,
 CASE WHEN NOT halted AND upper_limit IS NULL AND board NOT IN ('star', 'chinext', 'bse') THEN 'limit_missing' WHEN halted THEN 'suspended' ELSE 'ok' END AS status
FROM r JOIN v USING (instrument, session_date)""", doubles=('upper_limit',))
def n06(spark, folder):
    """One daily row from the session, raw and adjusted tables; a missing limit is judged by status."""
    s = session_rows(spark, folder).select(*KEYS, "board", "trading_status", "upper_limit")
    raw = mk.bars_daily(spark, folder).select(*KEYS, F.col("close").alias("raw_close"))
    adj = mk.bars_daily(spark, folder).select(*KEYS, (F.col("close") * 1.5).alias("adjusted_close"))
    halted = F.col("trading_status") == "suspended"
    lost = ~halted & F.col("upper_limit").isNull() & ~F.col("board").isin("star", "chinext", "bse")
    return s.join(raw, KEYS).join(adj, KEYS).select(
        *KEYS, "raw_close", F.round("adjusted_close", 4).alias("adjusted_close"), F.when(~halted, F.col("upper_limit")).alias("upper_limit"),
        F.when(lost, "limit_missing").when(halted, "suspended").otherwise("ok").alias("status"))


@query("n07_acquisition_coverage", """WITH u AS (SELECT DISTINCT user_id FROM events), t AS (SELECT * FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('refund')) t(event_type)),
c AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE value > 300) AS failed FROM events GROUP BY 1, 2)
SELECT u.user_id, t.event_type, coalesce(n, 0) AS n, CASE WHEN t.event_type = 'refund' THEN 'not_requested' WHEN coalesce(failed, 0) > 0 THEN 'failed' WHEN n IS NULL THEN 'empty' ELSE 'ok' END AS status
FROM u CROSS JOIN t LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = t.event_type""")
def n07(spark, folder):
    """Provider x code coverage over the fixed code list; empty is a success, not a failure."""
    e = table(spark, folder, "events")
    codes = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view", "refund")])
    grid = e.select("user_id").distinct().withColumn("event_type", F.explode(codes))
    c = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("value") > 300).alias("bad"))
    status = (F.when(F.col("event_type") == "refund", "not_requested").when(F.coalesce("bad", F.lit(0)) > 0, "failed")
              .when(F.col("c").isNull(), "empty").otherwise("ok"))
    return grid.join(c, ["user_id", "event_type"], "left").select("user_id", "event_type", F.coalesce("c", F.lit(0)).alias("n"), status.alias("status"))


@query("n08_label_convention", """WITH h AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day, hour(ts) AS hr, hour(ts) + CAST(event_type IN ('click', 'view') AS INT) AS label FROM events ),
g AS (SELECT event_type, day, coalesce(list_sort(list(label) FILTER (WHERE hr BETWEEN 9 AND 11)), []) AS l FROM h GROUP BY 1, 2)
SELECT event_type, day, CASE WHEN l = [9, 10, 11] THEN 'bar_start' WHEN l = [10, 11, 12] THEN 'bar_end' ELSE 'unverified' END AS semantics, len(l) AS labels FROM g""")
def n08(spark, folder):
    """Does a session carry bar-start or bar-end labels? Only a complete grid proves either."""
    label = F.hour("ts") + F.col("event_type").isin("click", "view").cast("int")
    h = table(spark, folder, "events").select("event_type", F.to_date("ts").alias("day"), F.when(F.hour("ts").between(9, 11), label).alias("label"))
    g = h.groupBy("event_type", "day").agg(F.sort_array(F.collect_set("label")).alias("l"))  # at most one label per hour

    def grid(first: int):
        return F.array(*[F.lit(first + i) for i in range(3)])

    kind = F.when(F.col("l") == grid(9), "bar_start").when(F.col("l") == grid(10), "bar_end").otherwise("unverified")
    return g.select("event_type", "day", kind.alias("semantics"), F.size("l").cast("long").alias("labels"))


# ---- quality -------------------------------------------------------------------------


def violation(df, rule: str, when, *keys: str):
    return df.filter(when).select(F.lit(rule).alias("rule"), *keys)


@query("q01_ohlc", f"""{B}, x AS (SELECT * REPLACE (CASE WHEN instrument % 13 = 0 AND rn % 5 = 0 THEN low - 1 ELSE high END AS high) FROM v)
SELECT 'ohlc' AS rule, instrument, session_date FROM x WHERE NOT (least(open, high, low, close) > 0 AND low <= least(open, close) AND high >= greatest(open, close))""")
def q01(spark, folder):
    b = mk.bars_by_instrument(spark, folder).withColumn("rn", DAILY.row())
    b = b.withColumn("high", F.when((F.col("instrument") % 13 == 0) & (F.col("rn") % 5 == 0), F.col("low") - 1).otherwise(F.col("high")))
    good = (F.least("open", "high", "low", "close") > 0) & (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
    return violation(b, "ohlc", ~good, *KEYS)


@query("q02_duplicate_keys", "SELECT 'duplicate_key' AS rule, l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q02(spark, folder):
    g = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("copies"))
    return violation(g, "duplicate_key", F.col("copies") > 1, "l_orderkey", "l_linenumber", "copies")


@query("q03_off_grid", """SELECT 'off_grid' AS rule, event_id, ts FROM events WHERE date_trunc('minute', ts) <> ts OR NOT (CAST(ts AS TIME) >= TIME '09:30' AND CAST(ts AS TIME) < TIME '11:30' OR CAST(ts AS TIME) >= TIME '13:00' AND CAST(ts AS TIME) < TIME '15:00')""")
def q03(spark, folder):
    e = table(spark, folder, "events")
    minute = F.hour("ts") * 60 + F.minute("ts")
    grid = minute.between(570, 689) | minute.between(780, 899)
    whole = (F.date_format("ts", "ss") == "00") & (F.date_format("ts", "SSSSSS") == "000000")
    return violation(e, "off_grid", ~(grid & whole), "event_id", "ts")


@query("q04_incomplete_sessions", """WITH h AS (SELECT event_type, CAST(ts AS DATE) AS day, count(DISTINCT hour(ts)) AS n FROM events GROUP BY 1, 2)
SELECT 'incomplete' AS rule, event_type, day, 24 - n AS missing FROM h WHERE n < 24""")
def q04(spark, folder):
    h = table(spark, folder, "events").groupBy("event_type", F.to_date("ts").alias("day"), F.hour("ts").alias("h")).agg(F.lit(1).alias("_"))
    g = h.groupBy("event_type", "day").agg((24 - F.count(F.lit(1))).alias("missing"))
    return violation(g, "incomplete", F.col("missing") > 0, "event_type", "day", "missing")


@query("q08_limits", f"""{B}, {BAND}, x AS (SELECT instrument, session_date, rn, {BAND_COLS} FROM bd),
y AS (SELECT instrument, session_date, upper_limit AS u, CASE WHEN instrument % 11 = 0 AND rn % 9 = 0 THEN NULL WHEN instrument % 11 = 1 AND rn % 9 = 0 THEN upper_limit ELSE lower_limit END AS l FROM x)
SELECT 'limits' AS rule, instrument, session_date FROM y WHERE (u IS NULL) <> (l IS NULL) OR l >= u""")
def q08(spark, folder):
    s = session_rows(spark, folder)
    nth = F.col("listing_no") % 9 == 0
    s = s.withColumn("lower_limit", F.when((F.col("instrument") % 11 == 0) & nth, None).when((F.col("instrument") % 11 == 1) & nth, F.col("upper_limit")).otherwise(F.col("lower_limit")))
    bad = (F.col("upper_limit").isNull() != F.col("lower_limit").isNull()) | F.coalesce(F.col("lower_limit") >= F.col("upper_limit"), F.lit(False))
    return violation(s, "limits", bad, *KEYS)


@query("q09_provenance", f"""{B}, x AS (SELECT instrument, session_date, CASE WHEN rn % 3 > 0 THEN volume END AS rate, CASE WHEN rn % 3 > 0 AND instrument % 5 > 0 THEN 'desk' END AS provider, CASE WHEN rn % 3 > 0 THEN 'm' END AS method FROM v)
SELECT 'partial_provenance' AS rule, instrument, session_date FROM x WHERE CAST(rate IS NULL AS INT) + CAST(provider IS NULL AS INT) + CAST(method IS NULL AS INT) IN (1, 2)""")
def q09(spark, folder):
    b = mk.bars_by_instrument(spark, folder).withColumn("rn", DAILY.row())
    some = F.col("rn") % 3 > 0
    parts = [F.when(some, F.col("volume")), F.when(some & (F.col("instrument") % 5 > 0), "desk"), F.when(some, "m")]
    missing = sum((p.isNull().cast("int") for p in parts), F.lit(0))
    return violation(b, "partial_provenance", missing.isin(1, 2), *KEYS)


@query("q10_suspended_volume", f"""WITH {BARS} SELECT 'suspended_volume' AS rule, instrument, session_date, volume FROM bars
WHERE (instrument + datediff('day', DATE '1970-01-01', session_date)) % 17 = 0 AND volume > 0""")
def q10(spark, folder):
    s = session_rows(spark, folder).filter(F.col("trading_status") == "suspended").select(*KEYS)
    return violation(mk.bars_daily(spark, folder).join(s, KEYS), "suspended_volume", F.col("volume") > 0, *KEYS, "volume")


@query("q11_record_before_ex", f"WITH {DIV} SELECT 'record_before_ex' AS rule, id FROM dv WHERE NOT record_date < ex_date")
def q11(spark, folder):
    return violation(n04(spark, folder).filter("rejected").select("id").unionByName(
        table(spark, folder, "orders").filter((F.col("o_orderkey") % 11 == 0)).select(F.col("o_orderkey").alias("id"))).distinct(),
        "record_before_ex", F.lit(True), "id")
