"""Published text, vocabulary, scan and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import broker as BK
from tidemark.functions import text as TX
from tidemark.functions.kleene import compare
from tidemark.functions.title_rules import COLUMN_CODES, ISSUER_TITLES, NEGATED, REVISED
from tidemark.operators.titles import classified
from tidemark.plans.joins import ACT, FACTS, KEYS
from tidemark.plans.atoms import VALUATION
from tidemark.plans.ledger import HOURS
from tidemark.plans.registry import query
from tidemark.plans.rules import B, BAND, BAND_COLS, session_rows
from tidemark.plans.sql import BARS
from tidemark.session import scratch_path
from tidemark.sources import market as mk
from tidemark.sources import store as ST
from tidemark.sources.tables import table


def docs(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "text")


FOLD = "replace(lower(nfc_normalize(text)), 'ß', 'ss')"


@query("x01_title_key", f"SELECT doc_id, sha256(regexp_replace({FOLD}, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS key_sha FROM documents")
def x01(spark, folder):
    return docs(spark, folder).select("doc_id", F.sha2(TX.title_key(F.col("text")), 256).alias("key_sha"))


@query("x02_squeeze", "SELECT doc_id, sha256(regexp_replace(nfc_normalize(text), '\\s+', '', 'g')) AS squeezed_sha FROM documents")
def x02(spark, folder):
    return docs(spark, folder).select("doc_id", F.sha2(TX.squeezed(F.col("text")), 256).alias("squeezed_sha"))


TERMS = ("the", "en", "la")
TOK = "regexp_split_to_array({f}, '[^A-Za-z0-9_]+')".format(f=FOLD)


@query("x03_term_counts", f"SELECT doc_id, {', '.join(f'CAST((length({FOLD}) - length(replace({FOLD}, {t!r}, {chr(39)*2}))) / {len(t)} AS BIGINT) AS {t}_literal, CAST(len(list_filter({TOK}, lambda x: x = {t!r})) AS BIGINT) AS {t}_token' for t in TERMS)} FROM documents")
def x03(spark, folder):
    d = docs(spark, folder).select("doc_id", TX.nfkc_fold(F.col("text")).alias("t"))
    out = []
    for t in TERMS:
        out += [TX.literal_count(F.col("t"), t).alias(f"{t}_literal"), TX.ascii_token_count(F.col("t"), t).alias(f"{t}_token")]
    return d.select("doc_id", *out)


@query("x04_count_comparators", f"WITH c AS (SELECT doc_id, len(list_filter({TOK}, lambda x: x = 'the')) AS n FROM documents) SELECT doc_id, n > 2 AS gt, n >= 2 AS gte, n = 2 AS eq, n <= 2 AS lte, n < 2 AS lt FROM c")
def x04(spark, folder):
    n = TX.ascii_token_count(F.col("t"), "the")
    d = docs(spark, folder).select("doc_id", TX.nfkc_fold(F.col("text")).alias("t")).withColumn("n", n)
    return d.select("doc_id", *[compare(op, F.col("n"), F.lit(2)).alias(op) for op in ("gt", "gte", "eq", "lte", "lt")])


@query("x05_document_artifacts", """WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS pages FROM documents)
SELECT doc_id, len(pages) AS pages, CASE WHEN len(pages) = 0 THEN 'page_count' WHEN doc_id % 7 = 0 THEN 'text_hash' WHEN doc_id % 7 = 1 THEN 'page_numbers' WHEN doc_id % 7 = 2 THEN 'page_hash'
 WHEN doc_id % 7 = 3 THEN 'page_characters' WHEN doc_id % 7 = 4 THEN 'rebuild' END AS problem FROM p WHERE len(pages) > 0""")
def x05(spark, folder):
    """Artifacts made from whole documents, five kinds of damage among them, checked by replay."""
    k = F.col("doc_id") % 7
    d = docs(spark, folder).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).filter(F.size("lines") > 0)
    page = F.transform("lines", lambda x, i: F.struct(
        F.when(k == 1, i + 2).otherwise(i + 1).alias("pageNumber"), x.alias("text"),
        F.when(k == 2, F.sha2(F.concat(x, F.lit("!")), 256)).otherwise(F.sha2(x, 256)).alias("textSha256"),
        (F.length(x) + F.when(k == 3, 1).otherwise(0)).alias("characterCount"), F.length(F.regexp_replace(x, r"(?U)\s", "")).alias("nonWhitespaceCharacterCount")))
    full = F.array_join("lines", TX.PAGE_BREAK)
    d = d.select("doc_id", F.size("lines").alias("n"), F.when(k == 4, F.concat(full, F.lit("x"))).otherwise(full).alias("body"), F.to_json(page).alias("pages_json"), k.alias("k"))
    d = d.withColumn("sha", F.when(F.col("k") == 0, F.sha2(F.concat("body", F.lit("?")), 256)).otherwise(F.sha2("body", 256)))
    return d.select("doc_id", F.col("n").cast("long").alias("pages"), TX.artifact_problem(F.col("body"), F.col("sha"), F.col("pages_json"), F.col("n")).alias("problem"))


# How an order's title is made from a rule's sample: number of the form, text before, text after.
TITLE_FORMS = ((0, "", ""), (1, "甲公司：", ""), (2, "", "的更正公告"), (3, "网传", ""), (4, "关于 ", "　（２０２４年）"), (5, "", "之进展完成公告"),
               (6, "尚未完成", ""), (7, "2024年第一季度报告", ""), (8, "2023年度报告", "摘要"), (9, "回购股份方案修订", ""), (10, "2023年年度报告", ""))
BARE = (7, 10)  # forms without the sample
SAMPLES = [r.sample for r in ISSUER_TITLES]
PROVIDER_CODES = [*COLUMN_CODES, "999"]


def issuer_titles(spark, folder):
    """One announcement for each order: a title and, for some, the provider's codes."""
    k = F.col("o_orderkey")
    n = (F.floor(k / len(SAMPLES)) % len(TITLE_FORMS)).cast("int")
    item = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    sample = F.when(n.isin(*BARE), "").otherwise(item(SAMPLES, k % len(SAMPLES)))
    title = F.concat(item([f[1] for f in TITLE_FORMS], n), sample, item([f[2] for f in TITLE_FORMS], n))
    codes = F.when(k % 5 == 0, F.array(item(PROVIDER_CODES, F.floor(k / 5) % 8), item(PROVIDER_CODES, F.floor(k / 7) % 8)))
    return table(spark, folder, "orders").select("o_orderkey", F.when(k % 97 != 0, title).alias("title"), codes.alias("codes"))


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_rules():
    """Every rule's pattern tried in order, without any index."""
    hit = lambda r: f"regexp_matches(t, '{r.pattern}')" + (f" AND NOT regexp_matches(t, '{r.excluded}')" if r.excluded else "")
    whens = " ".join(f"WHEN {hit(r)} THEN '{r.id}'" for r in ISSUER_TITLES)
    return f"CASE {whens} END"


X06 = f"""WITH o AS (SELECT o_orderkey, CAST(o_orderkey // {len(SAMPLES)} % {len(TITLE_FORMS)} AS INT) AS f FROM orders),
b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE {_sql_list(x[1] for x in TITLE_FORMS)}[f + 1] || CASE WHEN f IN {BARE} THEN '' ELSE {_sql_list(SAMPLES)}[o_orderkey % {len(SAMPLES)} + 1] END
  || {_sql_list(x[2] for x in TITLE_FORMS)}[f + 1] END AS title,
  CASE WHEN o_orderkey % 5 = 0 THEN list_sort([{_sql_list(PROVIDER_CODES)}[o_orderkey // 5 % 8 + 1], {_sql_list(PROVIDER_CODES)}[o_orderkey // 7 % 8 + 1]]) END AS codes FROM o),
n AS (SELECT o_orderkey, title, coalesce(replace(replace(translate(title, '：（）２０４', ':()204'), ' ', ''), '　', ''), '') AS t, list_filter(codes, lambda c: c <> '999')[1] AS named FROM b),
m AS (SELECT *, CASE named {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in COLUMN_CODES.items())} END AS code, regexp_matches(t, '{REVISED}') AS revised, {_sql_rules()} AS rule FROM n),
c AS (SELECT *, CASE WHEN regexp_matches(t, '{NEGATED}') THEN 'unclassified'
  WHEN named IS NOT NULL THEN CASE WHEN revised AND NOT (code LIKE '%repurchase_change' AND regexp_matches(t, '回购股份.*修订|修订.*回购股份') AND NOT regexp_matches(t, '撤回|撤销|取消|更正|补充')) THEN 'unclassified'
    WHEN code LIKE 'event.financial_results.%' AND regexp_matches(t, '摘要|英文版|外文版|更正|修订|取消|撤回|撤销|更新|补充公告|补充说明') THEN 'unclassified'
    WHEN code LIKE '%.annual_report' AND NOT regexp_matches(t, '(^|:)20[0-9]{{2}}年?年度报告$') THEN 'unclassified'
    WHEN code LIKE '%.semiannual_report' AND NOT regexp_matches(t, '(^|:)20[0-9]{{2}}年?(半年度|半年)报告$') THEN 'unclassified'
    WHEN code LIKE '%.quarterly_report' AND NOT regexp_matches(t, '(^|:)20[0-9]{{2}}年?(第?[一1]季度|第?[三3]季度)报告$') THEN 'unclassified' ELSE 'column_code' END
  WHEN revised OR rule IS NULL THEN 'unclassified' ELSE 'title_rule' END AS method FROM m)
SELECT o_orderkey, title, CASE method WHEN 'column_code' THEN code WHEN 'title_rule' THEN map_extract(MAP {{{', '.join(f"'{r.id}': '{r.code}'" for r in ISSUER_TITLES)}}}, rule)[1] ELSE 'event.announcement.unclassified' END AS event_code,
  method, CASE method WHEN 'column_code' THEN 'column:' || named WHEN 'title_rule' THEN rule END AS rule_id FROM c"""


@query("x06_title_classes", X06)
def x06(spark, folder):
    return classified(issuer_titles(spark, folder), "title", "codes").drop("codes")


REPORT_SQL = """ti AS (SELECT o_orderkey AS id, o_custkey AS issuer, CAST(20 || lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') AS VARCHAR) || '年' || ['第一季度报告', '半年度报告', '第三季度报告', '年度报告'][o_orderkey % 4 + 1]
 || CASE WHEN o_orderkey % 9 = 0 THEN '摘要' ELSE '' END || ['', '预增', '首亏', '扭亏为盈', '略减'][CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 5 + 1 ELSE 1 END] AS title, o_orderkey % 4 AS q, o_orderkey % 30 AS yy FROM orders)"""


def report_titles(spark, folder):
    k = F.col("o_orderkey")

    def pick(items, i):
        return F.element_at(F.array(*[F.lit(x) for x in items]), (i + 1).cast("int"))

    title = F.concat(F.lit("20"), F.lpad((k % 30).cast("string"), 2, "0"), F.lit("年"), pick(("第一季度报告", "半年度报告", "第三季度报告", "年度报告"), k % 4),
                     F.when(k % 9 == 0, "摘要").otherwise(""), pick(("", "预增", "首亏", "扭亏为盈", "略减"), F.when(k % 11 == 0, k % 5).otherwise(0)))
    return table(spark, folder, "orders").select(k.alias("id"), F.col("o_custkey").alias("issuer"), title.alias("title"))


@query("x07_report_attributes", f"""WITH {REPORT_SQL} SELECT id, last_day(make_date(CAST(2000 + yy AS INT), CAST([3, 6, 9, 12][q + 1] AS INT), 1)) AS period_end,
 CASE WHEN title LIKE '%扭亏%' THEN 'turn_profitable' WHEN title LIKE '%首亏%' THEN 'first_loss' WHEN title LIKE '%预增%' THEN 'increase' WHEN title LIKE '%略减%' THEN 'decrease' ELSE 'unspecified' END AS direction FROM ti""")
def x07(spark, folder):
    t = F.col("title")
    return report_titles(spark, folder).select("id", TX.report_period(t, t.contains("季度")).alias("period_end"), TX.forecast_direction(t).alias("direction"))


@query("x08_initial_reports", f"""WITH {REPORT_SQL}, k AS (SELECT *, CASE WHEN title LIKE '%摘要%' THEN NULL WHEN regexp_matches(title, '^20\\d\\d年?年度报告$') THEN 'annual' WHEN regexp_matches(title, '^20\\d\\d年?半年度报告$') THEN 'semiannual'
 WHEN regexp_matches(title, '^20\\d\\d年第[一三]季度报告$') THEN 'quarterly' END AS kind FROM ti)
SELECT issuer, kind, yy * 10 + q AS period_no, count(*) AS reports, count(*) > 1 AS ambiguous FROM k WHERE kind IS NOT NULL GROUP BY 1, 2, 3""")
def x08(spark, folder):
    r = report_titles(spark, folder).withColumn("kind", TX.report_kind(F.col("title"))).filter("kind is not null")
    r = r.withColumn("period_no", F.col("id") % 30 * 10 + F.col("id") % 4)
    g = r.groupBy("issuer", "kind", "period_no").agg(F.count(F.lit(1)).alias("reports"))
    return g.withColumn("ambiguous", F.col("reports") > 1)


@query("x09_fiscal_labels", """SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE last_day(make_date(CAST(year(o_orderdate) AS INT), CAST([3, 6, 6, 9, 12][o_orderkey % 6 + 1] AS INT), 1)) END AS period_end FROM orders""")
def x09(spark, folder):
    k = F.col("o_orderkey")
    labels = F.array(*[F.lit(x) for x in ("一季报", "中报", "半年报", "三季报", "年报", "季报")])
    label = F.concat(F.year("o_orderdate").cast("string"), F.element_at(labels, (k % 6 + 1).cast("int")))
    return table(spark, folder, "orders").select("o_orderkey", TX.fiscal_label_end(label).alias("period_end"))


@query("x10_period_shape", f"""WITH {FACTS}, p AS (SELECT revision_id, CASE WHEN revision_id % 5 = 0 THEN report_period - 1 ELSE report_period END AS period FROM fx)
SELECT revision_id, CASE WHEN period <> last_day(period) THEN NULL ELSE ['q1', 'semiannual', 'q3', 'annual'][CAST(month(period) / 3 AS INT)] END AS report_type,
 CASE WHEN period <> last_day(period) THEN NULL WHEN month(period) = 12 THEN 'full_year' ELSE 'ytd_cumulative' END AS basis FROM p""")
def x10(spark, folder):
    f = mk.facts(spark, folder)
    period = F.when(F.col("revision_id") % 5 == 0, F.date_sub("report_period", 1)).otherwise(F.col("report_period"))
    kind, basis = TX.period_shape(period)
    return f.select("revision_id", kind.alias("report_type"), basis.alias("basis"))


RAWCODE = "['600', '300', '000', '830', '200', '60'][l_orderkey % 6 + 1] || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') || ['', '.SH', '.SZ', '.BJ', ''][l_linenumber % 5 + 1]"
RAW_SQL = f"""rw AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, {RAWCODE} AS code, ['沪市', '深A', '港股', NULL, '北交所', 'A股'][l_suppkey % 6 + 1] AS market,
 ['买入', '证券卖出', 'Buy', ' sell ', '银证转入', '银证转出', '红利入账', '利息归本', '融资买入', '送股', '印花税', '转托管'][l_orderkey % 12 + 1] AS business,
 CASE l_linenumber % 3 WHEN 0 THEN strftime(l_shipdate, '%Y%m%d') WHEN 1 THEN strftime(l_shipdate, '%Y/%-m/%-d') || ' 09:31:05' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS occurred,
 l_quantity AS q, l_extendedprice AS amt, l_tax AS tax FROM lineitem)"""


def pick(items, i):
    return F.element_at(F.array(*[F.lit(x) for x in items]), (i + 1).cast("int"))


def raw_rows(spark, folder):
    """Broker-shaped text rows: mixed languages, codes, dates and number formats."""
    k, n, p, s = (F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    code = F.concat(pick(("600", "300", "000", "830", "200", "60"), k % 6), F.lpad((p % 1000).cast("string"), 3, "0"), pick(("", ".SH", ".SZ", ".BJ", ""), n % 5))
    day = F.col("l_shipdate")
    when = F.when(n % 3 == 0, F.date_format(day, "yyyyMMdd")).when(n % 3 == 1, F.concat(F.date_format(day, "yyyy/M/d"), F.lit(" 09:31:05"))).otherwise(F.date_format(day, "yyyy-MM-dd"))
    business = pick(("买入", "证券卖出", "Buy", " sell ", "银证转入", "银证转出", "红利入账", "利息归本", "融资买入", "送股", "印花税", "转托管"), k % 12)
    amount = F.format_number("l_extendedprice", 2)
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", code.alias("证券代码"), pick(("沪市", "深A", "港股", None, "北交所", "A股"), s % 6).alias("市场"),
        business.alias("业务名称"), when.alias("成交时间"), F.when(n == 7, "--").otherwise(F.format_number("l_quantity", 0)).alias("成交数量"),
        F.concat(F.lit("¥"), amount).alias("成交价格"), F.when(n % 4 == 0, F.concat(F.lit("("), amount, F.lit(")"))).otherwise(amount).alias("发生金额"),
        F.format_number(F.col("l_tax") * 100, 2).alias("佣金"), F.when(n % 2 == 0, F.lit("1.50")).alias("印花税"))


ROW = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"]
ROWS = ", ".join(ROW)
NORM = """CASE WHEN length(c) <> 6 THEN NULL WHEN substr(c, 1, 3) = '600' AND sfx IN ('', 'SH') THEN c || '.SH' WHEN substr(c, 1, 3) IN ('300', '000') AND sfx IN ('', 'SZ') THEN c || '.SZ'
 WHEN substr(c, 1, 1) = '8' AND sfx IN ('', 'BJ') THEN c || '.BJ' END"""


@query("x11_normal_codes", f"WITH {RAW_SQL}, c AS (SELECT *, string_split(code, '.')[1] AS c, coalesce(string_split(code, '.')[2], '') AS sfx FROM rw) SELECT {ROWS}, {NORM} AS symbol FROM c")
def x11(spark, folder):
    return raw_rows(spark, folder).select(*ROW, BK.normalize_code(F.col("证券代码")).alias("symbol"))


MARKET_SQL = f"""c AS (SELECT *, string_split(code, '.')[1] AS c0, coalesce(string_split(code, '.')[2], '') AS given, CASE market WHEN '港股' THEN 'HK' WHEN '沪市' THEN 'CN_A' WHEN '深A' THEN 'CN_A' WHEN '北交所' THEN 'CN_A' WHEN 'A股' THEN 'CN_A' END AS hm,
 CASE market WHEN '沪市' THEN 'SH' WHEN '深A' THEN 'SZ' WHEN '北交所' THEN 'BJ' END AS hs FROM rw),
d AS (SELECT *, (given <> '' AND hm = 'HK') OR (given <> '' AND hs IS NOT NULL AND hs <> given) AS conflict, CASE WHEN given <> '' THEN 'CN_A' ELSE hm END AS mk, CASE WHEN given <> '' THEN given ELSE coalesce(hs, '') END AS sfx,
 CASE WHEN given <> '' OR hm = 'CN_A' THEN lpad(c0, 6, '0') ELSE c0 END AS c FROM c),
e AS (SELECT *, CASE WHEN conflict THEN NULL WHEN mk = 'HK' THEN CASE WHEN length(c0) <= 5 THEN lpad(c0, 5, '0') || '.HK' END
  WHEN mk IS NULL AND length(c0) = 5 THEN c0 || '.HK' ELSE {NORM.replace("substr(c, 1, 3) IN ('300', '000')", "substr(c, 1, 3) IN ('300', '000')")} END AS symbol FROM d)"""


@query("x12_market_inference", f"WITH {RAW_SQL}, {MARKET_SQL} SELECT {ROWS}, symbol, CASE WHEN symbol LIKE '%.HK' THEN 'HK' WHEN symbol IS NOT NULL THEN 'CN_A' END AS market FROM e")
def x12(spark, folder):
    return BK.infer_market(raw_rows(spark, folder), "证券代码", "市场").select(*ROW, "symbol", "market")


SIDE = "CASE WHEN business IN ('买入', 'Buy', '融资买入') THEN 'buy' WHEN business IN ('证券卖出', ' sell ') THEN 'sell' END"
FLOW = "CASE business WHEN '银证转入' THEN 'deposit' WHEN '银证转出' THEN 'withdrawal' WHEN '红利入账' THEN 'dividend' WHEN '利息归本' THEN 'interest' WHEN '印花税' THEN 'tax' END"


@query("x13_business_words", f"WITH {RAW_SQL} SELECT {ROWS}, {SIDE} AS side, {FLOW} AS flow, business LIKE '%融资%' AS margin, business LIKE '%送股%' AS corporate FROM rw")
def x13(spark, folder):
    k = F.col("key")
    return raw_rows(spark, folder).withColumn("key", BK.business_key(F.col("业务名称"))).select(*ROW, BK.side_of(k).alias("side"), BK.flow_of(k).alias("flow"), BK.has_any(k, BK.MARGIN_WORDS).alias("margin"),
                                          BK.has_any(k, BK.CORPORATE_WORDS).alias("corporate"))


@query("x14_numbers", f"""WITH {RAW_SQL} SELECT {ROWS}, CASE WHEN l_linenumber = 7 THEN NULL ELSE q END AS quantity, CAST(round(amt, 2) AS DOUBLE) AS price, CAST(CASE WHEN l_linenumber % 4 = 0 THEN -round(amt, 2) ELSE round(amt, 2) END AS DOUBLE) AS amount,
 round(tax * 100, 2) + CASE WHEN l_linenumber % 2 = 0 THEN 1.5 ELSE 0 END AS fees FROM rw""")
def x14(spark, folder):
    fees = BK.fee_total({"佣金": F.col("佣金"), "印花税": F.col("印花税")})
    return raw_rows(spark, folder).select(*ROW, BK.number(F.col("成交数量")).cast("double").alias("quantity"), BK.number(F.col("成交价格")).cast("double").alias("price"),
                                          BK.number(F.col("发生金额")).cast("double").alias("amount"), fees.cast("double").alias("fees"))


@query("x15_timestamps", f"""WITH {RAW_SQL}, x AS (SELECT rw.*, l.l_shipdate AS d FROM rw JOIN lineitem l USING ({ROWS})) SELECT {ROWS}, CASE WHEN l_linenumber % 3 = 1 THEN 'exact' ELSE 'date_only' END AS precision,
 d + CASE WHEN l_linenumber % 3 = 1 THEN INTERVAL 34265 SECOND ELSE INTERVAL 0 SECOND END - INTERVAL 8 HOUR AS occurred_utc FROM x""")
def x15(spark, folder):
    t = F.col("成交时间")
    zone = F.when(F.col("市场") == "港股", "Asia/Hong_Kong").otherwise("Asia/Shanghai")
    return raw_rows(spark, folder).select(*ROW, BK.time_precision(t).alias("precision"), BK.occurred(t, zone).alias("occurred_utc"))


@query("l01_classified_rows", f"""WITH {RAW_SQL}, {MARKET_SQL}, k AS (SELECT *, {SIDE} AS side, {FLOW} AS flow FROM e)
SELECT {ROWS}, CASE WHEN business LIKE '%融资%' OR business LIKE '%送股%' THEN 'unresolved' WHEN side IS NOT NULL THEN CASE WHEN symbol IS NULL OR l_linenumber = 7 THEN 'unresolved' ELSE 'trade' END WHEN flow IS NOT NULL THEN 'flow' ELSE 'unresolved' END AS kind,
 CASE WHEN business LIKE '%融资%' THEN 'margin_unsupported' WHEN business LIKE '%送股%' THEN 'corporate_action' WHEN side IS NOT NULL THEN nullif(concat_ws(',', CASE WHEN symbol IS NULL THEN 'symbol' END, CASE WHEN l_linenumber = 7 THEN 'quantity' END), '')
 WHEN flow IS NULL THEN 'unrecognized_business' END AS reason FROM k""")
def l01(spark, folder):
    """Broker rows become trades, flows or unresolved rows with the reason."""
    k = F.col("key")
    r = BK.infer_market(raw_rows(spark, folder), "证券代码", "市场").withColumn("key", BK.business_key(F.col("业务名称"))).withColumns({
        "side": BK.side_of(k), "flow": BK.flow_of(k), "amount": BK.number(F.col("发生金额")),
        "quantity": BK.number(F.col("成交数量")), "price": BK.number(F.col("成交价格"))})
    key, side, flow, amount, quantity, price, symbol = (F.col(c) for c in ("key", "side", "flow", "amount", "quantity", "price", "symbol"))
    missing = F.concat_ws(
        ",", F.when(BK.normal_date_text(F.col("成交时间")).try_cast("timestamp_ntz").isNull(), "date"), F.when(symbol.isNull(), "symbol"),
        F.when(quantity.isNull() | (quantity <= 0), "quantity"), F.when(price.isNull() | (price <= 0), "price"))
    reason = (F.when(BK.has_any(key, BK.MARGIN_WORDS), "margin_unsupported").when(BK.has_any(key, BK.CORPORATE_WORDS), "corporate_action")
              .when(side.isNotNull(), F.when(missing != "", missing)).when(flow.isNotNull(), F.when(amount.isNull() | (amount == 0), "amount")).otherwise("unrecognized_business"))
    r = r.select(*ROW, "side", reason.alias("reason"))
    return r.select(*ROW, F.when(F.col("reason").isNotNull(), "unresolved").when(F.col("side").isNotNull(), "trade").otherwise("flow").alias("kind"), "reason")


@query("s11_aliased_headers", f"""WITH {RAW_SQL} SELECT trim(business) AS business, count(*) AS n, round(sum(CASE WHEN l_linenumber = 7 THEN 0 ELSE q END), 2) AS quantity FROM rw GROUP BY 1""")
def s11(spark, folder):
    """Broker CSV with Chinese headers, written once and read back through the alias table."""
    path = scratch_path(spark, "broker-csv")
    raw_rows(spark, folder).drop(*ROW).write.option("header", True).csv(path)
    rows = BK.canonical(spark.read.option("header", True).csv(path))
    return rows.groupBy(F.trim("business").alias("business")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(BK.number(F.col("quantity")).cast("double")), 2).alias("quantity"))


@query("x16_ceil_second", "SELECT event_id, CASE WHEN date_trunc('second', ts) = ts THEN ts ELSE date_trunc('second', ts) + INTERVAL 1 SECOND END AS at FROM events".replace(" AS at", " AS ceiled"))
def x16(spark, folder):
    return table(spark, folder, "events").select("event_id", TX.ceil_second(F.col("ts")).alias("ceiled"))


@query("x17_canonical_hash", """SELECT event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS digest FROM events""")
def x17(spark, folder):
    return table(spark, folder, "events").select("event_id", F.sha2(F.to_json(F.struct("event_id", "event_type", "user_id")), 256).alias("digest"))


KEYK = "CAST(json_extract_string(props, '$.k') AS INT)"


@query("x18_market_time", f"""WITH e AS (SELECT event_id, ts, {KEYK} AS k, value FROM events), c AS (SELECT *, CASE WHEN date_trunc('second', ts) = ts THEN ts ELSE date_trunc('second', ts) + INTERVAL 1 SECOND END AS s FROM e)
SELECT event_id, CASE WHEN value < 100 AND k % 11 <> 0 THEN s + to_seconds(k) END AS available_at FROM c""")
def x18(spark, folder):
    e = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    vendor = F.col("ts") + F.make_dt_interval(secs=F.col("k").cast("decimal(18,6)"))
    return e.select("event_id", TX.market_time(F.col("ts"), vendor, F.col("value") < 100, F.col("k") % 11 != 0).alias("available_at"))


@query("x19_math", "SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, round(ln(l_extendedprice), 6) AS ln_price, round(sqrt(l_quantity), 6) AS root, abs(l_quantity - 25) AS dist, greatest(l_discount, l_tax) AS hi, least(l_discount, l_tax) AS lo, CAST(floor(l_extendedprice) AS BIGINT) AS fl, CAST(ceil(l_extendedprice) AS BIGINT) AS ce, round(CAST(l_extendedprice AS DECIMAL(18,2)), 1) AS half_up FROM lineitem", doubles=('half_up',))
def x19(spark, folder):
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, folder, "lineitem").select(
        *ROW, F.round(F.log(p), 6).alias("ln_price"), F.round(F.sqrt(q), 6).alias("root"), F.abs(q - 25).alias("dist"), F.greatest("l_discount", "l_tax").alias("hi"),
        F.least("l_discount", "l_tax").alias("lo"), F.floor(p).alias("fl"), F.ceil(p).alias("ce"), F.round(p.cast("decimal(18,2)"), 1).alias("half_up"))


@query("x20_board_clock", f"""{B}, {BAND} SELECT instrument, session_date, board, CAST(session_date AS TIMESTAMP) + INTERVAL 570 MINUTE AS opens_at, CAST(session_date AS TIMESTAMP) + INTERVAL 900 MINUTE AS closes_at FROM bd""")
def x20(spark, folder):
    from tidemark.functions.market_rules import board

    day = F.col("session_date").cast("timestamp_ntz")
    return mk.bars_daily(spark, folder).select(
        *KEYS, board(mk.listed_code()).alias("board"), (day + F.make_dt_interval(mins=F.lit(570))).alias("opens_at"), (day + F.make_dt_interval(mins=F.lit(900))).alias("closes_at"))


@query("x21_fx_to_base", """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN c_acctbal WHEN c_nationkey % 5 = 0 THEN NULL ELSE round(c_acctbal * (0.9 + c_nationkey / 100.0), 4) END AS base_amount, c_nationkey % 3 <> 0 AND c_nationkey % 5 = 0 AS quarantined FROM customer""")
def x21(spark, folder):
    """Amounts in the base currency; a foreign amount needs a positive rate."""
    n = F.col("c_nationkey")
    foreign, rate = n % 3 != 0, F.when(n % 5 == 0, 0.0).otherwise(0.9 + n / 100)
    return table(spark, folder, "customer").select(
        "c_custkey", F.when(~foreign, F.col("c_acctbal")).when(rate > 0, F.round(F.col("c_acctbal") * rate, 4)).alias("base_amount"), (foreign & (rate <= 0)).alias("quarantined"))


@query("x22_attribute_merge", f"""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type AS p, {KEYK} AS k, value, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS r FROM events)
SELECT user_id, day, arg_min(k, {{'r': r, 'e': event_id}}) FILTER (WHERE k % 2 = 0) AS even_key, arg_min(k, {{'r': r, 'e': event_id}}) FILTER (WHERE k % 2 = 1) AS odd_key, arg_min(value, {{'r': r, 'e': event_id}}) AS amount FROM e GROUP BY 1, 2""")
def x22(spark, folder):
    """Attributes of all sources merged, the first source in priority order wins each name."""
    from tidemark.operators.events import first_by_priority, provider_rank

    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, folder, "events").select(
        "user_id", F.to_date("ts").alias("day"), "event_id", provider_rank(F.col("event_type")).alias("rank"),
        F.when(k % 2 == 0, k).alias("even_key"), F.when(k % 2 == 1, k).alias("odd_key"), F.col("value").alias("amount"))
    return first_by_priority(e, ["user_id", "day"], ["rank", "event_id"], ["even_key", "odd_key", "amount"])


# ---- scans and sinks ------------------------------------------------------------------


def stored(spark, df, schema, label, partition_by=(), sort_by=()):
    path = scratch_path(spark, label)
    ST.write(df, path, schema, partition_by, sort_by)
    return path


def both_bases(spark, folder):
    raw = mk.bars_daily(spark, folder).withColumn("price_basis", F.lit("unadjusted"))
    adj = raw.withColumns({c: F.round(F.col(c) * 1.5, 3) for c in ("open", "high", "low", "close")}).withColumn("price_basis", F.lit("back_adjusted"))
    return raw.unionByName(adj)


RANGE = "session_date >= DATE '1997-01-01' AND session_date < DATE '1999-01-01'"


@query("s01_daily_scan", f"WITH {BARS} SELECT instrument, session_date, close, volume FROM bars WHERE {RANGE}")
def s01(spark, folder):
    path = stored(spark, both_bases(spark, folder), ST.DAILY, "daily", ("price_basis",), ("instrument", "session_date"))
    return ST.scan_bars(spark, path, ("instrument", "session_date", "close", "volume"), "unadjusted", "1997-01-01", "1999-01-01")


@query("s02_adjusted_scan", f"WITH {BARS} SELECT instrument, session_date, round(close * 1.5, 3) AS close FROM bars WHERE {RANGE}")
def s02(spark, folder):
    path = stored(spark, both_bases(spark, folder), ST.DAILY, "daily", ("price_basis",), ("instrument", "session_date"))
    return ST.scan_bars(spark, path, ("instrument", "session_date", "close"), "back_adjusted", "1997-01-01", "1999-01-01")


def minute_store(spark, folder):
    h = mk.bars_hour(spark, folder).select(F.col("event_type").alias("instrument"), F.to_date("bar_start").alias("day"), "bar_start", "open", "high", "low", "close", "volume", "amount")
    return stored(spark, h, ST.MINUTE, "minute", ("day",), ("instrument", "bar_start"))


@query("s03_minute_scan", f"WITH {HOURS} SELECT event_type AS instrument, bar_start, open, high, low, close, volume FROM hb WHERE bar_start >= TIMESTAMP '2024-01-05 09:00:00' AND bar_start < TIMESTAMP '2024-01-20 15:00:00'")
def s03(spark, folder):
    where = ST.span("bar_start", "2024-01-05 09:00:00", "2024-01-20 15:00:00", "timestamp_ntz") & ST.span("day", "2024-01-05", "2024-01-21")
    return ST.scan(spark, minute_store(spark, folder), ST.MINUTE, ("instrument", "bar_start", "open", "high", "low", "close", "volume"), where)


@query("s04_minute_closes", f"WITH {HOURS} SELECT event_type AS instrument, bar_start, round(close * 1.5, 4) AS close FROM hb WHERE bar_start >= TIMESTAMP '2024-01-05' AND bar_start < TIMESTAMP '2024-01-20'")
def s04(spark, folder):
    where = ST.span("bar_start", "2024-01-05", "2024-01-20", "timestamp_ntz") & ST.span("day", "2024-01-05", "2024-01-20")
    rows = ST.scan(spark, minute_store(spark, folder), ST.MINUTE, ("instrument", "bar_start", "close"), where)
    return rows.withColumn("close", F.round(F.col("close") * 1.5, 4))


@query("s05_session_scan", f"{B}, {BAND} SELECT instrument, session_date, board, {BAND_COLS} FROM bd WHERE {RANGE}", doubles=('upper_limit', 'lower_limit'))
def s05(spark, folder):
    path = stored(spark, session_rows(spark, folder), ST.SESSIONS, "sessions", (), ("instrument", "session_date"))
    return ST.scan(spark, path, ST.SESSIONS, (*KEYS, "board", "upper_limit", "lower_limit"), ST.span("session_date", "1997-01-01", "1999-01-01"))


@query("s06_event_versions", "SELECT 1 AS version, count(*) AS n, count(*) FILTER (WHERE false) AS with_attributes FROM events UNION ALL SELECT 2, count(*), count(props) FROM events")
def s06(spark, folder):
    """Files of both versions open under one projection chosen by their columns."""
    e = table(spark, folder, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", F.col("props").alias("attributes_json"))
    out = None
    for version, schema in ((1, ST.EVENTS_V1), (2, ST.EVENTS_V2)):
        rows = ST.scan_events(spark, stored(spark, e, schema, f"events-v{version}"))
        n = rows.agg(F.count(F.lit(1)).alias("n"), F.count("attributes_json").alias("with_attributes")).select(F.lit(version).alias("version"), "n", "with_attributes")
        out = n if out is None else out.unionByName(n)
    return out


@query("s07_action_scan", f"WITH {ACT} SELECT instrument, action_id, kind, ex_date FROM act WHERE ex_date >= DATE '1997-01-01' AND ex_date < DATE '1999-01-01'")
def s07(spark, folder):
    path = stored(spark, mk.corporate_actions(spark, folder), ST.ACTIONS, "actions", (), ("ex_date",))
    return ST.scan(spark, path, ST.ACTIONS, ("instrument", "action_id", "kind", "ex_date"), ST.span("ex_date", "1997-01-01", "1999-01-01"))


@query("s08_minute_export", f"""WITH {HOURS} SELECT event_type AS ts_code, bar_start AS trade_time, CAST(round(open, 6) AS DECIMAL(20,6)) AS open, CAST(round(close, 6) AS DECIMAL(20,6)) AS close,
 CASE WHEN hour(bar_start) % 5 <> 0 THEN volume END AS volume, hour(bar_start) % 5 = 0 AS rejected FROM hb""", doubles=('open', 'close'))
def s08(spark, folder):
    h = mk.bars_hour(spark, folder)
    tail = {c: F.col(c) + 1e-10 for c in ("open", "high", "low", "close")}
    vol = F.col("volume") + F.when(F.hour("bar_start") % 5 == 0, 0.5).otherwise(0.0)
    rows = h.select(F.col("event_type").alias("ts_code"), F.col("bar_start").alias("trade_time"), *[c.alias(n) for n, c in tail.items()], vol.alias("vol"), "amount")
    return ST.minute_export(rows).select("ts_code", "trade_time", "open", "close", "volume", "rejected")


FROM, TO = "2024-01-05", "2024-01-12"


@query("s08_minute_range", f"""WITH {HOURS} SELECT event_type AS ts_code, bar_start AS trade_time, CAST(round(open, 6) AS DECIMAL(20,6)) AS open, CAST(round(close, 6) AS DECIMAL(20,6)) AS close, hour(bar_start) % 5 = 0 AS rejected
 FROM hb WHERE CAST(bar_start AS DATE) BETWEEN DATE '{FROM}' AND DATE '{TO}' AND event_type <> 'error'""", doubles=('open', 'close'))
def s08_range(spark, folder):
    """The whole export in a sorted store, then one range of each of four symbols out of it."""
    h = mk.bars_hour(spark, folder)
    vol = F.col("volume") + F.when(F.hour("bar_start") % 5 == 0, 0.5).otherwise(0.0)
    rows = h.select(F.col("event_type").alias("ts_code"), F.to_date("bar_start").alias("trade_date"), F.col("bar_start").alias("trade_time"), "open", "high", "low", "close", vol.alias("vol"), "amount")
    path = scratch_path(spark, "minute-export")
    ST.write_minutes(rows, path)
    out = None
    for symbol in ("click", "purchase", "signup", "view"):
        part = ST.read_minutes(spark, path, symbol, FROM, TO).select("ts_code", "trade_time", "open", "close", "rejected")
        out = part if out is None else out.unionByName(part)
    return out


DATED = {"daily": ("bars", "session_date"), "facts": ("fx", "notice_date"), "actions": ("act", "ex_date"), "valuation": ("val", "session_date"), "minute": ("hb", "CAST(bar_start AS DATE)"), "events": ("events", "CAST(ts AS DATE)")}
DATED_SQL = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, min(CAST(strftime({d}, '%Y%m%d') AS INTEGER)) AS first_int, max(CAST(strftime({d}, '%Y%m%d') AS INTEGER)) AS last_int FROM {t}" for n, (t, d) in DATED.items())


@query("s09_market_store", f"WITH {BARS}, {ACT}, {VALUATION}, {HOURS} {DATED_SQL}")
def s09(spark, folder):
    """Open the six stored tables, derive date_int and report their ranges."""
    facts_schema = "instrument bigint, report_period date, notice_date date, value double, revision_id bigint"
    value_schema = "instrument bigint, session_date date, pe_ttm double, pb double"
    events = table(spark, folder, "events").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type", F.col("props").alias("attributes_json"))
    tables = {
        "daily": (both_bases(spark, folder).filter(F.col("price_basis") == "unadjusted"), ST.DAILY, "session_date"),
        "facts": (mk.facts(spark, folder), facts_schema, "notice_date"),
        "actions": (mk.corporate_actions(spark, folder), ST.ACTIONS, "ex_date"),
        "valuation": (mk.valuation(spark, folder), value_schema, "session_date"),
        "events": (events, ST.EVENTS_V2, "day"),
    }
    paths = {n: stored(spark, df, schema, n, (), (day,)) for n, (df, schema, day) in tables.items()} | {"minute": minute_store(spark, folder)}
    schemas = {n: schema for n, (_, schema, _) in tables.items()} | {"minute": ST.MINUTE}
    t = ST.load_store(spark, paths, schemas, {n: day for n, (_, _, day) in tables.items()} | {"minute": "day"})
    out = None
    for n, df in t.items():
        part = df.agg(F.count(F.lit(1)).alias("n"), F.min("date_int").alias("first_int"), F.max("date_int").alias("last_int")).select(F.lit(n).alias("name"), "n", "first_int", "last_int")
        out = part if out is None else out.unionByName(part)
    return out


LINES_SQL = """ln AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'field_count' WHEN o_orderkey % 13 = 1 THEN 'date' WHEN o_orderkey % 13 = 2 THEN 'number' WHEN o_orderkey % 13 = 3 THEN 'close' WHEN o_orderkey % 13 = 4 THEN 'identity' END AS problem,
 CAST(o_orderdate AS DATE) AS d, o_totalprice AS p FROM orders)"""


def flow_lines(spark, folder):
    """Text lines of daily fund flows, five kinds of defect among them."""
    k = F.col("o_orderkey") % 13
    p = F.col("o_totalprice").cast("decimal(18,2)")
    big, small = F.floor(p / 3), F.floor(p / 5)
    main = big + small + F.when(k == 4, 5000).otherwise(0)
    fields = [F.when(k == 1, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), main, F.lit("1"), F.when(k == 2, "x").otherwise("2"), big, small, *[F.lit(str(i)) for i in range(5)],
              F.when(k == 3, "-1").otherwise(p.cast("string")), F.lit("0.5")]
    line = F.concat_ws(",", *[f.cast("string") for f in fields])
    return table(spark, folder, "orders").select(F.when(k == 0, F.lit("2024-01-01,1,2")).otherwise(line).alias("value"))


def parsed_lines(spark, folder):
    path = scratch_path(spark, "flow-lines")
    flow_lines(spark, folder).write.text(path)
    return ST.parse_fund_flow(spark.read.text(path))


@query("s10_fund_flow_lines", f"WITH {LINES_SQL} SELECT d AS trade_date, CAST(p AS DECIMAL(18,2)) AS close FROM ln WHERE problem IS NULL", doubles=('close',))
def s10(spark, folder):
    return parsed_lines(spark, folder).filter("problem is null").select("trade_date", F.col("close").cast("decimal(18,2)").alias("close"))


@query("l11_flow_identity", f"WITH {LINES_SQL} SELECT coalesce(problem, 'ok') AS problem, count(*) AS n FROM ln GROUP BY 1")
def l11(spark, folder):
    return parsed_lines(spark, folder).groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


def digest_parts():
    return [F.col("instrument"), F.col("session_date"), F.round(F.col("close") * 100).cast("long"), F.col("volume").cast("long")]



FIELD_SQL = [f"CASE WHEN {c} IS NULL THEN 'N' ELSE length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in
             ("instrument", "session_date", "CAST(round(close * 100) AS BIGINT)", "CAST(volume AS BIGINT)")]
SHA_SQL = f"sha256({chr(32).join(['concat_ws(', repr('|'), ',', ', '.join(FIELD_SQL), ')'])})"
DIGEST_SQL = "concat_ws('-', " + ", ".join(f"CAST(sum(CAST(CAST('0x' || substr(h, {15 * i + 1}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for i in range(4)) + ")"


@query("s12_sink_manifest", f"WITH {BARS}, hs AS (SELECT session_date, {SHA_SQL} AS h FROM bars) SELECT CAST(year(session_date) AS INTEGER) AS year, count(*) AS rows, {DIGEST_SQL} AS digest FROM hs GROUP BY 1")
def s12(spark, folder):
    """Sorted Parquet with a declared schema; the manifest is computed from what was written and kept beside it."""
    b = mk.bars_daily(spark, folder).withColumn("price_basis", F.lit("unadjusted"))
    path = stored(spark, b, ST.DAILY, "daily", (), ("instrument", "session_date"))
    return ST.write_manifest(spark, path, ST.DAILY, digest_parts(), {"year": F.year("session_date")})


@query("s13_quarantine_sink", f"WITH {LINES_SQL} SELECT 'accepted' AS output, count(*) FILTER (WHERE problem IS NULL) AS n FROM ln UNION ALL SELECT 'quarantined', count(*) FILTER (WHERE problem IS NOT NULL) FROM ln")
def s13(spark, folder):
    good, bad = ST.split_quarantine(parsed_lines(spark, folder), F.col("problem").isNull(), scratch_path(spark, "lines"))

    def count(rows, label):
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("output"), "n")

    return count(good, "accepted").unionByName(count(bad, "quarantined"))


@query("s14_fingerprint", f"WITH {BARS}, hs AS (SELECT {SHA_SQL} AS h FROM bars) SELECT count(*) AS rows, {DIGEST_SQL} AS digest FROM hs")
def s14(spark, folder):
    return ST.fingerprint(mk.bars_daily(spark, folder), digest_parts())
