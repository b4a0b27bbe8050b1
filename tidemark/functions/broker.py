"""Broker-ledger vocabulary: header aliases, business words, numbers and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted headers of each field.
HEADERS = {
    "occurred_at": ("executed_at", "trade_time", "trade_date", "as_of", "date", "datetime", "成交时间", "成交日期", "发生日期",
                    "业务日期", "持仓时间", "持仓日期", "截至日期", "报告日期", "日期"),
    "symbol": ("symbol", "code", "security_code", "stock_code", "证券代码", "股票代码", "代码"),
    "name": ("name", "security_name", "stock_name", "证券名称", "证券简称", "股票名称", "名称"),
    "business": ("side", "business", "business_type", "trade_type", "买卖方向", "买卖标志", "业务名称", "业务类型", "操作"),
    "quantity": ("quantity", "qty", "trade_quantity", "position_quantity", "holding_quantity", "成交数量", "成交股数", "发生数量",
                 "持仓数量", "股票余额", "数量"),
    "price": ("price", "trade_price", "成交价格", "成交价", "价格"),
    "amount": ("amount", "trade_amount", "发生金额", "成交金额", "资金发生数", "金额"),
    "realized_pnl": ("realized_pnl", "realized_profit", "已实现盈亏", "实现盈亏", "清算盈亏"),
    "currency": ("currency", "币种", "货币"),
    "market": ("market", "exchange", "市场", "交易市场", "交易所"),
    "fx_to_base": ("fx_to_base", "exchange_rate", "汇率", "折算汇率"),
    "balance_quantity": ("balance_quantity", "share_balance", "股份余额", "证券余额", "股票余额", "剩余数量"),
}
FEE_TOTALS = ("fees", "fee", "手续费")
FEE_PARTS = ("fees", "fee", "commission", "stamp_tax", "transfer_fee", "手续费", "佣金", "印花税", "过户费", "规费")
# Words of the business column.
BUY_WORDS = ("buy", "b", "买入", "证券买入", "股票买入")
SELL_WORDS = ("sell", "s", "卖出", "证券卖出", "股票卖出")
FLOW_WORDS = {
    "deposit": ("deposit", "入金", "银证转入", "银行转证券", "资金转入"),
    "withdrawal": ("withdrawal", "出金", "银证转出", "证券转银行", "资金转出"),
    "dividend": ("dividend", "红利", "股息", "派息", "红利入账"),
    "interest": ("interest", "利息", "结息"),
    "fee": ("fee", "费用", "手续费"),
    "tax": ("tax", "税费", "红利税", "印花税"),
}
CORPORATE_WORDS = ("送股", "转增", "配股", "拆股", "合股", "红股", "stocksplit", "stockdividend", "rightsissue", "shareconsolidation")
MARGIN_WORDS = ("融资", "融券", "卖券还款", "买券还券", "margin", "shortsell")


def canonical(rows: DataFrame) -> DataFrame:
    """Rename aliased headers; where several aliases are present the first non-null wins."""
    have = {c.strip().lower(): c for c in rows.columns}
    out = {}
    for field, aliases in HEADERS.items():
        present = [F.col(f"`{have[a]}`") for a in aliases if a in have]
        out[field] = F.coalesce(*present) if present else F.lit(None).cast("string")
    out["fees"] = fee_total({a: F.col(f"`{have[a]}`") for a in FEE_PARTS if a in have})
    return rows.select(*[c.alias(n) for n, c in out.items()])


def business_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))


def has_any(key: Column, words: tuple[str, ...]) -> Column:
    """Whether the key holds a word. A lambda, which keeps the projection out of whole-stage code: one method of a chain of terms
    for each word is too long for the JIT compiler and runs interpreted."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(key, w))


def side_of(k: Column) -> Column:
    """Side named by a folded business key."""
    return F.when(k.isin(*BUY_WORDS) | F.contains(k, F.lit("买入")), "buy").when(
        k.isin(*SELL_WORDS) | F.contains(k, F.lit("卖出")), "sell"
    )


def flow_of(k: Column) -> Column:
    """Cash-flow kind named by a folded business key."""
    branches = [(k.isin(*w) | has_any(k, tuple(x for x in w if len(x) >= 2)), F.lit(n)) for n, w in FLOW_WORDS.items()]
    return F.coalesce(*[F.when(c, v) for c, v in branches])


def number(text: Column) -> Column:
    """Decimal with separators, currency marks and accounting parentheses; NULL if unreadable."""
    t = F.trim(text)
    negative = t.startswith("(") & t.endswith(")")
    bare = F.regexp_replace(t, r"HK\$|RMB|CNY|HKD|[,，¥￥()\s]", "")
    value = bare.try_cast("decimal(24,6)")
    return value * F.when(negative, -1).otherwise(1)


def fee_total(columns: dict[str, Column]) -> Column:
    """The fee column if there is one, else the sum of the parts."""
    totals = [F.abs(number(columns[n])) for n in FEE_TOTALS if n in columns]
    zero = F.lit(0).cast("decimal(24,6)")
    parts = reduce(lambda a, b: a + b, [F.coalesce(F.abs(number(c)), zero) for c in columns.values()], zero)
    return F.coalesce(*totals, parts) if totals else parts


def normal_date_text(text: Column) -> Column:
    t = F.translate(F.trim(text), "/", "-")
    compact = F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2))
    month = F.regexp_replace(t, r"^(\d{4})-(\d)-", "$1-0$2-")
    padded = F.regexp_replace(month, r"^(\d{4}-\d{2})-(\d)(?!\d)", "$1-0$2")
    return F.when(t.rlike(r"^\d{8}$"), compact).when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}.*$"), padded).otherwise(t)


def occurred(text: Column, zone: Column) -> Column:
    """Instant of a local timestamp text in the market's zone; NULL if unreadable."""
    local = normal_date_text(text).try_cast("timestamp_ntz")
    return F.convert_timezone(zone, F.lit("UTC"), local)


def time_precision(text: Column) -> Column:
    return F.when(F.coalesce(normal_date_text(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(True)), "date_only").otherwise("exact")


def hint_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[\s_\-]+", ""))


def market_hint(k: Column) -> tuple[Column, Column]:
    """(market, exchange suffix) of a folded hint; both NULL when it says nothing usable."""
    hk = k.isin("hk", "hkg", "hkex", "sehk", "xhongkong") | has_any(k, ("香港", "港股", "港交所"))
    sh = k.isin("sh", "sha", "sse", "xshg") | has_any(k, ("上海", "沪市", "沪a", "上交所", "科创"))
    sz = k.isin("sz", "sza", "szse", "xshe") | has_any(k, ("深圳", "深市", "深a", "深交所", "创业"))
    bj = k.isin("bj", "bja", "bse", "xbse") | has_any(k, ("北京", "北交所", "北证"))
    cn = k.isin("a", "a股", "cna", "china", "mainland", "沪深", "沪深a股", "内地")
    market = F.when(hk, "HK").when(sh | sz | bj | cn, "CN_A")
    suffix = F.when(sh, "SH").when(~sh & sz, "SZ").when(~sh & ~sz & bj, "BJ")
    return market, suffix


# Code spaces of the three exchanges.
CODE_SPACES = {
    "SH": r"(?:600|601|603|605|688|689)\d{3}",
    "SZ": r"(?:(?:000|001|002|003|300|301)\d{3}|302132)",
    "BJ": r"(?:[48]\d{5}|920\d{3})",
}


def normalize_code(text: Column) -> Column:
    """``dddddd.SH/SZ/BJ``; NULL for malformed codes and for a suffix that contradicts the code."""
    return _full_code(F.upper(F.trim(text)))


def _full_code(t: Column) -> Column:
    """One pattern for each exchange: its codes, alone or with its own suffix."""
    found = [F.when(t.rlike(rf"^{p}(?:\.{x})?$"), F.lit(f".{x}")) for x, p in CODE_SPACES.items()]
    return F.concat(F.substring(t, 1, 6), F.coalesce(*found))


def infer_market(rows: DataFrame, code: str, market: str) -> DataFrame:
    """Add ``market`` and ``symbol`` from a raw code and a market hint; NULL when they conflict or stay unclear.

    Staged as columns instead of one nested expression, so generated code stays small.
    """
    hinted, hint_suffix = market_hint(F.col("_hk"))
    df = rows.withColumn("_hk", hint_key(F.col(f"`{market}`"))).withColumns(
        {
            "_s": F.regexp_replace(F.upper(F.trim(F.col(f"`{code}`"))), r"^(\d+)\.0+$", "$1"),
            "_hm": hinted,
            "_hs": hint_suffix,
        }
    )
    df = df.withColumn("_given", F.regexp_extract("_s", r"\.([^.]*)$", 1))
    given, s = F.col("_given"), F.col("_s")
    df = df.withColumns(
        {
            "_code": F.when(given != "", F.regexp_extract(s, r"^(.*)\.[^.]*$", 1)).otherwise(s),
            "_own": F.when(given == "HK", "HK").when(given.isin("SH", "SZ", "BJ"), "CN_A"),
        }
    )
    c, own, hm, hs = F.col("_code"), F.col("_own"), F.col("_hm"), F.col("_hs")
    blank = F.col(f"`{market}`").isNull() | (F.trim(F.col(f"`{market}`")) == "")
    conflict = (
        ((given != "") & own.isNull())
        | (~blank & hm.isNull())
        | F.coalesce(own != hm, F.lit(False))
        | F.coalesce(given.isin("SH", "SZ", "BJ") & (hs != given), F.lit(False))
    )
    digits = c.rlike(r"^\d+$")
    suffix = F.coalesce(F.when(given != "", given), hs)
    padded = F.when(digits & (F.length(c) <= 6), F.lpad(c, 6, "0"))
    df = df.withColumns(
        {
            "_market": F.when(~conflict, F.coalesce(own, hm, F.lit("?"))),
            "_hk": F.when(digits & (F.length(c) <= 5), F.concat(F.lpad(c, 5, "0"), F.lit(".HK"))),
            "_full": F.when(suffix.isNotNull(), F.concat(padded, F.lit("."), suffix)).otherwise(padded),
        }
    )
    m = F.col("_market")
    df = df.withColumn("_asked", F.upper(F.trim(F.when(m == "CN_A", F.col("_full")).when(m == "?", s))))
    df = df.withColumn("_cn", _full_code(F.col("_asked")))
    bare = F.coalesce(F.col("_cn"), F.when(c.rlike(r"^\d{5}$"), F.concat(c, F.lit(".HK"))))
    df = df.withColumn("symbol", F.when(m == "HK", F.col("_hk")).when(m == "CN_A", F.col("_cn")).when(m == "?", bare))
    df = df.withColumn("market", F.when(F.col("symbol").endswith(".HK"), "HK").when(F.col("symbol").isNotNull(), "CN_A"))
    return df.drop("_s", "_hm", "_hs", "_given", "_code", "_own", "_market", "_hk", "_full", "_asked", "_cn")
