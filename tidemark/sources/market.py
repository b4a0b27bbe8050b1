"""Canonical market views derived from the stored trade, order and event tables.

Every bar view aggregates before it shuffles: one row per (instrument, day)
leaves each map task, so a hot instrument never sends its raw ticks anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table

CENTS = "decimal(18,2)"
TICKS_A_TASK = 250_000  # of the instruments that a task of windows holds


def tick_order() -> Column:
    """Total order of the ticks of one instrument-day: order, line, part, as one decimal number.

    A number instead of a struct keeps ``min_by``/``max_by`` in hash aggregation. Each key has digits of its own (19 for a part,
    4 for a line, the rest for an order), so any part key fits; an order or line key beyond its digits is an error.
    """
    order, line, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    fits = order.between(0, 9 * 10**14) & line.between(0, 9999) & (part >= 0)
    head = (order.cast("long") * 10000 + line).cast("decimal(19,0)")
    number = (head * F.lit("10000000000000000000").cast("decimal(20,0)") + part.cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.when(fits, number).otherwise(F.raise_error(F.concat(F.lit("tick order out of range: "), F.concat_ws("/", order, line, part))))


def unit_price() -> Column:
    """Price per unit, cut to whole cents (the price tick) in integer arithmetic."""
    return F.expr("cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)") / 100


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("instrument"),
        F.to_date("l_shipdate").alias("session_date"),
        tick_order().alias("tick_no"),
        unit_price().alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").cast(CENTS).alias("amount"),
    )


def daily_from_ticks(rows: DataFrame, keys: tuple[str, ...] = ("instrument", "session_date")) -> DataFrame:
    """First/last/max/min/sum of trades per key."""
    return rows.groupBy(*keys).agg(
        F.min_by("price", "tick_no").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "tick_no").alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum("amount").cast("double").alias("amount"),
    )


def bars_daily(spark: SparkSession, folder: str) -> DataFrame:
    return daily_from_ticks(ticks(spark, folder))


def series_parts(spark: SparkSession, folder: str) -> int:
    """Partitions for windows over whole instruments, from the number of ticks (read from the footers of the files).

    Adaptive coalescing goes by compressed bytes of a shuffle. A chain of windows holds many times that, once for each sort.
    """
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, folder, "lineitem").count() // TICKS_A_TASK))


def bars_by_instrument(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars dealt for windows over instruments, which need no further shuffle."""
    return bars_daily(spark, folder).repartition(series_parts(spark, folder), "instrument")


def day_number(date: Column | str) -> Column:
    return F.datediff(F.col(date) if isinstance(date, str) else date, F.lit("1970-01-01").cast("date"))


def bars_suspended(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars in which a fixed rule marks some sessions as suspended (no volume)."""
    halted = (F.col("instrument") + day_number("session_date")) % 17 == 0
    bars = bars_by_instrument(spark, folder)
    return bars.withColumn("volume", F.when(halted, F.lit(0.0)).otherwise(F.col("volume"))).withColumn(
        "tradable", F.col("volume") > 0
    )


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Market sessions. One row per distinct date, so numbering it in one place stays small."""
    from pyspark.sql import Window as W

    days = table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("session_date")).distinct()
    return days.withColumn("session_no", F.row_number().over(W.orderBy("session_date")).cast("long"))


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Long table of disclosed values: the period they describe and the day they became known."""
    n = table(spark, folder, "supplier").agg(F.count(F.lit(1))).scalar()
    return table(spark, folder, "orders").select(
        (F.col("o_custkey") % n).alias("instrument"),
        F.date_sub(F.trunc("o_orderdate", "quarter"), 1).alias("report_period"),
        F.to_date("o_orderdate").alias("notice_date"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderkey").alias("revision_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """Executed trades of many accounts with a total order inside each day."""
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("account"),
        (F.col("l_partkey") % 5).alias("symbol"),
        F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.to_date("l_shipdate").alias("trade_date"),
        tick_order().alias("seq"),
        F.col("l_quantity").alias("quantity"),
        unit_price().alias("price"),
        F.col("l_extendedprice").alias("amount"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("fees"),
        F.when(F.col("l_linestatus") == "O", "date_only").otherwise("exact").alias("precision"),
    )


def listed_code(instrument: Column | str = "instrument") -> Column:
    """Code of at least six digits, one for each instrument, whose prefix spreads them over the four boards."""
    i = F.col(instrument) if isinstance(instrument, str) else instrument
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("600", "300", "688", "830")]), (i % 4 + 1).cast("int"))
    number = i.cast("string")
    return F.concat(prefix, F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")))


def valuation(spark: SparkSession, folder: str) -> DataFrame:
    """Dated valuation ratios; they are unknown in many sessions, and some are not positive."""
    li = table(spark, folder, "lineitem").select(
        "l_partkey", "l_returnflag", F.col("l_suppkey").alias("instrument"), F.to_date("l_shipdate").alias("session_date")
    )
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    quoted = F.when(F.col("l_returnflag") == "A", F.col("p_retailprice"))
    return li.join(part, "l_partkey").groupBy("instrument", "session_date").agg((F.min(quoted) - 950).alias("pe_ttm"), (F.max(quoted) / 500).alias("pb"))


def bars_of(spark: SparkSession, folder: str, condition: Column) -> DataFrame:
    """Daily bars over the trades that satisfy a condition, with the number of the last tick."""
    rows = table(spark, folder, "lineitem").filter(condition).select(
        F.col("l_suppkey").alias("instrument"),
        F.to_date("l_shipdate").alias("session_date"),
        tick_order().alias("tick_no"),
        unit_price().alias("price"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").cast(CENTS).alias("amount"),
    )
    return rows.groupBy("instrument", "session_date").agg(
        F.min_by("price", "tick_no").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "tick_no").alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum("amount").cast("double").alias("amount"),
        F.count(F.lit(1)).alias("ticks"),
        F.max("tick_no").alias("available_no"),
    )


def corporate_actions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders read as corporate actions of an instrument, several kinds and terms."""
    return facts(spark, folder).select(
        "instrument",
        F.col("revision_id").alias("action_id"),
        F.element_at(
            F.array(*[F.lit(k) for k in ("cash", "bonus", "split", "rights", "transfer")]),
            (F.col("revision_id") % 5 + 1).cast("int"),
        ).alias("kind"),
        F.col("notice_date").alias("record_date"),
        F.date_add("notice_date", 1).alias("ex_date"),
        F.date_add("notice_date", 10).alias("pay_date"),
        F.date_sub("notice_date", 7).alias("known_date"),
        (F.col("revision_id") % 100 / 100).alias("gross_cash"),
        (1 + F.col("revision_id") % 3 * 0.5).alias("multiplier"),
        "status",
    )


def bars_hour(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars of event values per event type."""
    return table(spark, folder, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar_start")).agg(
        F.min_by("value", "event_id").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "event_id").alias("close"),
        F.count(F.lit(1)).alias("volume"),
        F.sum(F.col("value").cast(CENTS)).alias("amount"),
    )
