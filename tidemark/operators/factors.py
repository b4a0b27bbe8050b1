"""Latest-factor snapshot of the whole market and screens over it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import DAILY, Axis


def dividend_yield(bars: DataFrame, actions: DataFrame, days: int = 365) -> DataFrame:
    """Implemented cash of the last year over the latest close."""
    last = bars.groupBy("instrument").agg(F.max_by("close", "session_date").alias("latest_close"))
    end = bars.agg(F.max("session_date")).scalar()
    paid = (
        actions.filter(F.col("status") == "F")
        .filter((F.col("ex_date") >= F.date_sub(end, days)) & (F.col("ex_date") <= end))
        .groupBy("instrument")
        .agg(F.sum("gross_cash").alias("_cash"))
    )
    value = F.coalesce("_cash", F.lit(0.0)) / F.col("latest_close")
    return last.join(paid, "instrument", "left").select("instrument", "latest_close", F.round(value, 8).alias("dividend_yield"))


def latest_factors(bars: DataFrame, valuation: DataFrame, facts: DataFrame, actions: DataFrame,
                   stale_days: int = 30, axis: Axis = DAILY) -> DataFrame:
    """One row per instrument: momentum, volatility, turnover, valuation, reports, yield."""
    b = bars.withColumn("_r", F.col("close") / axis.lag("close") - 1)
    b = b.withColumns(
        {
            "momentum_60": F.col("close") / axis.lag("close", 60) - 1,
            "volatility_60": axis.rolling(F.stddev_samp, "_r", 60) * math.sqrt(252),
            "turnover_avg_20": axis.mean("turnover_rate", 20),
        }
    )
    names = ("close", "momentum_60", "volatility_60", "turnover_avg_20")
    last = b.groupBy("instrument").agg(F.max(F.struct("session_date", *names)).alias("_b"))
    end = bars.agg(F.max("session_date")).scalar()
    v = valuation.filter("pe_ttm is not null or pb is not null").groupBy("instrument").agg(F.max(F.struct("session_date", "pe_ttm", "pb")).alias("_v"))
    f = (
        facts.filter(F.col("notice_date") <= end)
        .groupBy("instrument")
        .agg(F.max(F.struct("notice_date", "revision_id", "value")).alias("_f"))
    )
    y = dividend_yield(bars, actions).select("instrument", "dividend_yield")
    out = last.join(v, "instrument", "left").join(f, "instrument", "left").join(y, "instrument", "left")
    positive = {c: F.when(F.col(f"_v.{c}") > 0, F.col(f"_v.{c}")) for c in ("pe_ttm", "pb")}
    return out.select(
        "instrument",
        F.col("_b.session_date").alias("latest_date"),
        F.col("_b.close").alias("latest_close"),
        (F.col("_b.session_date") >= F.date_sub(end, stale_days)).alias("is_active"),
        *[F.col(f"_b.{c}").alias(c) for c in names[1:]],
        *[c.alias(n) for n, c in positive.items()],
        F.col("_f.value").alias("report_value"),
        "dividend_yield",
    )
