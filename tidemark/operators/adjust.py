"""Price adjustment and derived reference data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import market_rules as R
from tidemark.functions.windows import DAILY, Axis

OHLC = ("open", "high", "low", "close")


def later_total(bars: DataFrame, events: DataFrame, value: str, out: str, aggregate=F.sum) -> DataFrame:
    """Sum of an event value over strictly later days of the same instrument.

    ``events`` has (instrument, day, value) and is reduced to one row per day
    first; bars and events meet in one ordered window instead of a range join.
    """
    e = events.groupBy("instrument", F.col("day").alias("session_date")).agg(aggregate(value).alias("_v"))
    both = bars.withColumn("_bar", F.lit(True)).join(e, ["instrument", "session_date"], "full_outer")
    w = Window.partitionBy("instrument").orderBy("session_date").rowsBetween(1, Window.unboundedFollowing)
    total = F.coalesce(F.sum("_v").over(w), F.lit(0.0))
    return both.withColumn(out, total).filter("_bar").drop("_bar", "_v")


def front_adjusted(bars: DataFrame, factors: DataFrame, decision_day) -> DataFrame:
    """OHLC times the product of factors that go ex after the bar and by the decision day."""
    active = factors.filter((F.col("ex_date") <= decision_day) & (F.col("known_date") <= decision_day)).select(
        "instrument", F.col("ex_date").alias("day"), F.log("factor").alias("_ln")
    )
    df = later_total(bars, active, "_ln", "_sum").withColumn("factor", F.exp("_sum"))
    return df.withColumns({c: F.col(c) * F.col("factor") for c in OHLC}).drop("_sum")


def ex_date_reference(bars: DataFrame, actions: DataFrame, axis: Axis = DAILY) -> DataFrame:
    """Reference price of every ex-date from all terms of that day, with its admissible bounds."""
    terms = actions.groupBy("instrument", F.col("ex_date").alias("session_date")).agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "cash", F.col("gross_cash"))), F.lit(0.0)).alias("cash"),
        F.coalesce(F.product(F.when(F.col("kind").isin("bonus", "split", "transfer"), F.col("multiplier"))), F.lit(1.0)).alias("shares"),
        F.coalesce(F.sum(F.when(F.col("kind") == "rights", F.col("multiplier") - 1)), F.lit(0.0)).alias("rights"),
        F.coalesce(F.sum(F.when(F.col("kind") == "rights", (F.col("multiplier") - 1) * F.col("gross_cash"))), F.lit(0.0)).alias("rights_value"),
        F.bool_and(F.col("known_date") <= F.col("ex_date")).alias("known_in_time"),
    )
    b = bars.withColumn("prior_close", axis.lag("close"))
    j = terms.join(b, ["instrument", "session_date"])
    denominator = F.col("shares") + F.col("rights")
    return j.withColumns(
        {
            "reference": (F.col("prior_close") - F.col("cash") + F.col("rights_value")) / denominator,
            "cashless": (F.col("prior_close") + F.col("rights_value")) / denominator,
        }
    )


def sessions_from_bars(bars: DataFrame, listed, st, axis: Axis = DAILY) -> DataFrame:
    """Session reference rows: previous close, status, listing number and daily limits."""
    s = bars.withColumns(
        {
            "previous_close": F.coalesce(axis.lag("close"), F.col("open")),
            "trading_status": F.when(F.col("volume") == 0, "suspended").otherwise("trading"),
            "listing_no": axis.row(),
            "board": R.board(F.col("stock_code")),
            "is_st": st,
        }
    )
    up, down = R.band_ratios(F.col("board"), F.col("rule_date"), listed, F.col("listing_no"), F.col("is_st"))
    hi, lo = R.price_band(F.col("previous_close"), up, down)
    return s.withColumns({"upper_limit": hi, "lower_limit": lo})
