"""Bar resampling and session completeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def session_bucket(start: Column, period_minutes: int, am_open: int, pm_open: int, noon: int = 720) -> Column:
    """Bucket number inside the half-day, counted from its fixed opening minute."""
    minute = F.hour(start) * 60 + F.minute(start)
    opening = F.when(minute < noon, am_open).otherwise(pm_open)
    return F.floor((minute - opening) / period_minutes)


def resample(bars: DataFrame, keys: Sequence[str], start: str, base_minutes: int, period_minutes: int,
             am_open: int = 570, pm_open: int = 780) -> DataFrame:
    """Merge base bars into longer bars aligned to the half-day opening.

    A bucket is complete when all of its base bars exist; the caller keeps the
    complete ones and counts the others. Buckets never cross the lunch break.
    """
    minute = F.hour(start) * 60 + F.minute(start)
    half = F.when(minute < 720, "am").otherwise("pm")
    g = bars.groupBy(
        *keys, F.to_date(start).alias("day"), half.alias("half"),
        session_bucket(F.col(start), period_minutes, am_open, pm_open).alias("bucket"),
    ).agg(
        F.min(start).alias("bar_start"),
        F.max(start).alias("_last"),
        F.min_by("open", start).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", start).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("amount").alias("amount"),
        F.count(F.lit(1)).alias("base_bars"),
    )
    end = F.col("_last") + F.make_dt_interval(mins=F.lit(base_minutes))
    return g.withColumns(
        {"bar_end": end, "complete": F.col("base_bars") == period_minutes // base_minutes}
    ).drop("_last")


def merge_opening_auction(bars: DataFrame, keys: Sequence[str], start: str, auction: Column, first: Column) -> DataFrame:
    """Fold the opening auction row into the first bar of its session.

    The auction row's key moves to the first bar, then both aggregate: the open
    is the auction's, high and low extend, volume and amount add.
    """
    moved = F.when(auction, first).otherwise(F.col(start))
    df = bars.withColumns({"_rank": F.when(auction, 0).otherwise(1), "_start": moved})
    return df.groupBy(*keys, F.col("_start").alias(start)).agg(
        F.min_by("open", "_rank").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "_rank").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("amount").alias("amount"),
        F.max((F.col("_rank") == 0).cast("int")).alias("has_auction"),
    )


def completeness(bars: DataFrame, keys: Sequence[str], start: str, expected: Sequence[int]) -> DataFrame:
    """Expected, missing and extra base bars per key and day; the grid is a fixed list of minutes."""
    minute = F.hour(start) * 60 + F.minute(start)
    seen = bars.groupBy(*keys, F.to_date(start).alias("day"), minute.alias("minute")).agg(F.lit(1).alias("_"))
    on_grid = F.col("minute").isin(*expected)
    return seen.groupBy(*keys, "day").agg(
        (F.lit(len(expected)) - F.count_if(on_grid)).alias("missing"), F.count_if(~on_grid).alias("extra")
    )
