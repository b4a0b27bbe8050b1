"""Stored rows against what a calendar expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar_gaps(bars: DataFrame, calendar: DataFrame, key: str = "instrument", day: str = "session_date") -> DataFrame:
    """Differences between each key's days and an independent calendar (distinct days).

    ``missing``: a run of ``sessions`` calendar days without a row, between ``after_session`` and ``before_session``; NULL at the
    ends of the calendar. ``unexpected``: a day of the key that the calendar does not have. No key x day grid is formed: days are
    numbered, and two more rows for each key stand for the ends. Numbering puts one row for each calendar day in one task.
    """
    numbered = calendar.select(day).distinct().withColumn("_n", F.row_number().over(Window.orderBy(day)).cast("long"))
    rows = bars.select(key, day).distinct()
    ends = numbered.agg((F.count(F.lit(1)) + 1).alias("_z"))  # one row
    known = rows.join(numbered, day, "left")
    edges = rows.select(key).distinct().join(F.broadcast(ends)).select(key, F.explode(F.array(F.lit(0).cast("long"), F.col("_z"))).alias("_n"))
    placed = known.filter("_n is not null").select(key, day, "_n").unionAll(edges.select(key, F.lit(None).cast("date").alias(day), "_n"))
    w = Window.partitionBy(key).orderBy("_n")
    placed = placed.withColumns({"_next": F.lead("_n").over(w), "before_session": F.lead(day).over(w)})
    missing = placed.filter(F.col("_next") > F.col("_n") + 1).select(
        key, F.lit("missing").alias("kind"), F.col(day).alias("after_session"), "before_session", (F.col("_next") - F.col("_n") - 1).alias("sessions"))
    other = known.filter("_n is null").select(
        key, F.lit("unexpected").alias("kind"), F.col(day).alias("after_session"), F.col(day).alias("before_session"), F.lit(1).cast("long").alias("sessions"))
    return missing.unionAll(other)
