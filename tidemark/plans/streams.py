"""Published streaming queries, each drained once over the stored events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.plans.text import KEYK
from tidemark.streaming import streams as S


@query("r01_stream_bars", """WITH b AS (SELECT event_type, date_trunc('day', ts) + to_hours(CAST(hour(ts) // 4 * 4 AS INT)) AS bar_start, event_id, value, hour(ts) AS h, ts FROM events),
g AS (SELECT event_type, bar_start, bar_start + INTERVAL 4 HOUR AS bar_end, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, event_id) AS close, count(*) AS volume, count(DISTINCT h) AS n FROM b GROUP BY 1, 2)
SELECT event_type, bar_start, bar_end, open, high, low, close, volume FROM g WHERE n = 4""")
def r01(spark, folder):
    events, close = S.closable(S.event_stream(spark, folder))
    return S.run_to_table(S.tumbling_bars(events, "event_type", 4, "2 hours"), "stream-bars", close)


@query("r02_stream_dedup", f"SELECT DISTINCT event_type, user_id, {KEYK} AS k FROM events")
def r02(spark, folder):
    """Copies of a revision count once, however far apart they are delivered."""
    e = S.event_stream(spark, folder).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return S.distinct_revisions(e, ["event_type", "user_id", "k"])


@query("r03_availability_gate", """SELECT event_id, user_id, CAST(ts AS DATE) AS day, ts > min(ts) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS late,
 CAST(ts AS DATE) + INTERVAL 1 DAY > (SELECT max(ts) FROM events) - INTERVAL 2 HOUR AS open FROM events""")
def r03(spark, folder):
    return S.gate_late(S.event_stream(spark, folder), "2 hours")


@query("r04_stream_state", """WITH RECURSIVE h AS (SELECT user_id AS instrument, date_trunc('hour', ts) AS bar_start, arg_max(value, event_id) AS close, count(*) AS volume FROM events GROUP BY 1, 2),
e AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY bar_start) AS rn FROM h),
r AS (SELECT instrument, bar_start, rn, close AS x, close AS ema, CAST(volume AS DOUBLE) AS obv FROM e WHERE rn = 1 UNION ALL
 SELECT e.instrument, e.bar_start, e.rn, e.close, r.ema + 2.0 / 11 * (e.close - r.ema), r.obv + e.volume * sign(e.close - r.x) FROM r JOIN e ON e.instrument = r.instrument AND e.rn = r.rn + 1)
SELECT instrument, bar_start, round(ema, 6) AS ema, obv FROM r""")
def r04(spark, folder):
    """Two chained streams: hourly bars first, indicator state over the bars second."""
    events, close = S.closable(S.event_stream(spark, folder))
    hourly = S.tumbling_bars(events, "user_id", 1, "2 hours")
    path, _ = S.drain(hourly, "hourly-bars", close)
    bars = spark.readStream.schema(hourly.schema).parquet(path).select(
        F.col("user_id").alias("instrument"), S.as_instant(F.col("bar_start")).alias("bar_start"), "close", "volume")
    out = S.run_to_table(S.incremental_indicators(bars, 10), "stream-state")
    return out.select("instrument", S.as_wall(F.col("bar_start")).alias("bar_start"), F.round("ema", 6).alias("ema"), "obv")
