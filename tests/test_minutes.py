"""A range of one symbol must be right, and must not read the rest of the store."""

from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F
from tidemark.session import scratch_path
from tidemark.sources import store as ST


def scanned(df):
    """Rows that the Parquet scans of the executed plan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_range_reads_a_fraction(spark):
    n, start = 20_000, datetime(2024, 1, 1)
    rows = spark.range(n * 6).select(
        F.format_string("%06d.SZ", F.col("id") % 6).alias("ts_code"), (F.floor(F.col("id") / 6)).alias("m"),
    ).withColumn("trade_time", (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("m") * 5).cast("int"))))
    one = {c: F.lit(1.5) for c in ("open", "high", "low", "close")}
    rows = rows.withColumns(one | {"trade_date": F.to_date("trade_time"), "vol": F.when(F.col("m") % 7 == 0, 0.5).otherwise(3.0), "amount": F.lit(10.0)})
    path = scratch_path(spark, "minutes-test")
    spark.conf.set("spark.sql.shuffle.partitions", 64)  # a table this small would be one file a month
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ST.write_minutes(rows, path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    df = ST.read_minutes(spark, path, "000003.SZ", "2024-02-03", "2024-02-04")
    got = {r["trade_time"]: r["rejected"] for r in df.collect()}
    want = {start + timedelta(minutes=5 * m): m % 7 == 0 for m in range(n) if datetime(2024, 2, 3) <= start + timedelta(minutes=5 * m) < datetime(2024, 2, 5)}
    assert got == want
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(ts_code,000003.SZ)" in plan and "PartitionFilters: [isnotnull(month" in plan
    assert scanned(df) < n * 6 / 20
    assert ST.read_minutes(spark, path, "999999.SZ", "2024-02-03", "2024-02-04").count() == 0
    with pytest.raises(ValueError):
        ST.read_minutes(spark, path, "000003.SZ", "2024-02-05", "2024-02-04")
