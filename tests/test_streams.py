import tempfile
from datetime import datetime, timedelta

import pandas as pd
import pytest

from pyspark.sql import functions as F
from tidemark.streaming import streams as S

SCHEMA = "event_id bigint, user_id bigint, event_type string, value double, t string"


def folder_of(spark, batches, schema=SCHEMA):
    """A folder with one file for each batch."""
    src = tempfile.mkdtemp(prefix="spark-")
    for rows in batches:
        spark.createDataFrame(rows, schema).withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t").coalesce(1).write.mode("append").parquet(src)
    return src


def stream_of(spark, batches):
    src = folder_of(spark, batches)
    rows = spark.readStream.schema("event_id bigint, user_id bigint, event_type string, value double, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(src)
    return rows.withColumn("at", S.as_instant(F.col("ts")))


def cut(rows, n):
    size = -(-len(rows) // n)
    return [rows[i:i + size] for i in range(0, len(rows), size)]


def events(n):
    start = datetime(2024, 1, 1)
    return [(i, i * 7 % 5 if i % 11 else None, "ab"[i % 2], float(i * 13 % 17), str(start + timedelta(minutes=37 * i))) for i in range(n)]


def test_state_carries_across_batches(spark):
    x = [5.0, 7.0, 6.0, 6.0, 9.0, 4.0]
    rows = [(1, f"2024-01-01 0{i}:00:00", c, 10 + i) for i, c in enumerate(x)]
    src = tempfile.mkdtemp(prefix="spark-")
    for part in (rows[:2], rows[2:5], rows[5:]):
        df = spark.createDataFrame(part, "instrument bigint, t string, close double, volume bigint")
        df.withColumn("bar_start", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.mode("append").parquet(src)
    bars = spark.readStream.schema("instrument bigint, close double, volume bigint, bar_start timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    out = S.run_to_table(S.incremental_indicators(bars, 3), "state-test").orderBy("bar_start").collect()
    assert [r["ema"] for r in out] == pytest.approx(list(pd.Series(x).ewm(span=3, adjust=False).mean()))
    assert [r["obv"] for r in out] == [10, 21, 9, 9, 23, 8]


@pytest.mark.parametrize("batches", [1, 3, 10])
def test_gate_routes_every_row(spark, batches):
    rows = events(120)
    got = {r["event_id"]: (r["user_id"], str(r["day"]), r["late"], r["open"]) for r in S.gate_late(stream_of(spark, cut(rows, batches)), "3 hours").collect()}
    first = {}
    for _, user, _, _, t in rows:
        first[user, t[:10]] = min(first.get((user, t[:10]), t), t)
    last = datetime.fromisoformat(rows[-1][4]) - timedelta(hours=3)
    want = {i: (u, t[:10], t > first[u, t[:10]], datetime.fromisoformat(t[:10]) + timedelta(days=1) > last) for i, u, _, _, t in rows}
    assert got == want and any(v[3] for v in want.values())


def test_gate_keeps_rows_behind_the_watermark(spark):
    rows = [(1, 7, "2024-01-01 09:00:00"), (2, 7, "2024-01-01 10:00:00"), (3, 8, "2024-01-01 10:00:00"), (4, 7, "2024-01-01 08:59:00"), (5, 7, "2024-01-03 09:00:00"),
            (6, 9, "2024-01-04 09:00:00"), (7, 7, "2024-01-01 07:00:00"), (8, 11, "2024-01-01 11:00:00"), (9, 9, "2024-01-04 09:30:00")]
    out = S.gate_late(stream_of(spark, [[(i, u, "a", 1.0, t)] for i, u, t in rows]), "3 hours").collect()
    # 4 came while its day was open and is its first; 7 and 8 came after their day had been told, 8 as the only row of its group
    assert sorted((r["event_id"], r["late"], r["open"]) for r in out) == [
        (1, True, False), (2, True, False), (3, False, False), (4, False, False), (5, False, False), (6, False, True), (7, True, False), (8, True, False), (9, True, True)]


@pytest.mark.parametrize("batches", [1, 3, 10])
def test_copies_of_a_revision_count_once(spark, batches):
    rows = events(60) + [(100 + i, u, e, v, "2024-03-01 00:00:00") for i, u, e, v, _ in events(20)]
    got = S.distinct_revisions(stream_of(spark, cut(rows, batches)), ["event_type", "user_id"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted({(e, u) for _, u, e, _, _ in rows}, key=repr)


def test_repeated_batch_stores_nothing_twice(spark):
    seen = S.SeenKeys(spark, [("k", "bigint")])
    first, second = (spark.createDataFrame([(k,) for k in ks], "k bigint") for ks in ([1, 2, 2, None], [2, 3, None, 4, 4]))
    for batch, number in ((first, 0), (second, 1), (second, 1), (first, 0), (second, 1)):
        seen.absorb(batch, number)
    assert sorted((r["k"] for r in seen.table(spark).collect()), key=repr) == [1, 2, 3, 4, None]


@pytest.mark.parametrize("batches", [1, 4])
def test_last_windows_come_out(spark, batches):
    rows = events(90)
    stream, close = S.closable(stream_of(spark, cut(rows, batches)))
    got = S.run_to_table(S.tumbling_bars(stream, "event_type", 1, "2 hours"), "bars-test", close).collect()
    want = {}
    for _, _, kind, _, t in rows:
        want[kind, t[:13]] = want.get((kind, t[:13]), 0) + 1
    assert {(r["event_type"], str(r["bar_start"])[:13]): r["volume"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("buckets", [1, 5])
def test_gate_groups_are_buckets_of_subjects(spark, monkeypatch, buckets):
    progress, drain = [], S.drain
    monkeypatch.setattr(S, "drain", lambda out, label: (done := drain(out, label), progress.append(done[1]))[0])
    rows = [(i, i % 40, "a", 1.0, f"2024-01-01 {i % 24:02}:00:00") for i in range(120)]
    got = S.gate_late(stream_of(spark, cut(rows, 3)), "30 hours", buckets).collect()
    first = {u: min(t for _, v, _, _, t in rows if v == u) for _, u, _, _, _ in rows}
    assert {r["event_id"]: (r["late"], r["open"]) for r in got} == {i: (t > first[u], True) for i, u, _, _, t in rows} and len(got) == 120
    state = spark.read.format("statestore").option("stateVarName", "rows").load(progress[0])
    assert state.select("key").distinct().count() <= buckets
