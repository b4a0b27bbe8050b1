from datetime import date, timedelta

import numpy as np
import pytest

from pyspark.sql import functions as F
from tidemark.operators import asof
from tidemark.operators import ledger
from tidemark.operators.ledger import fifo, linked_returns, running

D0 = date(2024, 1, 1)


def day(n):
    return D0 + timedelta(days=int(n))


@pytest.mark.parametrize("strict", [False, True])
def test_latest_known_equals_scan(spark, strict):
    rng = np.random.default_rng(11)
    bars = [(i, day(d)) for i in (1, 2) for d in range(0, 60, 2)]
    facts = [(int(i), day(p), day(t), int(r), float(v)) for r, (i, p, t, v) in enumerate(
        zip(rng.integers(1, 3, 40), rng.integers(-90, 60, 40), rng.integers(0, 60, 40), rng.uniform(0, 9, 40)))]
    b = spark.createDataFrame(bars, "instrument int, session_date date")
    f = spark.createDataFrame(facts, "instrument int, period date, known date, rev int, value double")
    got = asof.latest_known(b, f, ["instrument"], "session_date", "known", ["period", "known", "rev"], ["value"], strict=strict)
    for r in got.collect():
        ok = [x for x in facts if x[0] == r["instrument"] and (x[2] < r["session_date"] if strict else x[2] <= r["session_date"])]
        assert r["fact_value"] == (max(ok, key=lambda x: (x[1], x[2], x[3]))[4] if ok else None)


def test_late_report_of_an_old_period_never_rolls_back(spark):
    b = spark.createDataFrame([(1, day(d)) for d in (0, 10, 20)], "instrument int, session_date date")
    f = spark.createDataFrame([(1, day(-10), day(-5), 1.0), (1, day(-100), day(15), 2.0)], "instrument int, period date, known date, value double")
    got = asof.latest_known(b, f, ["instrument"], "session_date", "known", ["period", "known"], ["value"]).orderBy("session_date").collect()
    assert [r["fact_value"] for r in got] == [1.0, 1.0, 1.0]


def test_next_session_on_and_after(spark):
    s = spark.createDataFrame([(1, day(2)), (1, day(5))], "instrument int, session_date date")
    r = spark.createDataFrame([(1, day(d)) for d in (1, 2, 5, 6)], "instrument int, d date")
    got = {x["d"]: (x["a"], x["b"]) for x in asof.next_own_session(r, s, ["instrument"], "d", "a", after="b").collect()}
    assert got == {day(1): (day(2), day(2)), day(2): (day(2), day(5)), day(5): (day(5), None), day(6): (None, None)}


def test_earliest_tradable_times(spark):
    s = spark.createDataFrame([(1, day(0)), (1, day(3))], "instrument int, session_date date")
    times = ["2024-01-01 08:00:00", "2024-01-01 10:00:00", "2024-01-01 12:00:00", "2024-01-01 14:00:00", "2024-01-01 15:00:00", "2024-01-02 10:00:00"]
    r = spark.createDataFrame([(1, t) for t in times], "instrument int, t string").withColumn("at", F.col("t").cast("timestamp_ntz"))
    got = {x["t"]: str(x["go"]) for x in asof.earliest_tradable(r, s, ["instrument"], "at", "go").collect()}
    assert [got[t] for t in times] == ["2024-01-01 09:30:00", "2024-01-01 10:00:00", "2024-01-01 13:00:00", "2024-01-01 14:00:00",
                                       "2024-01-04 09:30:00", "2024-01-04 09:30:00"]


def sequential_fifo(rows):
    lots, broken, out = {}, set(), {}
    sides, vague = {}, set()
    for k, d, seq, side, q, p, fee, prec in rows:
        sides.setdefault((k, d), set()).add(side)
        if prec == "date_only":
            vague.add((k, d))
    for k, d, seq, side, q, p, fee, prec in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        mine = lots.setdefault(k, [])
        if len(sides[(k, d)]) > 1 and (k, d) in vague:
            broken.add(k)
            mine.clear()
        if side == "buy":
            if k not in broken:
                mine.append([q, (q * p + fee) / q])
            continue
        if k in broken or sum(x[0] for x in mine) < q:
            broken.add(k)
            mine.clear()
            out[(k, seq)] = None
            continue
        left, cost = q, 0.0
        while left > 0:
            take = min(left, mine[0][0])
            cost += take * mine[0][1]
            mine[0][0] -= take
            left -= take
            if mine[0][0] == 0:
                mine.pop(0)
        out[(k, seq)] = q * p - fee - cost
    return out


@pytest.mark.parametrize("small", [0, 25, 10**6])
def test_fifo_of_small_and_large_keys(spark, monkeypatch, small):
    monkeypatch.setattr(ledger, "SMALL", small)
    rng = np.random.default_rng(31)
    rows, seq = [], 0
    for key, n in ((1, 60), (2, 20), (None, 40), (3, 5)):
        for d in np.sort(rng.integers(0, 12, n)):
            seq += 1
            side = "sell" if rng.random() < 0.3 else "buy"
            rows.append((key, day(d), seq, side, float(rng.integers(1, 30)), float(rng.integers(1, 900)) / 100, 0.25, "exact"))
    df = spark.createDataFrame(rows, "account int, trade_date date, seq int, side string, quantity double, price double, fees double, precision string")
    out = fifo(df.withColumn("symbol", F.lit(0)))
    got = {r["seq"]: r["fifo_pnl"] for r in out.filter("side = 'sell' and account is not null").collect()}
    want = {seq: v for (_, seq), v in sequential_fifo([r for r in rows if r[0] is not None]).items()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == (None if v is None else pytest.approx(v, abs=1e-6))
    assert out.filter("account is null and side = 'sell'").count() == sum(r[0] is None and r[3] == "sell" for r in rows)


def test_fifo_of_small_keys_moves_trades_once(spark):
    df = spark.createDataFrame([(1, 0, day(0), 1, "buy", 5.0, 1.0, 0.0, "exact")], "account int, symbol int, trade_date date, seq int, side string, quantity double, price double, fees double, precision string")
    assert fifo(df)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("seed, slots", [(1, 64), (2, 1), (3, 0.1)])
def test_fifo_equals_sequential_lots(spark, monkeypatch, seed, slots):
    monkeypatch.setattr(ledger, "SLOTS", slots)  # few trades a bucket: lots reach over many buckets
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(6):
        for i in range(120):
            sell = rng.random() < 0.3 + 0.04 * k
            rows.append((k, day(i // 4), i, "sell" if sell and i > 8 else "buy", float(rng.integers(1, 20)), float(rng.integers(10, 99)),
                         float(rng.integers(0, 5)), "date_only" if rng.random() < 0.01 * k else "exact"))
    df = spark.createDataFrame(rows, "account int, trade_date date, seq int, side string, quantity double, price double, fees double, precision string")
    got = {(r["account"], r["seq"]): r["fifo_pnl"] for r in fifo(df.withColumn("symbol", F.lit(0))).collect()}
    want = sequential_fifo(rows)
    assert set(got) == set(want)
    for key, v in want.items():
        assert (got[key] is None) == (v is None) and (v is None or got[key] == pytest.approx(v, abs=1e-6))
    assert any(v is None for v in want.values()) and any(v is not None for v in want.values())


def test_running_totals_carry_across_days(spark):
    rows = [(1, day(i // 3), i, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "account int, d date, seq int, x double")
    got = running(df, ["account"], "d", "seq", {"total": F.col("x")}).orderBy("seq").collect()
    assert [r["total"] for r in got] == [float(i) for i in range(1, 11)]


def test_time_weighted_return_ignores_flows(spark):
    e = spark.createDataFrame([(1, day(0), 100.0), (1, day(2), 220.0), (1, day(4), 242.0)], "account int, day date, equity double")
    f = spark.createDataFrame([(1, day(1), 100.0, 0.0)], "account int, day date, inflow double, outflow double")
    got = linked_returns(e, f).orderBy("day").collect()
    assert [None if r["period_return"] is None else round(r["period_return"], 6) for r in got] == [None, 0.1, 0.1]
    assert got[-1]["linked_index"] == pytest.approx(1.21)


def linked(spark, points, flows=(), own=False):
    from datetime import date

    from tidemark.operators.ledger import linked_returns

    schema = "account int, day date, equity double" + (", own_in double, own_out double" if own else "")
    e = spark.createDataFrame([(1, date(2024, 1, p[0]), *p[1:]) for p in points], schema)
    f = spark.createDataFrame([(1, date(2024, 1, d), i, o) for d, i, o in flows], "account int, day date, inflow double, outflow double")
    return [(r["period_return"], r["linked_index"], r["problem"]) for r in linked_returns(e, f).orderBy("day").collect()]


def test_linked_returns_stop_at_a_bad_interval(spark):
    out = linked(spark, [(1, 100.0), (2, 110.0), (3, -5.0), (4, 10.0), (5, 20.0)])
    assert out[1][0] == pytest.approx(0.1) and out[1][2] is None
    assert out[2:] == [(None, None, "equity_not_positive")] * 3
    assert linked(spark, [(1, 0.0), (2, 10.0)])[1] == (None, None, "equity_not_positive")


def test_stated_flows_replace_or_contradict_derived_ones(spark):
    points = [(1, 100.0, None, None), (2, 160.0, 50.0, None), (3, 170.0, None, None)]
    assert linked(spark, points, own=True)[1][0] == pytest.approx(160 / 150 - 1)
    assert linked(spark, points, [(2, 50.0, 0.0)], own=True)[1][2] is None
    assert [r[2] for r in linked(spark, points, [(2, 40.0, 0.0)], own=True)] == [None, "flow_conflict", "flow_conflict"]


def test_forward_fill_runs_in_the_partitions_asked_for(spark):
    from tidemark.operators.asof import forward_fill

    left = spark.range(600).selectExpr("id % 60 as k", "id as day")
    right = left.filter("day < 60").selectExpr("k", "day", "cast(k as double) as v")
    out = forward_fill(left, right, ["k"], "day", ["v"], 20).selectExpr("*", "spark_partition_id() as task").toPandas()
    assert out["task"].nunique() > 8 and len(out) == 600 and (out["v"] == out["k"]).all()
