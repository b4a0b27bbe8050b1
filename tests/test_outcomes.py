import numpy as np
import pytest

from pyspark.sql import functions as F
from tidemark.functions.windows import DAILY
from tidemark.operators import metrics as M
from tidemark.operators import outcomes as O


@pytest.mark.parametrize("falls, width", [(True, 32), (False, 32), (True, 3), (False, 4)])
def test_first_passage_equals_scan(make_bars, monkeypatch, falls, width):
    monkeypatch.setattr(O, "WIDTH", width)  # a low width makes a hierarchy of several levels
    rng = np.random.default_rng(3)
    series = {i: list(rng.uniform(50, 150, n)) for i, n in ((1, 10), (2, 64), (3, 200))}
    b = make_bars(series).withColumn("rn", DAILY.row()).select("instrument", "rn", "close")
    factor = 0.62 if falls else 1.8
    got = O.first_passage(b, b.withColumn("thr", F.col("close") * factor), "thr", falls, "at").collect()
    for r in got:
        xs = series[r["instrument"]]
        later = [j + 1 for j in range(r["rn"], len(xs)) if (xs[j] <= r["thr"] if falls else xs[j] >= r["thr"])]
        assert r["at"] == (later[0] if later else None)


def brute(xs, buy, rules):
    n, out = len(xs), []
    for rule in rules:
        hit = None
        for j in range(buy + 1, n):
            if isinstance(rule, O.Hold) and j == buy + rule.sessions:
                hit = j
            elif isinstance(rule, O.StopLoss) and xs[j] <= xs[buy] * (1 - rule.pct / 100):
                hit = j
            elif isinstance(rule, O.TakeProfit) and xs[j] >= xs[buy] * (1 + rule.pct / 100):
                hit = j
            elif isinstance(rule, O.TrailingStop) and xs[j] <= max(xs[buy + 1: j + 1]) * (1 - rule.pct / 100):
                hit = j
            if hit is not None:
                break
        out.append(n - 1 if hit is None else hit)
    return min(out)


def test_outcomes_equal_scan_and_last_trigger_is_skipped(make_bars):
    rng = np.random.default_rng(5)
    xs = list(rng.uniform(50, 150, 150))
    flags = {i for i in range(0, 150, 7)} | {149}
    bars = make_bars({1: xs}).withColumn("rn", DAILY.row())
    bars = bars.withColumn("go", (F.col("rn") - 1).isin(*flags).cast("int")).drop("rn")
    rules = [O.StopLoss(20.0), O.TrailingStop(40.0), O.TakeProfit(60.0), O.Hold(25)]
    got = {r["rn"] - 1: r for r in O.outcomes(bars, "go", rules).collect()}
    assert set(got) == flags - {149}
    for i, r in got.items():
        assert r["exit_rn"] - 1 == brute(xs, i, rules)
        assert r["return_pct"] == pytest.approx((xs[r["exit_rn"] - 1] / xs[i + 1] - 1) * 100)


def test_only_thresholds_that_later_closes_reach_are_asked(make_bars, monkeypatch):
    asked = []
    real = O.first_passage
    monkeypatch.setattr(O, "first_passage", lambda bars, starts, *rest: (asked.append(starts.count()), real(bars, starts, *rest))[1])
    bars = make_bars({1: [10, 12, 11, 13, 9, 14, 15], 2: [10, 4, 10, 16, 5, 5, 5]}).withColumn("go", F.lit(1))
    rules = [O.StopLoss(50.0), O.TakeProfit(50.0), O.TrailingStop(60.0)]
    got = {(r["instrument"], r["rn"]): r["exit_rn"] for r in O.outcomes(bars, "go", rules).collect()}
    for i, xs in ((1, [10, 12, 11, 13, 9, 14, 15]), (2, [10, 4, 10, 16, 5, 5, 5])):
        assert [got[i, k + 1] - 1 for k in range(6)] == [brute(xs, k, rules) for k in range(6)]
    # stops: 10, 10 and 16 of the second; profits: 10 and 9 of the first, 10, 4 and 10 of the second; trailing: the 16 that comes down to 5
    assert asked == [9]


def test_forced_close_keeps_its_reason(make_bars):
    bars = make_bars({1: [10, 11, 12, 13]}).withColumn("go", (F.col("close") == 10).cast("int"))
    r = O.outcomes(bars, "go", [O.StopLoss(50.0)]).first()
    assert (r["exit_rn"], r["exit_reason"]) == (4, "force_close_end_stop_loss_not_hit")


def test_non_overlapping_keeps_first_and_skips_until_exit(spark):
    t = spark.createDataFrame([(1, 1, 5), (1, 3, 9), (1, 5, 6), (1, 6, 8), (2, 2, 3)], "instrument int, rn int, exit_rn int")
    got = {(r["instrument"], r["rn"]) for r in O.non_overlapping(t).collect()}
    assert got == {(1, 1), (1, 6), (2, 2)}


def test_unknown_does_not_rearm_an_episode(spark):
    states = [None, True, None, True, False, None, True, True]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(states)], "instrument int, session_date int, s boolean")
    out = O.entry_occurrences(df, "s", DAILY).orderBy("session_date").collect()
    assert [r["occurrence"] for r in out] == [None, True, None, None, False, None, True, None]


def test_metrics_of_a_known_curve(make_bars):
    c = make_bars({1: [100, 110, 99, 120]}).select("instrument", "session_date", F.col("close").alias("equity"), F.col("close").alias("benchmark"))
    r = M.classic_metrics(M.curve_summary(c, benchmark="benchmark")).first()
    assert r["total_return"] == pytest.approx(0.2)
    assert r["max_drawdown"] == pytest.approx(-0.1)
    assert r["benchmark_return"] == pytest.approx(0.2)


def test_scenarios_with_equal_settings_run_once():
    assert [s[0] for s in M.scenarios(0.0, 0.05)] == ["base", "participation_2_5pct", "participation_10pct"]
    assert len(M.scenarios(10.0, 0.05)) == 5


@pytest.mark.parametrize("seed", [1, 2])
def test_non_overlapping_equals_sequential_choice(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for key, n in (("a", 1), ("b", 40), ("c", 700), (None, 3)):
        for i in range(n):
            start = int(rng.integers(0, 3 * n))
            rows.append((key, start, start + int(rng.integers(0, 4)), len(rows)))
    df = spark.createDataFrame(rows, "instrument string, rn int, exit_rn int, id int").repartition(3)
    want, last = [], {}
    for key, start, end, _ in sorted((r for r in rows if r[0]), key=lambda r: r[:3]):
        if start > last.get(key, -1):
            want.append((key, start, end))
            last[key] = end
    got = sorted((r["instrument"], r["rn"], r["exit_rn"]) for r in O.non_overlapping(df).collect() if r["instrument"])
    assert got == want and len([w for w in want if w[0] == "c"]) > 128


def test_records_are_enough_for_trailing_stops(make_bars):
    rng = np.random.default_rng(8)
    series = {i: list(rng.uniform(80, 120, 150)) for i in range(3)}
    b = make_bars(series).withColumn("rn", DAILY.row()).withColumn("go", F.col("rn") % 17 == 3)
    marked = O.with_records(b, F.col("go"), DAILY).select("instrument", "rn", "_record").collect()
    assert 0 < sum(r["_record"] for r in marked) < len(marked) / 2
    for r in marked:
        xs, j = series[r["instrument"]], r["rn"]
        entry = max((k for k in range(3, j, 17)), default=None)
        assert r["_record"] == (entry is not None and all(xs[k - 1] < xs[j - 1] for k in range(entry + 1, j)))


def test_no_join_on_trades_is_broadcast(spark, make_bars):
    b = make_bars({1: [100, 90, 120, 80, 110, 60], 2: [50, 60, 40, 70]}).withColumn("buy", F.lit(1))
    out = O.non_overlapping(O.outcomes(b, "buy", [O.StopLoss(10.0), O.TakeProfit(20.0), O.Hold(2)]))
    log = out.select("instrument", "session_date", F.col("buy_price").alias("cash_flow"), F.lit(1).alias("share_change"))
    plan = M.mark_to_market(log, b, 0.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
