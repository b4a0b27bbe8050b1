from datetime import date
from decimal import Decimal

import pytest

from conftest import column
from pyspark.sql import functions as F
from tidemark.functions import market_rules as R
from tidemark.functions import units
from tidemark.operators.atoms import ATOMS, REVERSE_OF, Atom, register, with_atoms
from tidemark.operators.bars import resample
from tidemark.operators.conditions import All, Indicator, Known, Not, check, with_condition
from tidemark.operators.indicators import BOUNDS, CATALOG
from tidemark.operators.strategies import STRATEGIES, signals
from tidemark.sources import store


def band(spark, board, session, listed, no, st=False, close="10.00"):
    df = spark.createDataFrame([(board, session, listed, no, st, Decimal(close))], "b string, s date, l date, n int, st boolean, c decimal(18,2)")
    up, down = R.band_ratios(*[F.col(c) for c in ("b", "s", "l", "n", "st")])
    hi, lo = R.price_band(F.col("c"), up, down)
    r = df.select(hi.alias("hi"), lo.alias("lo")).first()
    return r["hi"], r["lo"]


@pytest.mark.parametrize("args,want", [
    (("main", date(2022, 1, 4), date(2000, 1, 1), 99), ("11.00", "9.00")),
    (("main", date(2022, 1, 4), date(2000, 1, 1), 99, True), ("10.50", "9.50")),
    (("main", date(2022, 1, 4), date(2022, 1, 4), 1), ("14.40", "6.40")),
    (("main", date(2023, 5, 4), date(2023, 5, 4), 5), (None, None)),
    (("chinext", date(2020, 8, 23), date(2010, 1, 1), 99), ("11.00", "9.00")),
    (("chinext", date(2020, 8, 24), date(2010, 1, 1), 99), ("12.00", "8.00")),
    (("star", date(2022, 1, 4), date(2021, 12, 1), 5), (None, None)),
    (("star", date(2022, 1, 4), date(2021, 12, 1), 6), ("12.00", "8.00")),
    (("bse", date(2022, 1, 4), date(2021, 12, 1), 2), ("13.00", "7.00")),
])
def test_price_bands(spark, args, want):
    assert band(spark, *args) == tuple(None if w is None else Decimal(w) for w in want)


def test_band_rounds_half_up(spark):
    assert band(spark, "main", date(2022, 1, 4), date(2000, 1, 1), 99, False, "10.05") == (Decimal("11.06"), Decimal("9.05"))


@pytest.mark.parametrize("board,most,want", [("main", 99, 0), ("main", 250, 200), ("star", 199, 0), ("star", 201, 201), ("bse", 101, 101)])
def test_buy_lots(spark, board, most, want):
    df = spark.createDataFrame([(board, most)], "b string, m int")
    assert df.select(R.floor_buy_quantity(F.col("b"), F.col("m")).alias("q")).first()["q"] == want


@pytest.mark.parametrize("side,exchange,day,want", [
    ("sell", "SH", date(2023, 8, 27), ("5.00", "10.00", "0.10")),
    ("sell", "SH", date(2023, 8, 28), ("5.00", "5.00", "0.10")),
    ("buy", "SZ", date(2022, 4, 28), ("5.00", "0.00", "0.20")),
    ("buy", "BJ", date(2022, 4, 28), ("5.00", "0.00", None)),
])
def test_fees(spark, side, exchange, day, want):
    df = spark.createDataFrame([(side, exchange, day, Decimal("10000.00"))], "s string, e string, d date, g decimal(18,2)")
    fees = R.fee_components(F.col("s"), F.col("e"), F.col("d"), F.col("g"))
    r = df.select(*[c.alias(n) for n, c in fees.items()]).first()
    assert tuple(r) == tuple(None if w is None else Decimal(w) for w in want)


def test_units(spark):
    df = spark.createDataFrame([(1.0, "亿元", "万元"), (2.0, "手", "股"), (3.0, "元", "股"), (4.0, "点", "点")], "v double, a string, b string")
    got = [r["o"] for r in df.select(units.convert(F.col("v"), F.col("a"), F.col("b")).alias("o")).collect()]
    assert got == [10000.0, 200.0, None, 4.0]


def test_registries():
    assert len(CATALOG) == 37 and len(ATOMS) >= 85 and len(STRATEGIES) == 13 and len(REVERSE_OF) == 26
    assert all(b in ATOMS and s in ATOMS for b, s in REVERSE_OF.items())
    with pytest.raises(ValueError):
        register(ATOMS["doji"])
    with pytest.raises(ValueError):
        register(Atom("x", "nonsense", ("ohlcv",), 0, "candles"))


@pytest.mark.parametrize("leaf", [
    Indicator("technical.nope", "above"), Indicator("technical.ma", "nope"), Indicator("technical.ma", "price_above", 1.0),
    Indicator("technical.rsi", "above"), Indicator("technical.ma", "price_above", params={"period": 0}),
    Indicator("technical.ma", "price_above", params={"span": 3}), Indicator("technical.ma", "price_above", params={"period": 2.5}),
    Indicator("technical.ma_cross", "golden_cross", params={"fast_period": 30}), Indicator("technical.rsi", "above", 101.0),
    Indicator("technical.ma", "price_above", params={"period": 1001}), Indicator("price.close", "above", 0),
    Indicator("technical.ma", "price_above", params={"price_field": "vwap"}), Indicator("technical.bbi", "price_above", params={"period_1": 6}),
])
def test_bad_conditions_are_rejected(leaf):
    with pytest.raises(ValueError):
        check(leaf)


def test_every_numeric_parameter_has_a_range_and_its_default_fits():
    for id, s in CATALOG.items():
        for name, v in s.defaults.items():
            if name != "price_field":
                low, high = BOUNDS[id][name]
                assert low <= v <= high


def test_price_field_reaches_line_and_trigger(make_bars):
    bars = make_bars({1: [(1, 9, 1, 5, 10), (2, 9, 1, 5, 10), (9, 9, 1, 5, 10)]})
    out = with_condition(bars, Indicator("technical.ma", "price_above", params={"period": 2, "price_field": "open"}), "s")
    assert column(out, "s") == [None, True, True]


def test_unknown_stays_unknown(make_bars):
    bars = make_bars({1: [1, 2, 3, 1]}).withColumn("fact", F.lit(None).cast("boolean"))
    up = Indicator("technical.ma", "price_above", params={"period": 2})
    out = with_condition(bars, All((up, Known("fact"))), "s")
    assert column(out, "s") == [None, None, None, False]
    assert column(with_condition(bars, Not(up), "s"), "s") == [None, False, False, True]


def test_atoms_treat_missing_as_zero_and_mask_warmup(make_bars):
    bars = make_bars({1: [(1, 1, 1, c, 10) for c in (1, 2, 3, 4, 5)]}).withColumn("stock_code", F.lit("600000"))
    out = with_atoms(bars, ["consecutive_up_2", "single_day_up_7", "turnover_above_5"])
    assert column(out, "consecutive_up_2") == [0, 0, 0, 1, 1]
    assert column(out, "single_day_up_7") == [0, 0, 1, 1, 1]
    assert column(out, "turnover_above_5") == [0] * 5


def test_strategy_priority_and_parameters(make_bars):
    bars = make_bars({1: [10.0] * 5})
    assert column(signals(bars, "always_hold"), "signal") == [1] * 5
    with pytest.raises(ValueError):
        signals(bars, "rsi", nope=1)


def minute_session(skip=()):
    rows = []
    for i, m in enumerate([570 + k for k in range(120)] + [780 + k for k in range(120)]):
        if i not in skip:
            p = 10 + i / 1000
            rows.append(("a", f"2025-01-02 {m // 60:02d}:{m % 60:02d}:00", p, p + 0.02, p - 0.02, p + 0.01, 100 + i, (100 + i) * (p + 0.01)))
    return rows


@pytest.mark.parametrize("skip,kept", [((), 48), ((7,), 47), ((7, 130), 46)])
def test_five_minute_bars(spark, skip, kept):
    df = spark.createDataFrame(minute_session(skip), "k string, t string, open double, high double, low double, close double, volume int, amount double")
    df = df.withColumn("s", F.col("t").cast("timestamp_ntz"))
    out = resample(df, ["k"], "s", 1, 5).filter("complete").orderBy("bar_start").collect()
    assert len(out) == kept
    assert str(out[0]["bar_end"]) == "2025-01-02 09:35:00" and out[0]["open"] == 10.0 and out[0]["volume"] == 510


def test_fund_flow_problems(spark):
    good = "2024-01-02,30,1,2,20,10,1,2,3,4,5,9.5,0.1"
    lines = [good, "2024-01-02,1", good.replace("2024-01-02", "x"), good.replace(",9.5", ",-1"), good.replace(",30,", ",99,"), good.replace(",2,20", ",y,20")]
    got = [r["problem"] for r in store.parse_fund_flow(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [None, "field_count", "date", "close", "identity", "number"]


def test_partial_column_groups_are_rejected():
    assert store.all_or_none(["a", "b"], ["a", "b"]) and not store.all_or_none(["c"], ["a", "b"])
    with pytest.raises(ValueError):
        store.all_or_none(["a"], ["a", "b"])


def test_fingerprint_ignores_row_order(spark):
    a = spark.createDataFrame([(i, i * 2) for i in range(50)], "x int, y int")
    parts = [F.col("x"), F.col("y")]
    one, two = (store.fingerprint(d, parts).first() for d in (a, a.orderBy(F.desc("x")).repartition(7)))
    assert one == two != store.fingerprint(a.withColumn("y", F.col("y") + 1), parts).first()


def test_fingerprint_tells_pairs_and_nulls_apart(spark):
    parts = [F.col("x"), F.col("y")]

    def of(*rows):
        return tuple(store.fingerprint(spark.createDataFrame(list(rows), "x string, y string"), parts).first())

    assert of(("A", "1"), ("A", "1")) != of(("B", "1"), ("B", "1"))
    assert of(("x", None)) != of((None, "x")) != of(("N", "x"))
    assert of(("a|b", "c")) != of(("a", "b|c")) and of(("a", ""), ("", "a")) == of(("", "a"), ("a", ""))


def test_manifest_lies_beside_the_data(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "x int, y string")
    store.write(df, path, "x int, y string")
    made = store.write_manifest(spark, path, "x int, y string", [F.col("x"), F.col("y")], {"k": F.col("x")}).collect()
    assert sorted((r["k"], r["rows"]) for r in made) == [(1, 1), (2, 2)]
    assert spark.read.parquet(path).count() == 3
    assert sorted(store.read_manifest(spark, path, {"k": "int"}).collect()) == sorted(made)


def test_tick_order_is_total_beyond_small_keys(spark):
    from tidemark.sources.market import tick_order

    rows = [(1, 1, 5), (1, 1, 1048576), (7, 9, 0), (8, 1, 0), (8, 1, 2**62), (9 * 10**14, 9999, 1)]
    df = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_partkey bigint").repartition(3)
    assert [tuple(r) for r in df.orderBy(tick_order()).collect()] == rows
    with pytest.raises(Exception, match="tick order out of range"):
        spark.createDataFrame([(1, 10_000, 1)], df.schema).select(tick_order()).collect()


def test_calendar_gaps_include_the_ends(spark):
    from datetime import date

    from tidemark.operators.coverage import calendar_gaps

    d = lambda n: date(2024, 1, n)
    cal = spark.createDataFrame([(d(n),) for n in (2, 3, 4, 5, 8, 9)], "session_date date")
    bars = spark.createDataFrame([(1, d(3)), (1, d(3)), (1, d(8)), (1, d(20)), (2, d(1))], "instrument int, session_date date")
    got = sorted(map(tuple, calendar_gaps(bars, cal).collect()), key=repr)
    assert got == sorted([(1, "missing", None, d(3), 1), (1, "missing", d(3), d(8), 2), (1, "missing", d(8), None, 1), (1, "unexpected", d(20), d(20), 1),
                          (2, "missing", None, None, 6), (2, "unexpected", d(1), d(1), 1)], key=repr)


def test_bar_scan_selects_and_refuses_duplicates(spark, tmp_path):
    from datetime import date

    d = lambda n: date(2024, 1, n)
    row = lambda i, n, basis: (i, d(n), 1.0, 2.0, 0.5, 1.5, 10.0, 15.0, basis)
    rows = [row(1, 2, "unadjusted"), row(1, 3, "unadjusted"), row(2, 2, "unadjusted"), row(1, 2, "back_adjusted"), row(3, 2, "unadjusted"), row(3, 2, "unadjusted")]
    path = str(tmp_path / "bars")
    store.write(spark.createDataFrame(rows, store.DAILY), path, store.DAILY, ("price_basis",), ("instrument",))
    cols = ("instrument", "session_date", "close")
    got = store.scan_bars(spark, path, cols, "unadjusted", "2024-01-02", "2024-01-03", [1, 2]).collect()
    assert sorted(map(tuple, got)) == [(1, d(2), 1.5), (2, d(2), 1.5)]
    with pytest.raises(Exception, match="duplicate key: 3/2024-01-02"):
        store.scan_bars(spark, path, cols, "unadjusted", "2024-01-01", "2024-02-01").collect()
