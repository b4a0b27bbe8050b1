"""Curve and trade statistics per instrument (or run, strategy, account)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import DAILY, Axis

YEAR = 252


def with_path(curve: DataFrame, axis: Axis = DAILY, value: str = "equity") -> DataFrame:
    """Add the running peak drawdown and the simple return of each point."""
    return curve.withColumns(
        {
            "drawdown": F.col(value) / F.max(value).over(axis.so_far()) - 1,
            "ret": F.col(value) / axis.lag(value) - 1,
        }
    )


def curve_summary(curve: DataFrame, axis: Axis = DAILY, value: str = "equity", benchmark: str | None = None) -> DataFrame:
    """First/last values, return moments, drawdown and span per key in one aggregation."""
    t = axis.order[0]
    extra = [] if benchmark is None else [
        F.min_by(benchmark, t).alias("b_first"),
        F.max_by(benchmark, t).alias("b_last"),
        F.count(benchmark).alias("b_n"),
    ]
    return with_path(curve, axis, value).groupBy(*axis.keys).agg(
        F.min_by(value, t).alias("first_value"),
        F.max_by(value, t).alias("last_value"),
        F.count(F.lit(1)).alias("n"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg("ret").alias("mean_ret"),
        F.stddev_samp("ret").alias("sd_ret"),
        F.count("ret").alias("n_ret"),
        F.datediff(F.max(t), F.min(t)).alias("days"),
        *extra,
    )


def classic_metrics(summary: DataFrame, risk_free: float = 0.025) -> DataFrame:
    """Session-count annualisation over 252 days and Sharpe against a risk-free rate."""
    total = F.col("last_value") / F.col("first_value") - 1
    positive = F.col("first_value") > 0
    total = F.when(positive, total).otherwise(0.0)
    annual = (
        F.when(F.col("n") < 2, 0.0)
        .when(1 + total <= 0, -1.0)
        .otherwise(F.pow(1 + total, F.lit(float(YEAR)) / F.col("n")) - 1)
    )
    sharpe = F.when(
        (F.col("n") >= 2) & (F.col("sd_ret") > 0),
        (F.col("mean_ret") - risk_free / YEAR) / F.col("sd_ret") * math.sqrt(YEAR),
    )
    return summary.withColumns(
        {
            "total_return": total,
            "annual_return": annual,
            "sharpe": sharpe,
            "benchmark_return": F.when(F.col("b_first") > 0, F.col("b_last") / F.col("b_first") - 1),
        }
    )


def calendar_metrics(summary: DataFrame, trades: DataFrame, key: str = "instrument") -> DataFrame:
    """Calendar-day annualisation, volatility, Sharpe, excess return and round-trip statistics."""
    total = F.col("last_value") / F.col("first_value") - 1
    enough = F.col("n_ret") >= 2
    ok = (F.col("days") > 0) & (F.col("first_value") > 0) & (F.col("last_value") > 0)
    bench = F.when(F.col("b_n") == F.col("n"), F.col("b_last") / F.col("b_first") - 1)
    m = summary.withColumns(
        {
            "total_return": total,
            "annualized_return": F.when(ok, F.pow(F.col("last_value") / F.col("first_value"), F.lit(365.2425) / F.col("days")) - 1),
            "annualized_volatility": F.when(enough, F.col("sd_ret") * math.sqrt(YEAR)),
            "sharpe_ratio": F.when(enough & (F.col("sd_ret") > 0), F.col("mean_ret") / F.col("sd_ret") * math.sqrt(YEAR)),
            "benchmark_return": bench,
            "excess_return": total - bench,
        }
    )
    gain, loss = F.sum(F.when(F.col("net_pnl") > 0, F.col("net_pnl"))), -F.sum(F.when(F.col("net_pnl") < 0, F.col("net_pnl")))
    t = trades.groupBy(key).agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.avg((F.col("net_pnl") > 0).cast("int")).alias("win_rate"),
        F.coalesce(gain, F.lit(0.0)).alias("_g"),
        F.coalesce(loss, F.lit(0.0)).alias("_l"),
        F.avg("holding_days").alias("average_holding_days"),
    )
    factor = F.when(F.col("_l") > 0, F.try_divide(F.col("_g"), F.col("_l"))).when(F.col("_g") > 0, F.lit(float("inf")))
    out = m.join(t, key, "left").withColumn("profit_factor", factor)
    n = F.coalesce(F.col("trade_count"), F.lit(0))
    return out.withColumns(
        {
            "trade_count": n,
            "warning": F.when(n < 30, F.lit("sample_too_small_for_strong_inference")),
        }
    ).drop("_g", "_l")


def pair_trades(log: DataFrame, axis: Axis) -> DataFrame:
    """Round trips of a log: a SELL closes the BUY on the row right before it."""
    was = {f"_{c}": axis.lag(c) for c in ("action", "price", "date")}
    return (
        log.withColumns(was)
        .filter((F.col("action") == "SELL") & (F.col("_action") == "BUY"))
        .select(
            *axis.keys,
            ((F.col("price") - F.col("_price")) / F.col("_price")).alias("ret"),
            F.datediff("date", "_date").alias("hold_days"),
        )
    )


def round_trip_stats(pairs: DataFrame, *keys: str) -> DataFrame:
    win, lose = F.col("ret") > 0, F.col("ret") <= 0
    avg_win = F.coalesce(F.avg(F.when(win, F.col("ret"))), F.lit(0.0))
    avg_loss = F.abs(F.coalesce(F.avg(F.when(lose, F.col("ret"))), F.lit(0.0)))
    g = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("closed_trades"),
        F.avg(win.cast("int")).alias("win_rate"),
        avg_win.alias("_w"),
        avg_loss.alias("_l"),
        F.sum(win.cast("int")).alias("_n"),
        F.avg("hold_days").alias("avg_holding_days"),
    )
    ratio = F.when(F.col("_l") > 0, F.try_divide(F.col("_w"), F.col("_l"))).when(F.col("_n") == 0, 0.0)
    return g.withColumn("profit_loss_ratio", ratio).drop("_w", "_l", "_n")


def month_end_curve(curve: DataFrame, axis: Axis = DAILY, value: str = "equity", max_points: int = 60) -> DataFrame:
    """Last point of each month, rebased to 100, thinned to evenly spaced points."""
    t = axis.order[0]
    months = curve.groupBy(*axis.keys, F.trunc(t, "month").alias("month")).agg(
        F.max(t).alias("date"), F.max_by(value, t).alias("value")
    )
    by_month = Axis(axis.keys, ("month",))
    everything = by_month.whole
    m = months.withColumns(
        {"_i": by_month.row() - 1, "_n": F.count(F.lit(1)).over(everything), "_base": F.first("value").over(everything)}
    )
    # point k of the thinned curve sits at floor(k * (n-1) / (max_points-1))
    step = (F.col("_n") - 1) / F.lit(max_points - 1.0)
    k = F.ceil(F.col("_i") / step - F.lit(1e-9))
    chosen = (F.col("_n") <= max_points) | (
        (k <= max_points - 1) & (F.floor(k * step + F.lit(1e-9)) == F.col("_i"))
    )
    return m.filter(chosen & (F.col("_base") > 0)).select(
        *axis.keys, "date", F.round(F.col("value") / F.col("_base") * 100, 2).alias("value")
    )


def result_series(curve: DataFrame, axis: Axis = DAILY, value: str = "equity", benchmark: str = "benchmark") -> DataFrame:
    whole = axis.whole
    df = curve.withColumns(
        {
            "_e0": F.first(value).over(whole),
            "_b0": F.first(benchmark, ignorenulls=True).over(whole),
            "_peak": F.max(value).over(axis.so_far()),
        }
    )
    return df.select(
        *axis.keys,
        *axis.order,
        (F.col(value) / F.col("_e0") * 100).alias("equity_index"),
        (F.col(benchmark) / F.col("_b0") * 100).alias("benchmark_index"),
        (F.col(value) / F.col("_peak") - 1).alias("drawdown"),
    )


# The six friction settings of the stress report,
# (scenario, slippage multiple, participation rate or None for the base rate).
SCENARIOS = (
    ("base", 1.0, None),
    ("slippage_1_5x", 1.5, None),
    ("slippage_2x", 2.0, None),
    ("participation_2_5pct", 1.0, 0.025),
    ("participation_5pct", 1.0, 0.05),
    ("participation_10pct", 1.0, 0.10),
)


def scenarios(slippage_bps: float, participation: float) -> list[tuple[str, float, float]]:
    """Scenarios with identical settings are run once, under the first name."""
    out: dict[tuple[float, float], str] = {}
    for name, multiple, rate in SCENARIOS:
        out.setdefault((slippage_bps * multiple, participation if rate is None else rate), name)
    return [(name, *config) for config, name in out.items()]


def stress(outcomes: DataFrame, settings: list[tuple[str, float, float]]) -> DataFrame:
    """Re-price labelled outcomes under each scenario; every row fans out to at most six."""
    items = [F.struct(F.lit(n).alias("scenario_id"), F.lit(b).alias("slippage_bps"), F.lit(r).alias("participation_rate")) for n, b, r in settings]
    rows = outcomes.select("buy_price", "exit_price", "volume", F.explode(F.array(*items)).alias("_s")).select("*", "_s.*")
    s = F.col("slippage_bps") / 10000
    net = F.col("exit_price") * (1 - s) / (F.col("buy_price") * (1 + s)) - 1
    fill = F.least(F.lit(1.0), F.col("participation_rate") * F.col("volume") / F.lit(100.0))
    per = rows.groupBy("scenario_id", "slippage_bps", "participation_rate").agg(
        F.count(F.lit(1)).alias("trade_count"), F.avg(net * fill).alias("mean_return"), F.min(net * fill).alias("worst_return")
    )
    report = per.agg(F.array_sort(F.collect_list(F.struct(*per.columns))).alias("_r"), F.min("mean_return").alias("range_min"), F.max("mean_return").alias("range_max"))
    return report.select(F.explode("_r").alias("_r"), "range_min", "range_max").select("_r.*", "range_min", "range_max")


def mark_to_market(log: DataFrame, bars: DataFrame, capital: float, axis: Axis = DAILY) -> DataFrame:
    """Equity per session: capital + running cash flow + running shares x close."""
    flows = log.groupBy(*axis.keys, "session_date").agg(
        F.sum("cash_flow").alias("_cash"), F.sum("share_change").alias("_shares")
    )
    df = bars.join(flows.hint("merge"), [*axis.keys, "session_date"], "left")
    run = axis.so_far()
    cash = F.lit(capital) + F.coalesce(F.sum("_cash").over(run), F.lit(0.0))
    shares = F.coalesce(F.sum("_shares").over(run), F.lit(0))
    return df.withColumns({"cash": cash, "shares": shares}).withColumn(
        "equity", F.col("cash") + F.col("shares") * F.col("close")
    ).drop("_cash", "_shares")


