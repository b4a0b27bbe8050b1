"""Ledger analytics for many accounts at once.

A single account may hold a large share of all rows, so nothing here windows
over a whole account of unbounded size: rows are aggregated to (account, symbol, day),
running totals move across days, and the rows of one day are ordered inside that day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise


def before(*keys: str, order: str) -> object:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def running(trades: DataFrame, keys: Sequence[str], day: str, seq: str, values: dict[str, Column]) -> DataFrame:
    """Inclusive running totals per key over (day, seq), carried across days."""
    daily = trades.groupBy(*keys, day).agg(*[F.sum(v).alias(f"_d_{n}") for n, v in values.items()])
    w = before(*keys, order=day)
    carry = daily.select(*keys, day, *[F.coalesce(F.sum(f"_d_{n}").over(w), F.lit(0.0)).alias(f"_c_{n}") for n in values])
    inside = Window.partitionBy(*keys, day).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    t = trades.join(carry, [*keys, day])
    t = t.withColumns({n: F.col(f"_c_{n}") + F.sum(v).over(inside) for n, v in values.items()})
    return t.drop(*[f"_c_{n}" for n in values])


def qty(side: str) -> Column:
    return F.when(F.col("side") == side, F.col("quantity")).otherwise(0.0)


def buy_cost() -> Column:
    return F.when(F.col("side") == "buy", F.col("quantity") * F.col("price") + F.col("fees")).otherwise(0.0)


SLOTS = 64  # average trades in a bucket of the share axis
SMALL = 100_000  # trades of a key that one window may hold
TRADES_A_TASK = 250_000


def fifo(trades: DataFrame, keys: Sequence[str] = ("account", "symbol"), day: str = "trade_date", seq: str = "seq") -> DataFrame:
    """First-in-first-out realised P&L, one row per sell.

    With B(t), S(t) the shares bought and sold so far and C(x) the cost of the
    first x shares bought, a sell that takes the shares (S0, S1] costs
    C(S1) - C(S0), both found among the lots ordered by their first share; no lot/sell pairs are formed.

    Keys of at most ``SMALL`` trades are dealt once by key, and all windows and sums stay where they are. The few larger ones
    (their number is bounded by the trades over ``SMALL``) go by days and by buckets of shares, see ``_fifo_in_buckets``.

    A key becomes incomplete at its first uncovered sell, or on a day with both
    sides and a time known only to the day; from there on its P&L is NULL.
    """
    keys = list(keys)
    sizes = materialise(trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "ledger-keys")
    large = sizes.filter(F.col("_n") > SMALL).select(*keys)
    total, n_large = sizes.agg(F.sum("_n"), F.count_if(F.col("_n") > SMALL)).first()
    parts = max(trades.sparkSession.sparkContext.defaultParallelism, -(-(total or 0) // TRADES_A_TASK))
    if not n_large:
        return _fifo_by_key(trades, keys, day, seq, parts)
    few = F.broadcast(large)
    small = _fifo_by_key(_join(trades, few, keys, "left_anti"), keys, day, seq, parts)
    return small.unionByName(_fifo_in_buckets(_join(trades, few, keys, "left_semi"), keys, day, seq))


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join by columns of the same names, of which a null equals a null."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in on})
    return left.join(right, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in on], how).drop(*[f"_r_{k}" for k in on])


def _lot() -> Column:
    return F.struct((F.col("_b") - F.col("quantity")).alias("b0"), (F.col("_c") - buy_cost()).alias("c0"), F.try_divide(buy_cost(), F.col("quantity")).alias("unit"))


def _realised(found: DataFrame, columns: list[str], keys: list[str], day: str, seq: str) -> DataFrame:
    """One row a sell from its ends, each with the lot it lies in."""
    at = F.col("_lot.c0") + (F.col("_x") - F.col("_lot.b0")) * F.col("_lot.unit")
    rest = [c for c in [*columns, "complete"] if c not in (*keys, day, seq)]
    # the other columns depend on the sell, so they can be grouping keys of a hash aggregate
    out = found.groupBy(*keys, day, seq, *rest).agg(F.sum(F.when(F.col("_sign") != 0, F.col("_sign") * at)).alias("fifo_cost"))
    pnl = F.col("quantity") * F.col("price") - F.col("fees") - F.col("fifo_cost")
    return out.select(*columns, "complete", "fifo_cost", pnl.alias("fifo_pnl"))


def _fifo_by_key(trades: DataFrame, keys: list[str], day: str, seq: str, parts: int) -> DataFrame:
    """``fifo`` of keys that fit into a window each: one exchange, by key."""
    so_far = Window.partitionBy(*keys).orderBy(day, seq)
    whole_day = Window.partitionBy(*keys, day)
    is_sell = F.col("side") == "sell"
    t = trades.repartition(parts, *keys).withColumns({"_b": F.sum(qty("buy")).over(so_far), "_s": F.sum(qty("sell")).over(so_far), "_c": F.sum(buy_cost()).over(so_far)})
    mixed = (F.sum(qty("buy")).over(whole_day) > 0) & (F.sum(qty("sell")).over(whole_day) > 0) & F.bool_or(F.col("precision") == "date_only").over(whole_day)
    t = t.withColumn("_bad", mixed | (is_sell & (F.col("_s") > F.col("_b"))))
    t = t.withColumn("complete", F.max(F.when(F.col("_bad"), 1)).over(so_far).isNull())

    unsigned, no_lot = F.lit(None).cast("double"), F.lit(None).cast("struct<b0:double,c0:double,unit:double>")
    event = lambda x, sign, lot: F.struct(x.alias("_x"), sign.alias("_sign"), lot.alias("_lot"))
    last, first = F.col("_s"), F.col("_s") - F.col("quantity")
    # a buy is a lot, a covered sell its two ends, any other sell passes through
    events = (
        F.when(~is_sell, F.array(event(F.col("_b") - F.col("quantity"), unsigned, _lot())))
        .when(F.col("complete"), F.array(event(last, F.lit(1.0), no_lot), event(first, F.lit(-1.0), no_lot)))
        .otherwise(F.array(event(unsigned, F.lit(0.0), no_lot)))
    )
    both = t.select(*trades.columns, "complete", F.explode(events).alias("_e")).select(*trades.columns, "complete", "_e.*")
    by_position = Window.partitionBy(*keys).orderBy("_x", F.col("_sign").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_lot", F.last("_lot", ignorenulls=True).over(by_position)).filter(F.col("_sign").isNotNull())
    return _realised(found, trades.columns, keys, day, seq)


def _fifo_in_buckets(trades: DataFrame, keys: list[str], day: str, seq: str) -> DataFrame:
    """``fifo`` of large keys. The axis of shares is cut into buckets, long lots at their borders, so both ends of a sell find their
    lot inside one bucket, and a busy key is as many tasks as it has buckets."""
    date_only = F.col("precision") == "date_only"
    days = trades.groupBy(*keys, day).agg(
        F.sum(qty("buy")).alias("bq"), F.sum(qty("sell")).alias("sq"), F.sum(buy_cost()).alias("bc"), F.count(F.lit(1)).alias("_n"), F.bool_or(date_only).alias("_vague")
    )
    days = days.withColumn("_mixed", (F.col("bq") > 0) & (F.col("sq") > 0) & F.col("_vague")).drop("_vague")
    w = before(*keys, order=day)
    days = days.withColumns(
        {n: F.coalesce(F.sum(c).over(w), F.lit(0.0)) for n, c in (("b0", "bq"), ("s0", "sq"), ("c0", "bc"))}
    )
    # one row per key and day, read by three consumers below
    days = materialise(days, "ledger-days")
    shares, n = days.agg(F.sum(F.col("bq") + F.col("sq")), F.sum("_n")).first()
    width = SLOTS * shares / n if shares else 1.0
    inside = Window.partitionBy(*keys, day).orderBy(seq)
    t = _join(trades, days.select(*keys, day, "b0", "s0", "c0", "_mixed"), [*keys, day])
    t = t.withColumns(
        {
            "_b": F.col("b0") + F.sum(qty("buy")).over(inside),
            "_s": F.col("s0") + F.sum(qty("sell")).over(inside),
            "_c": F.col("c0") + F.sum(buy_cost()).over(inside),
        }
    )
    bad = F.col("_mixed") | ((F.col("side") == "sell") & (F.col("_s") > F.col("_b")))
    t = t.withColumn("_bad_here", F.max(F.when(bad, 1)).over(inside))
    # the first bad row of each day, then of the days before
    bad_days = t.groupBy(*keys, day).agg(F.max("_bad_here").alias("_bad"))
    bad_days = bad_days.select(*keys, day, F.max("_bad").over(w).alias("_bad_before"))
    t = _join(t, bad_days, [*keys, day]).withColumn("complete", F.coalesce("_bad_here", "_bad_before").isNull())

    is_sell = F.col("side") == "sell"
    covered = is_sell & F.col("complete")
    kept = [c for c in trades.columns if c not in keys] + ["complete"]
    lot = _lot()
    no_lot = F.lit(None).cast("struct<b0:double,c0:double,unit:double>")
    unsigned = F.lit(None).cast("double")
    left = lambda x: F.floor(x / width)  # noqa: E731  the bucket that begins at or before x
    right = lambda x: F.ceil(x / width) - 1  # noqa: E731  the bucket that x ends, or lies in

    def point(x: Column, sign: float, bucket: Column) -> Column:
        return F.struct(bucket.cast("long").alias("_bucket"), x.alias("_x"), F.lit(sign).alias("_sign"), no_lot.alias("_lot"))

    # every row is read once: a buy becomes a lot in each bucket it reaches, a covered sell its two ends, any other sell passes through
    begin, end = F.col("_b") - F.col("quantity"), F.col("_b")
    reached = F.sequence(left(begin).cast("long"), F.greatest(left(begin), right(end)).cast("long"))
    as_lot = F.transform(reached, lambda k: F.struct(k.alias("_bucket"), F.greatest(begin, k * width).alias("_x"), unsigned.alias("_sign"), lot.alias("_lot")))
    last, first = F.col("_s"), F.col("_s") - F.col("quantity")
    as_ends = F.array(point(last, 1.0, right(last)), point(first, -1.0, left(first)))
    as_is = F.array(point(unsigned, 0.0, F.lit(-1)))
    both = t.select(*keys, *kept, F.explode(F.when(~is_sell, as_lot).when(covered, as_ends).otherwise(as_is)).alias("_e")).select(*keys, *kept, "_e.*")
    by_position = Window.partitionBy(*keys, "_bucket").orderBy("_x", F.col("_sign").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_lot", F.last("_lot", ignorenulls=True).over(by_position)).filter(F.col("_sign").isNotNull())
    return _realised(found, trades.columns, keys, day, seq)


def oversold(trades: DataFrame, keys: Sequence[str] = ("account", "symbol")) -> DataFrame:
    """Keys whose running position goes below zero at some trade."""
    signed = qty("buy") - qty("sell")
    r = running(trades, keys, "trade_date", "seq", {"position": signed})
    return r.groupBy(*keys).agg(F.min("position").alias("lowest"), F.sum(signed).alias("final_position"))


def linked_returns(equity: DataFrame, flows: DataFrame, account: str = "account", day: str = "day") -> DataFrame:
    """Time-weighted linked index from daily equity and external flows.

    A flow belongs to the interval (previous equity date, this one]; both are
    daily rows, so one ordered window per account stays within the calendar.
    Columns ``own_in`` and ``own_out`` of the equity rows, where they exist, are flows that the
    account itself states: one of them given replaces the derived ones, and
    differing from derived ones that are not zero is a conflict.

    From the first interval that cannot be linked on, return, index and
    drawdown are NULL and ``problem`` tells why: a conflict of flows, or
    flow-adjusted equity that is not positive.
    """
    f = flows.groupBy(account, day).agg(F.sum("inflow").alias("_in"), F.sum("outflow").alias("_out"))
    stated = [F.max(c).alias(f"_{c}") for c in ("own_in", "own_out") if {"own_in", "own_out"} <= set(equity.columns)]
    both = equity.join(f, [account, day], "full_outer")
    w = Window.partitionBy(account).orderBy(day)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumn("_to", F.min(F.when(F.col("equity").isNotNull(), F.col(day))).over(ahead))
    moved = both.groupBy(account, F.col("_to").alias(day)).agg(
        F.max("equity").alias("equity"), F.coalesce(F.sum("_in"), F.lit(0.0)).alias("inflow"), F.coalesce(F.sum("_out"), F.lit(0.0)).alias("outflow"), *stated
    ).filter(F.col(day).isNotNull())
    moved = moved.withColumn("_prev", F.lag("equity").over(w))
    linked = F.col("_prev").isNotNull()
    conflict = F.lit(False)
    if stated:
        given = F.col("_own_in").isNotNull() | F.col("_own_out").isNotNull()
        own_in, own_out = F.coalesce("_own_in", F.lit(0.0)), F.coalesce("_own_out", F.lit(0.0))
        derived = (F.col("inflow") != 0) | (F.col("outflow") != 0)
        conflict = linked & given & derived & ((own_in != F.col("inflow")) | (own_out != F.col("outflow")))
        moved = moved.withColumns({"_conflict": conflict, "inflow": F.when(given, own_in).otherwise(F.col("inflow")), "outflow": F.when(given, own_out).otherwise(F.col("outflow"))})
        conflict = F.col("_conflict")
    top, bottom = F.col("equity") + F.col("outflow"), F.col("_prev") + F.col("inflow")
    here = F.when(conflict, "flow_conflict").when(linked & ((top <= 0) | (bottom <= 0)), "equity_not_positive")
    moved = moved.withColumn("_here", here)
    moved = moved.withColumn("problem", F.first("_here", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fine = F.col("problem").isNull()
    out = moved.withColumn("period_return", F.when(fine & linked, F.try_divide(top, bottom) - 1))
    out = out.withColumn("linked_index", F.when(fine, F.exp(F.coalesce(F.sum(F.log(1 + F.col("period_return"))).over(w), F.lit(0.0)))))
    out = out.withColumn("drawdown", F.col("linked_index") / F.max("linked_index").over(w) - 1)
    return out.drop("_prev", "_here", "_conflict", "_own_in", "_own_out")


def grade(covered: Column, total: Column) -> Column:
    """Coverage grade of a capability."""
    return F.when(total == 0, "unavailable").when(covered == total, "complete").when(covered > 0, "partial").otherwise("unavailable")
