"""What followed each trigger: exits under configurable rules, set-based.

No rule enumerates (trigger, future bar) pairs. Signal and calendar exits are a
minimum over the following rows; price exits use ``first_passage``, which climbs
and descends a hierarchy of block extrema, one row a level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import DAILY, Axis
from tidemark.session import materialise

WIDTH = 32  # bars in a block, blocks in a block of blocks


def _hierarchy(bars: DataFrame, key: str) -> list[DataFrame]:
    """(key, up, at, lo, hi) for bars and for blocks of ``WIDTH``, ``WIDTH`` squared, ... bars, until a key is one block."""
    longest = bars.agg(F.max("rn")).first()[0] or 0
    levels, size = [bars.select(key, (F.col("rn") - 1).cast("long").alias("at"), F.col("close").alias("lo"), F.col("close").alias("hi"))], WIDTH
    while size < longest:
        below = levels[-1].withColumn("at", F.floor(F.col("at") / WIDTH))
        levels.append(materialise(below.groupBy(key, "at").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "block-extrema"))
        size *= WIDTH
    return [x.withColumn("up", F.floor(F.col("at") / WIDTH)) for x in levels]


def first_passage(bars: DataFrame, starts: DataFrame, threshold: str, falls: Column | bool, out: str, key: str = "instrument") -> DataFrame:
    """First bar after each start whose close is at or beyond the start's threshold.

    ``starts`` carries (key, rn, threshold column), rows of which may repeat; ``out`` is the bar number or NULL. A start looks for
    the first sibling after itself that holds a hit, first among the bars of its block, then among the blocks of the next
    level and so on, and from there down to the bar: equality joins on (key, block), each with at most ``WIDTH`` candidates,
    of which the smallest stays. Blocks, not keys, are the unit of work, so a long key is many tasks. Joins are hinted to merge:
    stored blocks are many times smaller in their files than in memory, and would be collected on the driver for a broadcast.
    """
    down = falls if isinstance(falls, Column) else F.lit(falls)
    hit = F.when(F.col("_falls"), F.col("lo") <= F.col("_thr")).otherwise(F.col("hi") >= F.col("_thr"))
    levels = _hierarchy(bars.select(key, "rn", "close"), key)
    s = starts.select(key, "rn", F.col(threshold).alias("_thr"), down.alias("_falls")).filter("_thr is not null").distinct()
    s = s.withColumns({"_at": (F.col("rn") - 1).cast("long"), "_level": F.lit(None).cast("int")})
    who = [key, "rn", "_thr", "_falls", "_at", "_level"]
    for n, nodes in enumerate(levels):  # up: a start that has found nothing goes on as its block
        asks = s.withColumn("up", F.floor(F.col("_at") / WIDTH))
        asks = asks.withColumn("up", F.when(F.col("_level").isNull(), F.col("up")))
        met = asks.join(nodes.hint("merge"), [key, "up"], "left").groupBy(*who, "up").agg(F.min(F.when((F.col("at") > F.col("_at")) & hit, F.col("at"))).alias("_hit"))
        found = F.col("_hit").isNotNull()
        s = met.select(key, "rn", "_thr", "_falls", F.when(found, F.col("_hit")).when(F.col("_level").isNull(), F.col("up")).otherwise(F.col("_at")).alias("_at"),
                       F.when(found, n).otherwise(F.col("_level")).alias("_level"))
    s = s.filter("_level is not null")
    for n in range(len(levels) - 1, 0, -1):  # down: a block that holds the first hit goes on as the first child that does
        asks = s.withColumn("up", F.when(F.col("_level") == n, F.col("_at")))
        met = asks.join(levels[n - 1].hint("merge"), [key, "up"], "left").groupBy(*who, "up").agg(F.min(F.when(hit, F.col("at"))).alias("_hit"))
        here = F.col("_level") == n
        s = met.select(key, "rn", "_thr", "_falls", F.when(here, F.col("_hit")).otherwise(F.col("_at")).alias("_at"), F.when(here, n - 1).otherwise(F.col("_level")).alias("_level"))
    answers = s.select(key, "rn", F.col("_thr").alias(threshold), F.col("_falls").alias("_down"), (F.col("_at") + 1).cast("int").alias(out))
    return starts.withColumn("_down", down).join(answers.hint("merge"), [key, "rn", threshold, "_down"], "left").drop("_down")


def first_passages(bars: DataFrame, starts: DataFrame, asks: dict[str, tuple[Column, bool, Column | None]],
                   key: str = "instrument") -> DataFrame:
    """Several first passages per start in one pass: name -> (threshold, falls, condition to ask at all)."""
    items = []
    for name, (threshold, falls, when) in asks.items():
        ask = F.struct(F.lit(name).alias("_ask"), threshold.alias("_thr"), F.lit(falls).alias("_falls"))
        items.append(ask if when is None else F.when(when, ask))
    q = starts.select(key, "rn", F.explode(F.array_compact(F.array(*items))).alias("_q")).select(key, "rn", "_q.*")
    answered = first_passage(bars, q, "_thr", F.col("_falls"), "_at", key)
    return answered.groupBy(key, "rn").agg(*[F.max(F.when(F.col("_ask") == n, F.col("_at"))).alias(n) for n in asks])


def with_records(bars: DataFrame, entry: Column, axis: Axis = DAILY, out: str = "_record") -> DataFrame:
    """Marks bars whose close is above all closes since the last entry before them.

    The close that a trailing stop falls from is such a bar, whatever entry the position has; bars that are not, and bars before
    the first entry, need not be asked.
    """
    b = bars.withColumn("_leg", F.coalesce(F.sum(F.when(entry, 1).otherwise(0)).over(axis.so_far(-1)), F.lit(0)))
    before = Window.partitionBy(*axis.keys, "_leg").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    higher = F.coalesce(F.col("close") > F.max("close").over(before), F.lit(True))
    return b.withColumn(out, (F.col("_leg") > 0) & higher).drop("_leg")


def with_reach(bars: DataFrame, axis: Axis = DAILY) -> DataFrame:
    """Adds the extremes of all later closes: a threshold beyond them is never met and need not be asked."""
    after = axis.ahead(1)
    return bars.withColumns({"_lowest": F.min("close").over(after), "_highest": F.max("close").over(after)})


@dataclass(frozen=True)
class Hold:
    sessions: int


@dataclass(frozen=True)
class StopLoss:
    pct: float


@dataclass(frozen=True)
class TakeProfit:
    pct: float


@dataclass(frozen=True)
class TrailingStop:
    pct: float


@dataclass(frozen=True)
class OnSignal:
    column: str
    reason: str = "hit_reverse_signal"
    unseen: str = "force_close_end_reverse_signal_not_seen"


@dataclass(frozen=True)
class PeriodEnd:
    unit: str  # month_end | quarter_end


Rule = Hold | StopLoss | TakeProfit | TrailingStop | OnSignal | PeriodEnd


def on_atom(atom: str) -> OnSignal:
    return OnSignal(atom, f"hit_sell_on_{atom}", f"force_close_end_{atom}_not_seen")


def _exit(hit: Column, order: int, reason: str, missed: str) -> Column:
    return F.when(
        hit.isNotNull(), F.struct(hit.alias("idx"), F.lit(order).alias("rule"), F.lit(reason).alias("reason"))
    ).otherwise(F.struct(F.col("last_rn").alias("idx"), F.lit(order).alias("rule"), F.lit(missed).alias("reason")))


def label_exits(bars: DataFrame, trigger: str, rules: Sequence[Rule], axis: Axis = DAILY) -> DataFrame:
    """One row per usable trigger with a struct column ``exit_<n>`` for every rule."""
    key = axis.keys[0]
    after = axis.ahead(1)
    b = bars.withColumns({"rn": axis.row(), "_next_date": axis.lead("session_date"), "buy_price": axis.lead("open")})
    b = b.withColumn("last_rn", F.max("rn").over(axis.whole))
    usable = (F.col(trigger) == 1) & (F.col("rn") < F.col("last_rn")) & (F.col("buy_price") > 0)
    priced = any(isinstance(r, (StopLoss, TakeProfit, TrailingStop)) for r in rules)
    if any(isinstance(r, TrailingStop) for r in rules):
        b = with_records(b, usable, axis)
    if priced:
        b = with_reach(b, axis)
    asks: dict[str, tuple[Column, bool, Column | None]] = {}
    wanted, kept = F.coalesce(usable, F.lit(False)), {}
    for n, r in enumerate(rules):
        if isinstance(r, (StopLoss, TakeProfit, TrailingStop)):
            falls = not isinstance(r, TakeProfit)
            threshold = F.col("close") * (1 + (-1 if falls else 1) * r.pct / 100)
            reached = threshold >= F.col("_lowest") if falls else threshold <= F.col("_highest")
            # a trailing stop fires at the earliest bar that has fallen by pct from any close since entry
            trailing = isinstance(r, TrailingStop)
            kept[f"_ask{n}"] = F.coalesce((F.col("_record") if trailing else usable) & reached, F.lit(False))
            asks[f"_drop{n}" if trailing else f"_at{n}"] = (threshold, falls, F.col(f"_ask{n}"))
            wanted = wanted | kept[f"_ask{n}"]
        elif isinstance(r, OnSignal):
            kept[f"_at{n}"] = F.min(F.when(F.col(r.column) == 1, F.col("rn"))).over(after)
        elif isinstance(r, PeriodEnd):
            unit = "month" if r.unit == "month_end" else "quarter"
            ends = F.trunc("session_date", unit) != F.trunc("_next_date", unit)
            kept[f"_at{n}"] = F.min(F.when(ends, F.col("rn"))).over(after)
    columns = list(dict.fromkeys([*axis.keys, *axis.order, "session_date", "rn", "last_rn", "buy_price", "close", trigger]))
    b = b.select(*columns, *[c.alias(n) for n, c in kept.items()], wanted.alias("_wanted")).filter("_wanted").drop("_wanted")
    if asks:
        # triggers and closes that a stop trails from, read twice
        b = materialise(b, "exit-starts")
        b = b.join(first_passages(bars.withColumn("rn", axis.row()).select(key, "rn", "close"), b, asks, key).hint("merge"), [key, "rn"], "left")
    for n, r in enumerate(rules):
        if isinstance(r, TrailingStop):
            b = b.withColumn(f"_at{n}", F.min(f"_drop{n}").over(after)).drop(f"_drop{n}")
    t = b.filter(usable)
    exits = {}
    for n, r in enumerate(rules):
        if isinstance(r, Hold):
            target = F.col("rn") + r.sessions
            at = F.when(target <= F.col("last_rn"), target)
            exits[f"exit_{n}"] = _exit(at, n, f"hit_hold_n_days_{r.sessions}", "force_close_end_hold_n_days_overflow")
            continue
        at = F.col(f"_at{n}")
        if isinstance(r, StopLoss):
            exits[f"exit_{n}"] = _exit(at, n, f"hit_stop_loss_{r.pct:g}pct", "force_close_end_stop_loss_not_hit")
        elif isinstance(r, TakeProfit):
            exits[f"exit_{n}"] = _exit(at, n, f"hit_take_profit_{r.pct:g}pct", "force_close_end_take_profit_not_hit")
        elif isinstance(r, TrailingStop):
            exits[f"exit_{n}"] = _exit(at, n, f"hit_trailing_stop_{r.pct:g}pct", "force_close_end_trailing_stop_not_hit")
        elif isinstance(r, OnSignal):
            exits[f"exit_{n}"] = _exit(at, n, r.reason, r.unseen)
        else:
            exits[f"exit_{n}"] = _exit(at, n, f"hit_hold_until_{r.unit}", f"force_close_end_no_{r.unit}_seen")
    return t.withColumns(exits).select(key, "session_date", "rn", "buy_price", "last_rn", *exits)


def outcomes(bars: DataFrame, trigger: str, rules: Sequence[Rule], axis: Axis = DAILY) -> DataFrame:
    """Buy at the open after the trigger, leave at the close of the earliest exit."""
    key = axis.keys[0]
    labelled = label_exits(bars, trigger, rules, axis)
    first = F.least(*[F.col(f"exit_{n}") for n in range(len(rules))]) if len(rules) > 1 else F.col("exit_0")
    t = labelled.withColumn("_x", first).select(
        key, "session_date", "rn", "buy_price", F.col("_x.idx").alias("exit_rn"), F.col("_x.reason").alias("exit_reason")
    )
    closes = bars.withColumn("exit_rn", axis.row()).select(
        key, "exit_rn", F.col("session_date").alias("exit_date"), F.col("close").alias("exit_price")
    )
    out = t.join(closes.hint("merge"), [key, "exit_rn"]).filter(F.col("exit_price") > 0)
    return out.withColumn("return_pct", (F.col("exit_price") / F.col("buy_price") - 1) * 100)


def non_overlapping(trades: DataFrame, key: str = "instrument", start: str = "rn", end: str = "exit_rn") -> DataFrame:
    """Keep a trade only if it starts after the last kept one ended.

    Each candidate knows the first one after its exit. From the first candidate of a key the kept ones are a chain of such steps;
    tables of 1, 2, 4, ... steps, each the join of the one before with itself, reach every member of the chain in as many joins as
    its length has binary digits. They are merge joins: a table of steps of a few MB in its files is some hundred in memory.
    """
    numbered = Window.partitionBy(key).orderBy(start, end)
    t = materialise(trades.withColumn("_i", F.row_number().over(numbered)), "candidates")
    none = F.lit(None).cast("int")
    begins = t.select(key, F.col(start).alias("_x"), F.lit(0).alias("_asks"), none.alias("_i"), F.col("_i").alias("_to"))
    exits = t.select(key, F.greatest(start, end).alias("_x"), F.lit(1).alias("_asks"), "_i", none.alias("_to"))
    later = Window.partitionBy(key).orderBy(F.desc("_x"), F.desc("_asks"), F.desc("_to")).rowsBetween(Window.unboundedPreceding, 0)
    steps = begins.unionAll(exits).withColumn("_to", F.last("_to", ignorenulls=True).over(later)).filter("_asks = 1 and _to is not null").select(key, "_i", "_to")
    tables = []
    while True:
        steps = materialise(steps, "steps")
        if not steps.head(1):
            break
        tables.append(steps)
        on = steps.select(key, F.col("_i").alias("_to"), F.col("_to").alias("_on"))
        steps = steps.join(on.hint("merge"), [key, "_to"]).select(key, "_i", F.col("_on").alias("_to"))
    kept = t.filter("_i = 1").select(key, "_i")
    for steps in reversed(tables):
        kept = kept.join(steps.hint("merge"), [key, "_i"], "left").select(key, F.explode(F.array_compact(F.array("_i", "_to"))).alias("_i"))
    return t.join(kept.hint("merge"), [key, "_i"]).select(*trades.columns)


def entry_occurrences(df: DataFrame, state: str, axis: Axis, out: str = "occurrence") -> DataFrame:
    """Keep the first TRUE of each known episode; an unknown row neither fires nor re-arms."""
    before = F.last(state, ignorenulls=True).over(axis.so_far(-1))
    fresh = F.col(state) & ~F.coalesce(before, F.lit(False))
    return df.withColumn(out, F.when(~F.col(state), F.lit(False)).when(fresh, F.lit(True)))


def first_available(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The chronologically first exit fact per key under a total order."""
    return df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_f")).select(*keys, "_f.*")
