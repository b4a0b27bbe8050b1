"""Point-in-time joins as unions and ordered windows: one shuffle, no pair explosion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_session(rows: DataFrame, sessions: DataFrame, day: str, out: str, strict: bool) -> DataFrame:
    """First session on (or, if strict, after) each row's day.

    The mapping is built once per distinct day, which the calendar bounds, and
    is then joined back by equality.
    """
    days = rows.select(F.col(day).alias("_d")).distinct().withColumn("_s", F.lit(None).cast("date"))
    marks = sessions.select(F.col("session_date").alias("_d"), F.col("session_date").alias("_s")).distinct()
    both = days.unionByName(marks).withColumn("_k", F.datediff("_d", F.lit("1970-01-01").cast("date")))
    after = Window.orderBy("_k").rangeBetween(int(strict), Window.unboundedFollowing)
    both = both.withColumn("_n", F.min("_s").over(after))
    table = both.filter(F.col("_s").isNull()).select(F.col("_d").alias(day), F.col("_n").alias(out))
    return rows.join(table, day, "left")


def latest_known(
    bars: DataFrame,
    facts: DataFrame,
    keys: Sequence[str],
    bar_time: str,
    known_at: str,
    rank: Sequence[str],
    carry: Sequence[str],
    strict: bool = False,
    prefix: str = "fact_",
) -> DataFrame:
    """As-of join: per bar, the highest-ranked fact known by (or before) the bar's time.

    ``rank`` orders the facts; it usually starts with the period described, so a
    late report about an old period never replaces a newer one.
    Facts that share keys and time are reduced to the highest-ranked before the
    shuffle, so a burst of revisions costs one row.
    """
    # struct fields: rank first (max of the struct picks the winner), then the rest
    names = list(dict.fromkeys([*rank, *carry]))
    f = facts.groupBy(*keys, F.col(known_at).alias("_t")).agg(F.max(F.struct(*names)).alias("_f"))
    side = F.lit(1 if strict else 0)
    f = f.withColumn("_o", side)
    b = bars.withColumns({"_t": F.col(bar_time), "_o": F.lit(0 if strict else 1)})
    both = b.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_m", F.max("_f").over(w)).filter(F.col("_o") == (0 if strict else 1))
    return both.select(*bars.columns, *[F.col(f"_m.{c}").alias(f"{prefix}{c}") for c in names])


def forward_fill(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str],
                 parts: int | None = None) -> DataFrame:
    """Left join on (keys, order), then carry the last known value forward, in ``parts`` partitions by key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if parts is not None:
        left, right = (side.repartition(parts, *keys, order) for side in (left, right))
    out = left.join(right, [*keys, order], "left")
    out = out if parts is None else out.repartition(parts, *keys)
    return out.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def axis_union(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Union of two date axes with both sides carried forward."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = left.join(right, [*keys, order], "full_outer")
    return out.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def next_own_session(rows: DataFrame, sessions: DataFrame, keys: Sequence[str], day: str, out: str | None, strict: bool = False,
                     after: str | None = None) -> DataFrame:
    """First session of the row's own instrument on (``out``) and after (``after``) its day.

    With ``strict`` the column ``out`` itself looks after the day. Rows are
    reduced to distinct (key, day) first, so a window partition never holds
    more than two calendars.
    """
    d = rows.select(*keys, F.col(day).alias("_d")).distinct()
    s = sessions.select(*keys, F.col("session_date").alias("_d"), F.col("session_date").alias("_s"))
    both = d.unionByName(s, allowMissingColumns=True).withColumn(
        "_k", F.datediff("_d", F.lit("1970-01-01").cast("date"))
    )
    w = Window.partitionBy(*keys).orderBy("_k")
    wanted = {out: int(strict)} if out else {}
    if after:
        wanted[after] = 1
    found = both.withColumns(
        {n: F.min("_s").over(w.rangeBetween(first, Window.unboundedFollowing)) for n, first in wanted.items()}
    ).filter(F.col("_s").isNull())
    return rows.join(found.select(*keys, F.col("_d").alias(day), *wanted), [*keys, day], "left")


def earliest_tradable(rows: DataFrame, sessions: DataFrame, keys: Sequence[str], at: str, out: str) -> DataFrame:
    """Earliest continuous-trading instant at or after a local timestamp.

    Sessions run 09:30-11:30 and 13:00-15:00; lunch and night roll forward.
    """
    r = rows.withColumn("_day", F.to_date(at))
    r = next_own_session(r, sessions, keys, "_day", "_today", after="_after")
    clock = F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)

    def opening(day: str, clock_text: str) -> Column:
        return F.to_timestamp_ntz(F.concat(F.col(day).cast("string"), F.lit(clock_text)))

    instant = (
        F.when(F.col("_today") != F.col("_day"), opening("_today", " 09:30:00"))
        .when(clock < 34200, opening("_day", " 09:30:00"))
        .when(clock < 41400, F.col(at))
        .when(clock < 46800, opening("_day", " 13:00:00"))
        .when(clock < 54000, F.col(at))
        .otherwise(opening("_after", " 09:30:00"))
    )
    return r.withColumn(out, F.when(F.col("_today").isNotNull(), instant)).drop("_day", "_today", "_after")


def future_rows(starts: DataFrame, rows: DataFrame, keys: Sequence[str], index: str, horizon: int) -> DataFrame:
    """Each start with its next ``horizon`` rows: an equality join on generated indexes."""
    s = starts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "_i", F.col(index) + F.col("step")
    )
    return s.join(rows.withColumnRenamed(index, "_i"), [*keys, "_i"]).drop("_i")


def overlay(base: DataFrame, extra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``extra`` replace the rows of ``base`` with the same keys; others stay."""
    return base.join(extra.select(*keys), list(keys), "left_anti").unionByName(extra.select(*base.columns))
