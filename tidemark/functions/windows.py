"""Ordered axes and gated rolling windows.

A rolling value is NULL until its frame is full: Spark windows would otherwise
return values over partial frames, which count as look-ahead-free but unstable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(x: Column | str | int | float) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


@dataclass(frozen=True)
class Axis:
    """Independent series (``keys``) and the order inside each (``order``)."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def w(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def frame(self, first: int, last: int) -> WindowSpec:
        return self.w.rowsBetween(first, last)

    def so_far(self, last: int = 0) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, last)

    def ahead(self, first: int = 0) -> WindowSpec:
        """This row or the ``first``-th after it, and all later ones, for aggregates that no order matters to.

        Ordered backwards: Spark carries a frame that grows on from row to row, but evaluates one that shrinks anew for every row.
        """
        return Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in self.order]).rowsBetween(Window.unboundedPreceding, -first)

    @property
    def whole(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def row(self) -> Column:
        return F.row_number().over(self.w)

    def lag(self, x: Column | str, n: int = 1) -> Column:
        return F.lag(col(x), n).over(self.w)

    def lead(self, x: Column | str, n: int = 1) -> Column:
        return F.lead(col(x), n).over(self.w)

    def gated(self, aggregate, x: Column | str, first: int, last: int) -> Column:
        f = self.frame(first, last)
        return F.when(F.count(col(x)).over(f) == last - first + 1, aggregate(col(x)).over(f))

    def rolling(self, aggregate, x: Column | str, n: int) -> Column:
        """Aggregate over this row and the n-1 before it."""
        return self.gated(aggregate, x, -(n - 1), 0)

    def prior(self, aggregate, x: Column | str, n: int) -> Column:
        """Aggregate over the n rows before this one, excluding it."""
        return self.gated(aggregate, x, -n, -1)

    def mean(self, x: Column | str, n: int) -> Column:
        return self.rolling(F.avg, x, n)


DAILY = Axis(("instrument",), ("session_date",))
# Suspended sessions form their own partition, so they neither advance a window
# nor need a join to be put back on the original axis.
TRADED = Axis(("instrument", "tradable"), ("session_date",))


def known(*columns: Column) -> Column:
    out = columns[0].isNotNull()
    for c in columns[1:]:
        out = out & c.isNotNull()
    return out


def crosses_above(axis: Axis, left, right) -> Column:
    """At or below on the previous row, strictly above now; unknown if any side is."""
    return _crossing(axis, left, right, lambda a, b: a <= b, lambda a, b: a > b)


def crosses_below(axis: Axis, left, right) -> Column:
    return _crossing(axis, left, right, lambda a, b: a >= b, lambda a, b: a < b)


def _crossing(axis: Axis, left, right, before, now) -> Column:
    l_now, r_now = col(left), col(right)
    l_was = axis.lag(l_now)
    r_was = r_now if isinstance(right, (int, float)) else axis.lag(r_now)
    return F.when(known(l_now, r_now, l_was, r_was), before(l_was, r_was) & now(l_now, r_now))
