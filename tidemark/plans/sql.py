"""SQL fragments of the canonical views, shared by the published queries."""

from __future__ import annotations

PX = "(CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT)) / 100.0"

TICK = "l_orderkey, l_linenumber, l_partkey"  # the order of ticks
TICK_NO = "((CAST(l_orderkey AS HUGEINT) * 10000 + l_linenumber) * 10000000000000000000 + l_partkey)"  # the same order as a number

BARS = f"""bars AS MATERIALIZED (
  SELECT l_suppkey AS instrument, CAST(l_shipdate AS DATE) AS session_date,
         first({PX} ORDER BY {TICK}) AS open,
         max({PX}) AS high, min({PX}) AS low,
         last({PX} ORDER BY {TICK}) AS close,
         sum(l_quantity) AS volume,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount
  FROM lineitem GROUP BY 1, 2)"""

NUMBERED = """v AS (
  SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY session_date) AS rn FROM bars)"""

SUSP = BARS + """, susp AS (
  SELECT * REPLACE (CASE WHEN (instrument + datediff('day', DATE '1970-01-01', session_date)) % 17 = 0
                         THEN 0.0 ELSE volume END AS volume) FROM bars),
v AS (SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY session_date) AS rn
      FROM susp WHERE volume > 0)"""

W = "PARTITION BY instrument ORDER BY session_date"


def roll(fn: str, x: str, n: int) -> str:
    """Full-frame rolling aggregate over this row and the n-1 before it."""
    return frame(fn, x, f"{n - 1} PRECEDING", "CURRENT ROW", n)


def prior(fn: str, x: str, n: int) -> str:
    return frame(fn, x, f"{n} PRECEDING", "1 PRECEDING", n)


def frame(fn: str, x: str, a: str, b: str, n: int) -> str:
    over = f"OVER ({W} ROWS BETWEEN {a} AND {b})"
    return f"CASE WHEN count({x}) {over} = {n} THEN {fn}({x}) {over} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def cross(l: str, r: str, up: bool, const: bool = False) -> str:
    """Crossing of two lines; NULL while any of the four operands is unknown."""
    pl, pr = lag(l), (r if const else lag(r))
    a, b = ("<=", ">") if up else (">=", "<")
    return (f"CASE WHEN {l} IS NOT NULL AND {r} IS NOT NULL AND {pl} IS NOT NULL AND {pr} IS NOT NULL "
            f"THEN {pl} {a} {pr} AND {l} {b} {r} END")


def recur(name: str, src: str, seed: str, step: str, start: str = "s.rn = 1") -> str:
    """Sequential recurrence ``y`` over rows ``s`` of ``src`` numbered by rn."""
    return f"""{name} AS (
  SELECT s.instrument, s.rn, CAST({seed} AS DOUBLE) AS y FROM {src} s WHERE {start}
  UNION ALL
  SELECT s.instrument, s.rn, {step} FROM {name} r JOIN {src} s ON s.instrument = r.instrument AND s.rn = r.rn + 1)"""
