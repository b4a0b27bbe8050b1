"""Linear recurrences ``y[t] = a*y[t-1] + u[t]`` as window functions.

EMA, Wilder smoothing and KDJ lines are all a discounted running sum of an
impulse ``u`` (zero before the seed row). The series is cut into blocks of 64
rows. Inside a block the sum is a scaled prefix sum; block totals are folded
once per block into the carry that enters it. All windows share the partition
keys of the axis, so the operator adds no shuffle, and no Python worker.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.windows import Axis

BLOCK = 64


def discounted_sums(df: DataFrame, axis: Axis, specs: Mapping[str, tuple[Column, float]], row_no: str) -> DataFrame:
    """Add one column per spec: name -> (impulse, decay). ``row_no`` counts from 1.

    A NULL impulse contributes nothing. A decay of 0 has no memory: the value is the impulse.
    """
    plain = {n: F.coalesce(u, F.lit(0.0)) for n, (u, a) in specs.items() if a == 0}
    if plain:
        df = df.withColumns(plain)
        specs = {n: s for n, s in specs.items() if n not in plain}
        if not specs:
            return df
    for _, a in specs.values():
        if not 1e-4 < a < 1:
            raise ValueError("decay must be 0 or lie strictly between 0.0001 and 1")
    df = df.withColumns(
        {
            "_sup": F.floor((F.col(row_no) - 1) / (BLOCK * BLOCK)),
            "_blk": F.floor((F.col(row_no) - 1) / BLOCK),
            "_pos": ((F.col(row_no) - 1) % BLOCK).cast("double"),
        }
    )
    # all three windows share one sort order
    inside = Window.partitionBy(*axis.keys, "_sup", "_blk").orderBy(row_no).rowsBetween(Window.unboundedPreceding, 0)
    all_rows = (Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = Window.partitionBy(*axis.keys, "_sup").orderBy("_blk", row_no).rowsBetween(*all_rows)
    whole = Window.partitionBy(*axis.keys).orderBy("_sup", "_blk", row_no).rowsBetween(*all_rows)
    df = df.withColumns(
        {
            f"_p_{n}": F.sum(F.coalesce(u, F.lit(0.0)) * F.pow(F.lit(1 / a), F.col("_pos"))).over(inside)
            * F.pow(F.lit(a), F.col("_pos"))
            for n, (u, a) in specs.items()
        }
    )
    df = df.withColumn(
        "_totals",
        F.collect_list(
            F.when(F.col("_pos") == BLOCK - 1, F.struct(*[F.col(f"_p_{n}").alias(n) for n in specs]))
        ).over(blocks),
    )

    def fold(totals: Column, n: str, decay: float) -> Column:
        return F.aggregate(totals, F.lit(0.0), lambda acc, x: acc * F.lit(decay) + x[n])

    nth = F.pmod("_blk", F.lit(BLOCK)).cast("int")
    last = (F.col("_pos") == BLOCK - 1) & (nth == BLOCK - 1)
    df = df.withColumn("_sups", F.collect_list(F.when(last, F.struct(*[fold(F.col("_totals"), n, a**BLOCK).alias(n) for n, (_, a) in specs.items()]))).over(whole))

    def carried(n: str, a: float) -> Column:
        own = fold(F.slice("_totals", F.lit(1), nth), n, a**BLOCK)
        earlier = fold(F.slice("_sups", F.lit(1), F.col("_sup").cast("int")), n, a ** (BLOCK * BLOCK))
        return own + F.pow(F.lit(a**BLOCK), nth) * earlier

    df = df.withColumns(
        {f"_e_{n}": F.when(F.col("_pos") == 0, carried(n, a)) for n, (_, a) in specs.items()}
    ).drop("_totals", "_sups")
    df = df.withColumns({f"_c_{n}": F.first(f"_e_{n}").over(inside) for n in specs})
    df = df.withColumns(
        {
            n: F.col(f"_p_{n}") + F.pow(F.lit(a), F.col("_pos") + 1) * F.col(f"_c_{n}")
            for n, (_, a) in specs.items()
        }
    )
    scratch = [f"_{k}_{n}" for n in specs for k in ("p", "e", "c")]
    return df.drop("_sup", "_blk", "_pos", *scratch)


def ema_impulse(x: Column, alpha: float, row_no: str, seed_row: int = 1) -> Column:
    """Recurrence y = y' + alpha*(x - y') that starts at ``seed_row`` with y = x."""
    r = F.col(row_no)
    return F.when(r == seed_row, x).when(r > seed_row, alpha * x)


def ema(df: DataFrame, axis: Axis, lines: Mapping[str, tuple[str, float]], row_no: str) -> DataFrame:
    """First-value-seeded exponential averages: name -> (input column, alpha)."""
    return discounted_sums(
        df, axis, {n: (ema_impulse(F.col(x), al, row_no), 1 - al) for n, (x, al) in lines.items()}, row_no
    )


def wilder_impulse(x: Column, seed: Column, n: int, row_no: str, seed_row: int) -> Column:
    """Wilder average: ``seed`` at ``seed_row``, then (y*(n-1) + x)/n."""
    r = F.col(row_no)
    return F.when(r == seed_row, seed).when(r > seed_row, x / n)
