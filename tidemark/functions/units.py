"""Unit labels, their dimension and scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label -> (dimension, scale in the canonical unit).
UNITS = {
    "元": ("cny", 1.0),
    "人民币元": ("cny", 1.0),
    "cny": ("cny", 1.0),
    "rmb": ("cny", 1.0),
    "万元": ("cny", 1e4),
    "亿元": ("cny", 1e8),
    "股": ("shares", 1.0),
    "手": ("shares", 100.0),
    "万股": ("shares", 1e4),
    "%": ("percentage_points", 1.0),
    "百分点": ("percentage_points", 1.0),
    "百分比": ("percentage_points", 1.0),
    "倍": ("multiple", 1.0),
    "1": ("dimensionless", 1.0),
    "无单位": ("dimensionless", 1.0),
}


def _lookup(label: Column, part: int) -> Column:
    pairs = [x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v[part]))]
    return F.create_map(*pairs)[label]


def dimension(label: Column) -> Column:
    """Known dimension, or the label itself: an unknown unit only matches itself."""
    return F.coalesce(_lookup(label, 0), F.concat(F.lit("exact:"), label))


def scale(label: Column) -> Column:
    return F.coalesce(_lookup(label, 1), F.lit(1.0))


def convert(value: Column, source: Column, target: Column) -> Column:
    """Value in the target unit; NULL when the dimensions differ."""
    return F.when(dimension(source) == dimension(target), value * scale(source) / scale(target))


def infer_scale(pairs: DataFrame, keys: list[str], raw: str, shown: str, decimals: int, shown_scale: Column,
                candidates: tuple[float, ...] = (1.0, 1e4, 1e8)) -> DataFrame:
    """The one scale that explains every dated raw/display pair of a key, if at least two support it."""
    slack = 0.5 * 10.0**-decimals
    fits = {
        s: F.bool_and(F.abs(F.col(raw) * s - F.col(shown) * shown_scale) <= slack * shown_scale + 1e-9) for s in candidates
    }
    used = F.count_if((F.col(raw) != 0) & (F.col(shown) != 0))
    g = pairs.groupBy(*keys).agg(used.alias("pairs"), *[f.alias(f"_s{i}") for i, f in enumerate(fits.values())])
    alive = F.array_compact(F.array(*[F.when(F.col(f"_s{i}"), F.lit(s)) for i, s in enumerate(fits)]))
    return g.select(
        *keys, "pairs", F.when((F.col("pairs") >= 2) & (F.size(alive) == 1), F.element_at(alive, 1)).alias("scale")
    )
