"""Connected components of a table of links, by alternating stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every id in ``links`` (a, b): root is the smallest id of its component. Ids without links are not listed."""
    a, b = F.col("a"), F.col("b")
    before, edges = None, links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    while True:
        edges = materialise(_small_star(_large_star(edges)), "edges")
        if before is not None:
            discard(before)
        before = edges
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
            edges.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        open_ = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)")
        if not open_.head(1):  # every id that is not a root has one edge, and it leads to a root
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
