"""Three-valued condition algebra: unknown is NULL and never collapses to false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def none_of(condition: Column) -> Column:
    return ~condition


def compare(op: str, left: Column, right: Column) -> Column:
    return {
        "gt": lambda: left > right,
        "gte": lambda: left >= right,
        "lt": lambda: left < right,
        "lte": lambda: left <= right,
        "eq": lambda: left == right,
        "ne": lambda: left != right,
    }[op]()


def latest_known(*times: Column) -> Column:
    """A combined condition becomes known with the last of its known parts."""
    return F.greatest(*times)


def merged_evidence(*lists: Column) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(x, F.array()) for x in lists]))))
