"""Condition trees over studies and facts, compiled into nullable boolean Columns."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import kleene
from tidemark.functions.windows import TRADED, Axis
from tidemark.operators.indicators import ABOVE_ZERO, BOUNDS, CATALOG, ORDERED, VALUES, evaluate


@dataclass(frozen=True)
class Indicator:
    id: str
    trigger: str
    value: float | None = None
    params: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Known:
    """A boolean column already on the frame: a fact or event leaf."""

    column: str


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


def check(leaf: Indicator) -> None:
    """Reject unknown studies, triggers and parameters and wrong types before a plan is built."""
    if leaf.id not in CATALOG:
        raise ValueError(f"unknown study {leaf.id}")
    s = CATALOG[leaf.id]
    if leaf.trigger not in s.triggers:
        raise ValueError(f"study {leaf.id} has no trigger {leaf.trigger}")
    if (leaf.value is None) == (leaf.trigger in s.valued):
        need = "requires" if leaf.trigger in s.valued else "takes no"
        raise ValueError(f"trigger {leaf.trigger} of {leaf.id} {need} comparison value")
    if leaf.value is not None:
        low, high = VALUES.get(leaf.id, (None, None))
        outside = (low is not None and leaf.value < low) or (high is not None and leaf.value > high)
        if isinstance(leaf.value, bool) or outside or (leaf.id in ABOVE_ZERO and leaf.value == 0):
            raise ValueError(f"value {leaf.value} is out of range for {leaf.id}")
    bounds = BOUNDS.get(leaf.id, {})
    for name, v in leaf.params.items():
        if name not in s.defaults:
            raise ValueError(f"study {leaf.id} has no parameter {name}")
        if name == "price_field":
            if v not in ("open", "high", "low", "close"):
                raise ValueError(f"unsupported price field {v}")
            continue
        kinds = (int,) if isinstance(s.defaults[name], int) else (int, float)
        if isinstance(v, bool) or not isinstance(v, kinds):
            raise ValueError(f"parameter {name} of {leaf.id} has the wrong type")
        low, high = bounds[name]
        if not low <= v <= high:
            raise ValueError(f"parameter {name} of {leaf.id} must lie between {low} and {high}")
    p = {**s.defaults, **leaf.params}
    for small, large in ORDERED:
        if small in p and large in p and not p[small] < p[large]:
            raise ValueError(f"{small} must be less than {large}")
    if "min_separation" in p and p["min_separation"] > p["max_separation"]:
        raise ValueError("min_separation cannot exceed max_separation")


def leaves(node) -> list[Indicator]:
    if isinstance(node, Indicator):
        return [node]
    if isinstance(node, (All, Any)):
        return [x for part in node.parts for x in leaves(part)]
    return leaves(node.part) if isinstance(node, Not) else []


def with_condition(bars: DataFrame, tree, out: str, axis: Axis = TRADED) -> DataFrame:
    """Evaluate each distinct leaf once, then combine the leaves with three-valued logic."""
    base = list(bars.columns)
    names: dict[tuple, str] = {}
    df = bars
    for leaf in leaves(tree):
        check(leaf)
        key = (leaf.id, leaf.trigger, leaf.value, tuple(sorted(leaf.params.items())))
        if key in names:
            continue
        names[key] = f"_leaf{len(names)}"
        done = evaluate(df, leaf.id, (leaf.trigger,), leaf.value, axis, **leaf.params)
        df = done.withColumn(names[key], F.col(leaf.trigger)).select(*base, *names.values())

    def build(node) -> Column:
        if isinstance(node, Indicator):
            return F.col(names[(node.id, node.trigger, node.value, tuple(sorted(node.params.items())))])
        if isinstance(node, Known):
            return F.col(node.column)
        if isinstance(node, All):
            return kleene.all_of(*[build(x) for x in node.parts])
        if isinstance(node, Any):
            return kleene.any_of(*[build(x) for x in node.parts])
        return kleene.none_of(build(node.part))

    return df.withColumn(out, build(tree)).select(*base, out)
