"""Named plans over the stored tables. Importing a module registers its queries."""

from __future__ import annotations

import importlib

from tidemark.plans.registry import QUERIES, SQL

MODULES = ["indicators", "atoms", "outcomes", "joins", "rules", "ledger", "text", "events", "streams"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tidemark.plans.{m}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_sql():
    _load()
    return dict(SQL)
