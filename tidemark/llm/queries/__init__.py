"""Registered queries of the package. Importing a module registers its queries."""

from __future__ import annotations

import importlib
import pkgutil

from tidemark.llm.registry import QUERIES, SQL


def load():
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return dict(QUERIES), dict(SQL)
