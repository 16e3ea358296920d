"""Registered queries: every operator on the given tables, most with the same in SQL."""

import importlib
import pkgutil

from gradeloom.catalog.registry import QUERIES, SQL

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name != "registry"):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["QUERIES", "SQL"]
