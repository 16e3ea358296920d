"""Operators of a training-data pipeline and their registered queries.

Nothing outside this folder imports it; the driver contract adds its queries only
while the folder is there.
"""

import importlib
import pkgutil

from gradeloom.llm.registry import QUERIES, SQL

for _module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name != "registry"):
    importlib.import_module(f"{__name__}.{_module}")

__all__ = ["QUERIES", "SQL"]
