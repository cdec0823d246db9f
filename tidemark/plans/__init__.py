"""Registered queries over the driver tables."""

import importlib
import pkgutil

from tidemark.plans.registry import ORACLES, QUERIES

for _m in pkgutil.iter_modules(__path__):
    if _m.name.startswith("q_"):
        importlib.import_module(f"{__name__}.{_m.name}")

__all__ = ["QUERIES", "ORACLES"]
