"""Registered queries and end-to-end jobs."""

from __future__ import annotations

import importlib
import importlib.util

from bankspark.plans.registry import QUERIES, Query

MODULES = [
    "reports", "ranking", "profiling", "cleaning", "scalars", "joins", "campaign", "customers",
    "fraud", "models", "clusters", "files", "streams", "facts",
]


def all_queries() -> dict[str, Query]:
    """Every registered query, in a fixed order."""
    for module in MODULES:
        if importlib.util.find_spec(f"bankspark.plans.{module}"):
            importlib.import_module(f"bankspark.plans.{module}")
    return dict(QUERIES)
