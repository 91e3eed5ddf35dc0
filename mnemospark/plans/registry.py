"""All queries of the core, with the SQL that states the same result."""

from __future__ import annotations

import importlib

MODULES = ("hierarchy_queries", "store_queries", "feedback_queries", "retrieval_queries", "metric_queries", "feature_queries", "recall_queries", "label_queries", "upkeep_queries", "stream_queries")


def _merged(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"mnemospark.plans.{name}"), what)
        if twice := found.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        found |= part
    return found


def queries() -> dict:
    return _merged("QUERIES")


def sql() -> dict[str, str]:
    return _merged("SQL")
