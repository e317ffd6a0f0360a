"""All queries and their comparison SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("warehouse_queries", "sink_queries", "clv_queries", "panel_queries", "causal_queries", "decision_queries")


def _merge(attribute: str) -> dict:
    merged = {}
    for name in MODULES:
        part = getattr(import_module(f"tallyfield.plans.{name}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"query names used twice: {sorted(clash)}")
        merged.update(part)
    return merged


def all_queries() -> dict:
    return _merge("QUERIES")


def all_oracles() -> dict:
    return _merge("ORACLES")
