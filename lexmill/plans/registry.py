"""All queries of the library outside the corpus package."""

from __future__ import annotations

import importlib

MODULES = ("retrieval", "relational", "dashboards", "indexes")


def _gather(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"lexmill.plans.{name}"), kind)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
