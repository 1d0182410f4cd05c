"""The queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

import importlib

MODULES = ("decontaminate", "divergence", "fillmiddle", "htmltext", "langid", "linededup", "mixing", "ngramjoin", "pitmanyor", "quality", "suffixdedup", "toxicity", "warc")


def _gather(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"lexmill.llm.{name}"), kind)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLES")
