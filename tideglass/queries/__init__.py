"""Every operator over the driver's tables, by its inventory number, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import importlib

_MODULES = ("metrics", "windows", "models", "ingest", "detection", "loops")


def _all(name: str) -> dict:
    out: dict = {}
    for m in _MODULES:
        out |= getattr(importlib.import_module(f"tideglass.queries.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLES")
