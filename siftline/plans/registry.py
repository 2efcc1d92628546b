"""All queries by name, with their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["triage", "reporting", "retrieval", "graphs", "calibration", "detection", "scans", "streams", "extras"]


def _collect(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        more = getattr(import_module(f"siftline.plans.{name}"), what)
        if both := found.keys() & more.keys():
            raise ValueError(f"named twice: {sorted(both)}")
        found |= more
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("SQL")
