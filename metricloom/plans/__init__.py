"""Job plans and the catalogue of named queries."""

from __future__ import annotations

import importlib

SECTIONS = ["parsing", "storage", "aggregates", "statistics", "relations", "comparison", "flows", "synthesis", "spaces", "summaries"]


def load_all() -> None:
    """Import every section so that its queries register."""
    for name in SECTIONS:
        importlib.import_module(f"metricloom.plans.{name}")
