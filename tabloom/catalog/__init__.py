"""Registered queries and their DuckDB counterparts, one module per area."""

from __future__ import annotations

import importlib

from tabloom.catalog import registry

AREAS = (
    "reading", "profiling", "ranking", "cleaning", "series", "encoding", "selecting", "evaluating", "modelling", "forecasting",
    "auditing",
)


def load():
    """All queries and all SQL counterparts."""
    for area in AREAS:
        importlib.import_module(f"tabloom.catalog.{area}")
    return registry.QUERIES, registry.ORACLES
