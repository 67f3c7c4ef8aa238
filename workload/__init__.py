"""Registered queries over the given tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "parsing",
    "catalog",
    "history",
    "lookup",
    "quotas",
    "recovery",
    "levels",
    "display",
    "streams",
)


def registry() -> dict:
    """Name → (callable, SQL or None) over all modules."""
    found: dict = {}
    for name in MODULES:
        for key, entry in import_module(f"workload.{name}").queries.items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = entry
    return found
