"""Registered queries, one module per part of the work."""

from __future__ import annotations

from importlib import import_module

from tidewire.queries.registry import ORACLES, QUERIES

MODULES = ("analysis", "textual", "corpus", "collecting")


def load():
    """All queries and oracles, by name."""
    for module in MODULES:
        import_module(f"tidewire.queries.{module}")
    return QUERIES, ORACLES
