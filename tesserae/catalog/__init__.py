"""Registered queries over the given tables, each with its SQL check."""

from __future__ import annotations

from importlib import import_module

MODULES = ("samples", "geometry", "joins", "aggregates", "windows", "sources", "agent", "streaming")


def all_queries() -> tuple[dict, dict]:
    """(queries, SQL checks) by name."""
    for name in MODULES:
        import_module(f"tesserae.catalog.{name}")
    registry = import_module("tesserae.catalog.registry")
    return registry.QUERIES, registry.CHECKS
