"""Operators for training-data pipelines and their registered queries."""

from __future__ import annotations


def llm_queries() -> tuple[dict, dict]:
    """(queries, SQL checks) by name."""
    from tesserae.llm import queries

    return dict(queries.QUERIES), dict(queries.CHECKS)
