"""Registered queries over the given tables, each with its checking SQL."""

from __future__ import annotations


def load():
    """All registered queries by name."""
    from logweir.catalog import (  # noqa: F401
        event_queries,
        file_queries,
        record_queries,
        schedule_queries,
        stream_queries,
        tree_queries,
    )
    from logweir.catalog.registry import REGISTRY

    return REGISTRY
