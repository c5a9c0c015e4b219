"""Queries over the driver's tables."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ["metric_queries", "config_queries", "ingest_queries", "text_queries", "stream_queries"]


def _load() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")


def all_queries():
    _load()
    from .registry import QUERIES

    return dict(QUERIES)


def all_oracles():
    _load()
    from .registry import ORACLES

    return dict(ORACLES)
