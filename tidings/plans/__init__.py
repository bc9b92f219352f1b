"""Registered queries (key -> Spark builder + oracle SQL)."""

from __future__ import annotations

import importlib

CATALOGS = (
    "catalog_stats",
    "catalog_news",
    "catalog_functions",
    "catalog_sectors",
    "catalog_rollups",
    "catalog_scoring",
    "catalog_ingest",
    "catalog_writes",
    "catalog_streaming",
)


def load_all():
    from .registry import REGISTRY

    for mod in CATALOGS:
        importlib.import_module(f"{__name__}.{mod}")
    return REGISTRY
