"""Registered queries by job."""

from __future__ import annotations

import importlib

MODULES = ("kpi", "corpus", "structure", "chunking", "retrieval", "assess", "streams")


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
