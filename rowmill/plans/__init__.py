"""Registered queries."""

from __future__ import annotations

import importlib

MODULES = ("joins", "rows", "groups", "scalars", "history", "checks", "graphs", "synthetic", "files", "streams")


def load():
    """All registered queries and their SQL, by name."""
    for module in MODULES:
        importlib.import_module(f"rowmill.plans.{module}")
    from rowmill.plans.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
