"""Registered queries: each operator over stand-ins made from the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

import importlib

from .base import ORACLES, QUERIES

for _name in ("search", "retrieval", "sequences", "analytics", "arena", "changes", "io"):
    importlib.import_module(f"{__name__}.{_name}")

__all__ = ["ORACLES", "QUERIES"]
