"""All registered queries."""

from __future__ import annotations

import importlib

from .registry import ORACLE, QUERIES

MODULES = ["texts", "attributed", "sequences", "statistics", "replay", "models", "further", "live"]


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLE)
