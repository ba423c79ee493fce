"""Queries by name. Each module of this package registers its own."""

from __future__ import annotations

import importlib
import pkgutil

from veilframe.plans.registry import ORACLE, QUERIES, Query


def _load() -> None:
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
