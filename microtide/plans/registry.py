"""All registered queries with their DuckDB counterparts."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
MODULES = ("market", "reference_data", "features", "models", "book_block", "reports", "research", "live", "grid", "news", "desk")


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir); ``sql`` is None where SQL can't express it."""

    def add(f: Callable) -> Callable:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"microtide.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
