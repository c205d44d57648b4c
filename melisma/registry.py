"""Names of the catalog queries and their SQL equivalents."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from melisma.sources.tables import with_roles

_FOUND: dict[str, tuple[Callable, str | None]] = {}
MODULES = ("catalog", "policy", "snapshots", "telemetry", "retrieval", "recommend", "ingest", "surfaces", "pages", "details", "history", "feeds")


def query(name: str, sql: str | None = None):
    """Register a function (spark, path) -> DataFrame, with SQL that gives the same rows."""

    def put(f: Callable) -> Callable:
        _FOUND[name] = (f, with_roles(sql) if sql else None)
        return f

    return put


def _all() -> dict[str, tuple[Callable, str | None]]:
    for m in MODULES:
        importlib.import_module(f"melisma.plans.{m}")
    return _FOUND


def queries() -> dict[str, Callable]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
