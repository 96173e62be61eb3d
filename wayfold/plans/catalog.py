"""All queries by name, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

import importlib

_queries: dict = {}
_sql: dict[str, str] = {}

#: Modules that add their queries when they are imported.
MODULES = ("registry", "pass_queries", "area_queries", "trip_queries", "network_queries", "view_queries", "scalar_queries")


def query(oracle: str | None = None):
    """Add a function (spark, sf_dir) -> DataFrame under its name."""

    def add(f):
        _queries[f.__name__] = f
        if oracle:
            _sql[f.__name__] = oracle
        return f

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"wayfold.plans.{name}")


def queries() -> dict:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
