"""Every registered query with its SQL oracle, gathered from the modules of this package."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quireworks.sources.views import Tables, with_views

MODULES = ("catalog", "search", "texts", "series", "upkeep", "flows")
_FOUND: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register a function of Tables under an operator's id, with the same result in DuckDB's SQL over the named views."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _FOUND:
            raise ValueError(f"{name} is registered twice")
        _FOUND[name] = f, with_views(sql, views.split()) if sql else None
        return f

    return add


def _all() -> dict[str, tuple[Callable[[Tables], DataFrame], str | None]]:
    for module in MODULES:
        importlib.import_module(f"quireworks.plans.{module}")
    return _FOUND


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
