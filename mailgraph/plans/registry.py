"""The registered queries: a name, a Spark callable and, where SQL can express it, a DuckDB check query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mailgraph.plans import oracle
from mailgraph.sources.tables import Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``f(tables) -> DataFrame`` under ``name``."""
    def wrap(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if check is not None:
            _CHECKS[name] = check
        return build
    return wrap


def _load() -> None:
    from mailgraph.plans import catalog  # noqa: F401  (registers on import)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def checks() -> dict[str, str]:
    _load()
    return {name: oracle.assemble(sql) for name, sql in _CHECKS.items()}
