"""The registered queries of this subpackage: name, Spark callable and, where SQL can express it, a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``f(spark, folder) -> DataFrame`` under ``name``."""
    def wrap(build):
        _QUERIES[name] = build
        if check is not None:
            _CHECKS[name] = check
        return build
    return wrap


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def _load() -> None:
    from mailgraph.llm import (  # noqa: F401  (register on import)
        decontamination, exact_dedup, fill_middle, lm, mixing, near_dedup, packing, pii, quality, ranked_search, substring_dedup, token_counts, toxicity,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def checks() -> dict[str, str]:
    _load()
    return dict(_CHECKS)
