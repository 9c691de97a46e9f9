"""All queries of the engine with their SQL.  The modules named below register their own with ``query``."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = ("retrieval_queries", "matching_queries", "text_queries", "parsing_queries", "statistics_queries", "experiment_queries", "compact_queries", "diagram_queries")


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under ``name``, with SQL for DuckDB if there is any."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"lodestone.plans.{m}")


load()
