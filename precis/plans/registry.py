"""Registry of named queries: a Spark builder (spark, sf_dir) -> DataFrame and, where
the operator is SQL-expressible at the check scale, its DuckDB oracle SQL over the
driver's views. Column names and types are aligned between the two."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
