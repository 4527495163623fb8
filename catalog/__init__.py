"""Registered queries: each Spark query next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir) -> DataFrame`` under ``name``."""
    def add(f):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return add


def load_all() -> None:
    from catalog import baseline, blocking, cluster, learn, matching, prepare, search, significance, sources, trials  # noqa: F401
