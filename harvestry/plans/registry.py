"""Registering queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from harvestry.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under its name, with SQL that gives the same rows."""

    def put(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return put


class Tables:
    """Tables of one folder by attribute."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self._spark, self._base = spark, base

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self._spark, self._base, name)
