"""Named queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables."""

    def keep(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, root: f(Tables(spark, root))
        if sql:
            SQL[key] = sql
        return f

    return keep
