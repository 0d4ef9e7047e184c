"""Collects queries by name, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .relations import Relations


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def keep(f: Callable[[Relations], DataFrame]):
            self.queries[f.__name__] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return keep
