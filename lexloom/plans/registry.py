"""Collects a module's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

            self.queries[f.__name__] = run
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add
