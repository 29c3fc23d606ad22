"""Queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of one folder as attributes: ``t.matches``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        """Register a function of ``Tables`` as the query ``name``."""

        def register(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[name] = lambda spark, folder: make(Tables(spark, folder))
            if sql is not None:
                self.oracle[name] = sql
            return make

        return register
