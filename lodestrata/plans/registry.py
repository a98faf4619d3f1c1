"""Queries by name, each with the statement it is held against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.made: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function of (spark, folder) under a name."""

        def keep(f: Query) -> Query:
            if name in self.made:
                raise ValueError(f"two queries are called {name}")
            self.made[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return keep
