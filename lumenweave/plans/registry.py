"""A table of queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(function: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is there already")
            self.queries[name] = function
            if sql is not None:
                self.oracle[name] = sql
            return function

        return keep
