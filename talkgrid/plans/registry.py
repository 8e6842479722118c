"""The query registry: name -> callable(spark, directory), and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and their SQL, filled by the ``query`` decorator."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function under ``name`` (default: its own name)."""

        def add(fn: Query) -> Query:
            key = name or fn.__name__
            if key in self.queries:
                raise ValueError(f"query {key} is registered twice")
            self.queries[key] = fn
            if sql is not None:
                self.sql[key] = sql
            return fn

        return add
