"""Where queries and their SQL are put down side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries whose SQL shares a beginning (common table expressions)."""

    def __init__(self, start: str = ""):
        self.start, self.queries, self.sql = start, {}, {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the function below as ``name``; ``sql`` follows the shared beginning."""

        def put(f: Query) -> Query:
            assert name not in self.queries, name
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = self.start + sql
            return f

        return put
