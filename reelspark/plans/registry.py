"""Registration of domain queries: a function of a ``Domain``, with its SQL if there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .domain import BASE_SQL, Domain


class Registry:
    """Queries of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        """Register a function ``f(domain) -> frame`` under its name; ``sql`` continues ``BASE_SQL``."""

        def add(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
            self.queries[f.__name__] = lambda spark, d: f(Domain(spark, d))
            if sql:
                self.sql[f.__name__] = BASE_SQL + sql
            return f

        return add
