"""A registry of queries and SQL twins for one module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self, *fixtures: str) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}
        self._fixtures = fixtures

    def add(self, name: str, query: Query, sql: str | None = None, *fixtures: str) -> None:
        """``sql`` continues a WITH clause of the fixtures: either further ``name AS (...)`` parts and a
        SELECT after an arrow, or a SELECT alone."""
        self.queries[name] = query
        if sql is not None:
            parts, _, select = sql.rpartition("-->")
            ctes = ",\n".join([*(fixtures or self._fixtures), *([parts.strip().rstrip(",")] if parts.strip() else [])])
            self.oracles[name] = (f"WITH {ctes}\n" if ctes else "") + select.strip()
