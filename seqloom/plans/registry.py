"""Where the queries of this package are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, tuple[str, str]] = {}


def query(name: str, needs: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the views that ``needs`` names."""
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = needs, sql
        return f

    return add
