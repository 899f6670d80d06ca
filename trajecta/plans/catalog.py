"""Registry of named queries, each with the SQL an independent engine must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register ``query(spark, sf_dir)``; without an oracle only its rows can be checked."""

    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return query

    return add
