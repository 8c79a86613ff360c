"""Where query modules enter their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .canonical import fact, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *facts: str):
    """Register ``f(t)``, where ``t(name)`` reads a table or projection, with its oracle."""

    def add(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: fact(spark, sf_dir, name))

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = oracle(sql, *facts)
        return f

    return add
