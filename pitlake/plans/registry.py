"""Catalogue of queries: name -> Spark callable, with the DuckDB statement that must agree."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from .binding import CTES

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query. ``@NAME`` in the SQL stands for a shared common table expression."""

    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            text = sql
            for token in sorted(CTES, key=len, reverse=True):
                text = text.replace("@" + token, CTES[token])
            ORACLES[name] = text.strip()
        return fn

    return register
