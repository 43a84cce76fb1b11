"""Shared helpers: query registration, table reading, size-checked broadcasts, expression bindings."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

#: Characters between words, as the members of a regular expression's class and as a string.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
WORD = rf"[^{SPACE_CLASS}]+"


def query(name: str) -> Callable[[Query], Query]:
    """Register a query."""

    def register(fn: Query) -> Query:
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def same(left: Column, right: Column) -> Column:
    """Equality in which NULL equals NULL."""
    return left.eqNullSafe(right)


def small(df: DataFrame, max_rows: int = 250_000) -> DataFrame:
    """``df``, a written table of a few numbers a row, marked for broadcasting if a count shows that it is small.

    Otherwise it comes back unmarked and Spark joins by shuffling both sides.
    """
    return F.broadcast(df) if df.count() <= max_rows else df
