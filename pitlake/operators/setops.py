"""Top-k, unions and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scale import top_rows


def top_k(df: DataFrame, col: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(col).desc_nulls_last(), F.col(tie)).limit(k)


def union_seasons(*dfs: DataFrame) -> DataFrame:
    """Union by name; a column one side lacks is NULL there."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key by a total order."""
    return top_rows(df, keys, [F.col(c).asc() for c in order], 1, "__first").drop("__first")


def membership_diff(df: DataFrame, owner: str, period: str, member: str) -> DataFrame:
    """Members that joined (``in``) or left (``out``) since the owner's previous period.

    Each membership is sent to its own period and to the next one; whatever shows up on one side
    only has changed. One shuffle, no per-owner sets.
    """
    periods = df.select(owner, period).distinct()
    w = Window.partitionBy(owner).orderBy(period)
    nxt = periods.withColumns({"__next": F.lead(period).over(w), "__first": F.lag(period).over(w).isNull()})
    rows = df.select(owner, period, member).distinct().join(nxt, [owner, period])
    sides = F.array(
        F.struct(F.when(~F.col("__first"), F.col(period)).alias("p"), F.lit(1).alias("now"), F.lit(0).alias("before")),
        F.struct(F.col("__next").alias("p"), F.lit(0).alias("now"), F.lit(1).alias("before")),
    )
    sent = rows.select(owner, member, F.inline(sides)).where("p is not null")
    both = sent.groupBy(owner, F.col("p").alias(period), member).agg(F.max("now").alias("now"), F.max("before").alias("before"))
    changed = both.where(F.col("now") != F.col("before"))
    return changed.select(owner, period, member, F.when(F.col("now") == 1, "in").otherwise("out").alias("change"))


def available(required: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """The required keys that are present."""
    return required.select(*on).intersect(present.select(*on))
