"""Ranks over whole periods, exact and without gathering a period in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .scale import top_rows, value_ranks


def competition_rank(df: DataFrame, keys: Sequence[str], col: str, name: str = "rank") -> DataFrame:
    """How many rows of the group have a value at least as large; NULL for a missing value."""
    ranks = value_ranks(df, keys, col).select(*keys, col, (F.col("n_greater") + F.col("n_equal")).alias(name))
    return df.join(ranks, [*keys, col], "left")


def average_rank(df: DataFrame, keys: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """Ascending ranks with ties sharing their mean rank: column -> rank column.

    Columns of one type share one histogram of (column, value), written once, so the input is read
    for it once whatever the number of columns.
    """
    kinds: dict[str, list[str]] = {}
    for col in cols:
        kinds.setdefault(df.schema[col].dataType.simpleString(), []).append(col)
    out = df
    for same in kinds.values():
        each = F.inline(F.array(*[F.struct(F.lit(c).alias("__column"), F.col(c).alias("__value")) for c in same]))
        ranks = value_ranks(df.select(*keys, each), [*keys, "__column"], "__value")
        rank = F.col("n_less") + (F.col("n_equal") + 1) / 2.0
        ranks = materialise(ranks.select(*keys, "__column", "__value", rank.alias("__rank")), "ranks")
        for col in same:
            own = ranks.where(F.col("__column") == col).select(*keys, F.col("__value").alias(col), F.col("__rank").alias(cols[col]))
            out = out.join(own, [*keys, col], "left")
    return out


def argmax_membership(
    df: DataFrame, keys: Sequence[str], item: str, pred: str, actual: str, k: int
) -> DataFrame:
    """Per group: the best item by prediction and by outcome, and whether each is in the other's top ``k``."""
    by_pred = top_rows(df, keys, [F.col(pred).desc(), F.col(item)], k, "rank_pred").select(*keys, item, "rank_pred")
    by_actual = top_rows(df, keys, [F.col(actual).desc(), F.col(item)], k, "rank_actual").select(*keys, item, "rank_actual")
    both = by_pred.join(by_actual, [*keys, item], "full_outer")
    first_pred, first_actual = F.col("rank_pred") == 1, F.col("rank_actual") == 1
    return both.groupBy(*keys).agg(
        F.max(F.when(first_pred, F.col(item))).alias("pred_top"),
        F.max(F.when(first_actual, F.col(item))).alias("actual_top"),
        F.max(F.when(first_pred, F.col("rank_actual").isNotNull().cast("int"))).alias("pred_in_actual_top"),
        F.max(F.when(first_actual, F.col("rank_pred").isNotNull().cast("int"))).alias("actual_in_pred_top"),
    )
