"""Schemas that drift between seasons, and the wide identity map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalise_schema(df: DataFrame, spec: Mapping[str, str], zero_filled: Sequence[str] = ()) -> DataFrame:
    """Exactly the columns of ``spec`` with its types: unreadable values NULL, absent columns NULL.

    A column of ``zero_filled`` that the season lacks altogether is 0 instead.
    """

    def column(name: str, kind: str):
        if name in df.columns:
            return F.col(name).try_cast(kind).alias(name)
        return F.lit(0 if name in zero_filled else None).cast(kind).alias(name)

    return df.select(*[column(n, k) for n, k in spec.items()])


def missing_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row per required column: is it there, and how many rows does it hold?"""
    have = [c for c in required if c in df.columns]
    counts = df.agg(*[F.count(c).alias(c) for c in have], F.count(F.lit(1)).alias("__rows"))
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.lit(c in have).alias("is_present"), (F.col(c) if c in have else F.lit(0).cast("bigint")).alias("n_values"))
        for c in required
    ]
    return counts.select(F.inline(F.array(*rows)))


def unpivot_id_map(df: DataFrame, ids: Sequence[str], season_cols: Sequence[str], order: str) -> DataFrame:
    """Wide identity map to (code.., season, element_id); of repeated (season, element_id) the last row counts."""
    long = df.unpivot([*ids, order], list(season_cols), "season", "element_id").where("element_id is not null")
    kept = long.groupBy("season", "element_id").agg(F.max_by(F.struct(*ids), order).alias("__ids"))
    return kept.select("__ids.*", "season", "element_id")


def lookup_ids(map_df: DataFrame, probes: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """Answer (season, element_id) -> code or (code, season) -> element_id for a table of probes."""
    return probes.join(map_df.select(*on, name), list(on), "left")


def codes_of_season(map_df: DataFrame, season: str) -> DataFrame:
    return map_df.where(F.col("season") == season).select("code").distinct()
