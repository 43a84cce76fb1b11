"""Training-log lines to metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import col_of
from ..operators.scale import lag_pair

# The two line formats.
EVAL_LINE = r"(\d{2}:\d{2}:\d{2}) \[INFO\] Eval at step (\d+): ([\d.]+) \+/- ([\d.]+) pts \((\d+) episodes\)"
STEP_LINE = r"PPO step (\d+): (.+)"


def parse_eval_lines(df: DataFrame, line: str, keep: Sequence[str] = ()) -> DataFrame:
    g = lambda i: F.regexp_extract(line, EVAL_LINE, i)
    rows = df.where(F.col(line).rlike(EVAL_LINE))
    return rows.select(
        *keep, g(1).alias("time"), g(2).cast("bigint").alias("step"), g(3).try_cast("double").alias("mean"),
        g(4).try_cast("double").alias("std"), g(5).cast("bigint").alias("episodes"),
    )


def parse_metric_lines(df: DataFrame, line: str, metrics: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``key=value | key=value`` lines; a metric the line lacks is NULL."""
    rows = df.where(F.col(line).rlike(STEP_LINE))
    pairs = F.str_to_map(F.regexp_extract(line, STEP_LINE, 2), F.lit(r" \| "), F.lit("="))
    rows = rows.select(*keep, F.regexp_extract(line, STEP_LINE, 1).cast("bigint").alias("step"), pairs.alias("kv"))
    return rows.select(*keep, "step", *[F.trim(F.try_element_at("kv", F.lit(m))).try_cast("double").alias(m) for m in metrics])


def clock_minutes(col: Column | str) -> Column:
    """HH:MM:SS to minutes."""
    p = F.split(col_of(col), ":")
    return (p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("int")) / 60.0


def elapsed_and_rate(df: DataFrame, keys: Sequence[str], order: str, step: str, time: str) -> DataFrame:
    """Minutes since the run's first line, and steps per minute from the line before."""
    timed = df.withColumn("__min", clock_minutes(time))
    base = timed.groupBy(*keys).agg(F.min_by("__min", order).alias("__base"))
    prev = lag_pair(timed, keys, order, [step, "__min"]).join(base, list(keys))
    gap = F.col("__min") - F.col("prev___min")
    return prev.select(
        *df.columns, (F.col("__min") - F.col("__base")).alias("elapsed"),
        F.try_divide(F.col(step) - F.col(f"prev_{step}"), gap).alias("rate"),
    )
