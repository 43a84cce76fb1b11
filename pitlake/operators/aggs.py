"""Aggregations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import col_of, pearson, share
from .scale import spread_join, top_rows


def pre_aggregate(
    df: DataFrame, keys: Sequence[str], sums: Sequence[str], lasts: Sequence[str] = (), order: str | None = None
) -> DataFrame:
    """One row per key: sums (0 when all values are missing) and the last known value by ``order``."""
    return df.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in lasts],
    )


def target(df: DataFrame, keys: Sequence[str], col: str, name: str = "target") -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.sum(col), F.lit(0)).alias(name))


def period_lookup(df: DataFrame, keys: Sequence[str], sums: Sequence[str], firsts: Sequence[str], order: str) -> DataFrame:
    """Merged view of several rows per key: counts add up, prices and ratings are those of the first row, NULL included."""
    return df.groupBy(*keys).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        *[F.min_by(c, order).alias(c) for c in firsts],
    )


def period_cutoffs(
    df: DataFrame, keys: Sequence[str], period: str, ts: str | None, base: str = "2020-01-01", name: str = "cutoff"
) -> DataFrame:
    """Earliest timestamp per period; with no timestamp column, weekly dates counted from ``base``."""
    if ts is not None:
        return df.groupBy(*keys, period).agg(F.min(ts).alias(name))
    weekly = F.date_add(F.lit(base).cast("date"), (7 * (F.col(period) - 1)).cast("int")).cast("timestamp")
    return df.select(*keys, period).distinct().withColumn(name, weekly)


def period_average(df: DataFrame, keys: Sequence[str], col: str, name: str = "period_avg") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(col).alias(name))


def two_level(df: DataFrame, inner: Sequence[str], outer: Sequence[str], col: str, name: str) -> DataFrame:
    """Maximum inside each inner key, summed over the outer key."""
    peak = df.groupBy(*inner).agg(F.max(col).alias("__peak"))
    return peak.groupBy(*outer).agg(F.sum("__peak").alias(name))


def double_flag(df: DataFrame, keys: Sequence[str], fixture: str) -> DataFrame:
    """Number of distinct fixtures per key, and whether there is more than one."""
    counts = df.select(*keys, fixture).distinct().groupBy(*keys).agg(F.count(fixture).alias("n_fixtures"))
    return counts.withColumn("is_double", (F.col("n_fixtures") > 1).cast("double"))


def schedule_flags(fixtures: DataFrame, keys: Sequence[str], sides: Sequence[str], team: str = "team") -> DataFrame:
    """Fixtures per (period, team) over every period and every team of the period's season.

    The complement comes from expanding each team over its season's list of periods.
    """
    season, period = keys
    played = (
        fixtures.withColumn(team, F.explode(F.array(*sides)))
        .groupBy(season, period, team)
        .agg(F.count(F.lit(1)).alias("n_fixtures"))
    )
    periods = played.groupBy(season).agg(F.collect_set(period).alias("__periods"))
    grid = (
        spread_join(played.select(season, team).distinct(), periods, [season], [team]).select(season, team, F.explode("__periods").alias(period))
    )
    full = grid.join(played, [season, period, team], "left").fillna(0, ["n_fixtures"])
    return full.withColumns({"is_double": F.col("n_fixtures") > 1, "is_blank": F.col("n_fixtures") == 0})


def average_fixtures(df: DataFrame, keys: Sequence[str], means: Sequence[str], maxes: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in means], *[F.max(c).alias(c) for c in maxes])


def average_probs(
    df: DataFrame, keys: Sequence[str], win: str = "win_prob", draw: str = "draw_prob", loss: str = "loss_prob"
) -> DataFrame:
    """Mean probabilities over a key's fixtures and strength = win - loss."""
    out = df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in (win, draw, loss)])
    return out.withColumn("strength", F.col(win) - F.col(loss))


def per90(df: DataFrame, minutes: str, cols: Sequence[str], min_minutes: float = 90, full: float = 90.0) -> DataFrame:
    """Rates per full match, NULL below the minimum exposure."""
    played = F.col(minutes)
    return df.withColumns(
        {f"{c}_per90": F.when(played >= min_minutes, F.col(c) / (played / F.lit(full))) for c in cols}
    )


def set_piece_flags(df: DataFrame, cols: dict[str, str], max_order: int = 2) -> DataFrame:
    """Order column -> 0/1 flag; a column the table lacks gives NULL. The sum skips NULL flags."""
    present = [c for c in cols if c in df.columns]
    flags = {
        name: F.coalesce((F.col(c) <= max_order).cast("double"), F.lit(0.0)) if c in present else F.lit(None).cast("double")
        for c, name in cols.items()
    }
    total = F.lit(0.0)
    for c in present:
        total = total + F.col(cols[c])
    out = df.withColumns(flags)
    return out.withColumn("order_sum", total if present else F.lit(None).cast("double"))


def detect_gaps(df: DataFrame, keys: Sequence[str], col: str, activity: str) -> DataFrame:
    """Periods where a value is zero throughout although there was activity."""
    totals = df.groupBy(*keys).agg(F.sum(col).alias(f"sum_{col}"), F.sum(activity).alias(f"sum_{activity}"))
    return totals.where((F.col(f"sum_{col}") == 0) & (F.col(f"sum_{activity}") > 0))


def coverage(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Long table (by, column, rows, missing, missing_share), from one pass over the data."""
    wide = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols]
    )
    long = wide.unpivot([*by, "n_rows"], list(cols), "column_name", "n_missing")
    return long.withColumn("missing_share", F.col("n_missing") / F.col("n_rows"))


def valid_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Share of values that read as numbers, per column, against a threshold."""
    wide = df.agg(*[share(F.col(c).try_cast("double").isNotNull()).alias(c) for c in cols])
    long = wide.unpivot([], list(cols), "column_name", "numeric_share")
    return long.withColumn("is_valid", F.col("numeric_share") > threshold)


def best_column(df: DataFrame, candidates: Sequence[str], name: str, threshold: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """The first candidate whose share of numeric values reaches the threshold, as doubles.

    One candidate serves the whole table (or the whole ``by`` group), not row by row.
    """
    gates = df.groupBy(*by).agg(
        *[share(F.col(c).try_cast("double").isNotNull()).alias(f"__g_{c}") for c in candidates]
    )
    pick = F.coalesce(*[F.when(F.col(f"__g_{c}") >= threshold, F.lit(c)) for c in candidates])
    gates = gates.select(*by, pick.alias("chosen"))
    out = spread_join(df, gates, by, candidates, "left") if by else df.withColumn("chosen", gates.select("chosen").scalar())
    value = F.coalesce(*[F.when(F.col("chosen") == c, F.col(c).try_cast("double")) for c in candidates])
    return out.withColumn(name, value)


def column_ladder(df: DataFrame, steps: Sequence[tuple[str, Sequence[str], Sequence[str], Sequence[str]]], name: str, threshold: float = 0.1) -> DataFrame:
    """A value from the first usable step of a ladder, for the whole table, and ``chosen``, the step's name.

    A step is (name, gated, required, optional) columns. It is usable if each gated column's share of
    numeric values reaches the threshold. Its value is the sum of all its columns, NULL where a gated or
    required one is not numeric; an optional one then counts 0.
    """
    number = lambda c: F.col(c).try_cast("double")
    usable = [(step, [share(number(c).isNotNull()) >= threshold for c in gated]) for step, gated, _, _ in steps]
    pick = F.coalesce(*[F.when(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(step)) for step, tests in usable])
    out = df.withColumn("chosen", df.agg(pick.alias("chosen")).scalar())
    total = lambda gated, required, optional: reduce(
        lambda a, b: a + b, [*map(number, [*gated, *required]), *[F.coalesce(number(c), F.lit(0.0)) for c in optional]])
    return out.withColumn(name, F.coalesce(*[F.when(F.col("chosen") == step, total(*parts)) for step, *parts in steps]))


def feature_target_corr(df: DataFrame, cols: Sequence[str], target_col: str, min_n: int = 100) -> DataFrame:
    """Correlation of every feature with the target, for features with more than ``min_n`` valid rows."""
    known = F.col(target_col).isNotNull()
    wide = df.agg(
        *[F.struct(pearson(c, target_col).alias("corr"), F.count(F.when(known, F.col(c))).alias("n")).alias(c) for c in cols]
    )
    long = wide.unpivot([], list(cols), "feature", "m")
    return long.select("feature", F.col("m.n").alias("n"), F.col("m.corr").alias("corr")).where(F.col("n") > min_n)


def summarise(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Total, mean, population deviation, extremes."""
    return df.groupBy(*by).agg(
        F.count(col).alias("n"),
        F.sum(col).alias("total"),
        F.avg(col).alias("mean"),
        F.stddev_pop(col).alias("std"),
        F.min(col).alias("lowest"),
        F.max(col).alias("highest"),
    )


def extremes(df: DataFrame, by: Sequence[str], col: str, tie: str, k: int = 5) -> DataFrame:
    """The ``k`` best and ``k`` worst rows per group, ranked within their side."""
    best = top_rows(df, by, [F.col(col).desc(), F.col(tie)], k).withColumn("side", F.lit("top"))
    worst = top_rows(df, by, [F.col(col).asc(), F.col(tie)], k).withColumn("side", F.lit("bottom"))
    return best.unionByName(worst)


def linear_fit(df: DataFrame, x: str | Column, y: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Ordinary least squares with one regressor, from the moments of the two columns."""
    x, y = col_of(x), col_of(y)
    both = x.isNotNull() & y.isNotNull()
    dx, dy = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    m = df.groupBy(*by).agg(
        F.count(F.when(both, 1)).alias("n"),
        F.avg(dx).alias("__mx"), F.avg(dy).alias("__my"),
        F.var_pop(dx).alias("__vx"), F.var_pop(dy).alias("__vy"), F.covar_pop(dx, dy).alias("__xy"),
    )
    slope = F.try_divide("__xy", "__vx")
    r2 = F.try_divide(F.col("__xy") * F.col("__xy"), F.col("__vx") * F.col("__vy"))
    return m.select(*by, "n", slope.alias("slope"), (F.col("__my") - slope * F.col("__mx")).alias("intercept"), r2.alias("r2"))


def value_counts(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Row count per value, NULL included."""
    return df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
