"""Evaluation of predictions and leakage audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pearson, share
from .ranks import argmax_membership, average_rank
from .scale import spread_join, top_rows


def error_metrics(df: DataFrame, pred: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, mean absolute and root mean squared error, correlation."""
    err = F.col(actual) - F.col(pred)
    return df.groupBy(*by).agg(
        F.count(err).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"), pearson(pred, actual).alias("corr")
    )


def error_metrics_sets(df: DataFrame, pred: str, actual: str, sets: Sequence[str]) -> DataFrame:
    """Overall metrics and one block per grouping column, long, from a single pass."""
    tags = F.array(
        F.struct(F.lit("overall").alias("level"), F.lit("all").alias("key")),
        *[F.struct(F.lit(c).alias("level"), F.col(c).cast("string").alias("key")) for c in sets],
    )
    rows = df.select(pred, actual, F.inline(tags))
    return error_metrics(rows, pred, actual, ["level", "key"])


def period_corr(df: DataFrame, period: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*period).agg(F.count(F.lit(1)).alias("n"), pearson(x, y).alias("corr"))


def mean_period_corr(df: DataFrame, period: Sequence[str], x: str, y: str, min_n: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Mean and median of the per-period correlations; periods of at most ``min_n`` rows do not count."""
    per = period_corr(df, [*by, *period], x, y).where((F.col("n") > min_n) & F.col("corr").isNotNull())
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_periods"), F.avg("corr").alias("mean_corr"), F.percentile("corr", F.lit(0.5)).alias("median_corr")
    )


def mean_period_spearman(df: DataFrame, period: Sequence[str], x: str, y: str, min_n: int = 10) -> DataFrame:
    """Mean per-period rank correlation over periods of more than ``min_n`` rows."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*period, x, y)
    ranked = average_rank(known, period, {x: "__rx", y: "__ry"})
    return mean_period_corr(ranked, period, "__rx", "__ry", min_n)


def threshold_means(df: DataFrame, pred: str, actual: str, thr: float) -> DataFrame:
    """Mean prediction for outcomes at or above the threshold and below it."""
    high = F.col(actual) >= thr
    return df.agg(
        F.count(F.when(high, 1)).alias("n_high"), F.avg(F.when(high, F.col(pred))).alias("mean_pred_high"),
        F.count(F.when(~high, 1)).alias("n_low"), F.avg(F.when(~high, F.col(pred))).alias("mean_pred_low"),
    )


def tolerance_shares(df: DataFrame, x: str, y: str, strict: Sequence[float], loose: Sequence[float] = (), by: Sequence[str] = ()) -> DataFrame:
    """Share of absolute differences below (``strict``) or up to (``loose``) each tolerance, in long form."""
    diff = F.abs(F.col(x) - F.col(y))
    tests = [(f"<{t:g}", diff < t) for t in strict] + [(f"<={t:g}", diff <= t) for t in loose]
    wide = df.groupBy(*by).agg(*[share(cond).alias(f"__{i}") for i, (_, cond) in enumerate(tests)])
    rows = [F.struct(F.lit(name).alias("tolerance"), F.col(f"__{i}").alias("share")) for i, (name, _) in enumerate(tests)]
    return wide.select(*by, F.inline(F.array(*rows)))


def zero_confusion(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement on zero between a reference ``x`` and an estimate ``y``."""
    n = lambda cond: F.count(F.when(cond, 1))
    a, b = F.col(x), F.col(y)
    return df.groupBy(*by).agg(
        n((a == 0) & (b == 0)).alias("both_zero"), n((a > 0) & (b == 0)).alias("false_negative"),
        n((a == 0) & (b > 0)).alias("false_positive"), n(a == 0).alias("n_zero"),
    )


def leaderboard(
    df: DataFrame, variant: str, value: str, ref: str, actual: str, period: Sequence[str], base: str, min_n: int = 20
) -> DataFrame:
    """One row of metrics per variant, plus the reference scored against itself.

    ``df`` holds one row per (variant, row); the rows of variant ``base`` also stand for the
    reference. Overall and per-period figures come from one pass with two grouping sets.
    """
    own = F.struct(F.col(variant).alias("v"), F.col(value).cast("double").alias("x"))
    reference = F.struct(F.lit("reference").alias("v"), F.col(ref).cast("double").alias("x"))
    both = F.when(F.col(variant) == base, F.array(own, reference)).otherwise(F.array(own))
    rows = df.select(*period, ref, actual, F.inline(both))
    diff = F.abs(F.col("x") - F.col(ref))
    cells = rows.groupingSets([["v", *period], ["v"]], "v", *period).agg(
        F.grouping_id().alias("__level"), F.count(F.lit(1)).alias("__n"),
        pearson("x", ref).alias("corr_ref"), F.avg(diff).alias("mae_ref"), pearson("x", actual).alias("corr_actual"),
        share(diff < 0.01).alias("exact"), share(diff <= 0.5).alias("within_05"), share(diff <= 1.0).alias("within_10"),
    )
    overall = F.col("__level") > 0
    metrics = ["corr_ref", "mae_ref", "corr_actual", "exact", "within_05", "within_10"]
    return cells.groupBy(F.col("v").alias(variant)).agg(
        *[F.max(F.when(overall, F.col(m))).alias(m) for m in metrics],
        F.avg(F.when(~overall & (F.col("__n") > min_n), F.col("corr_actual"))).alias("period_corr"),
    )


def gap_closed(board: DataFrame, variant: str, baseline: str, reference: str = "reference", metric: str = "period_corr") -> DataFrame:
    """The best variant and the share of the baseline's distance to the reference it closes."""
    tested = (F.col(variant) != reference) & F.col(metric).isNotNull()
    pick = lambda name: F.max(F.when(F.col(variant) == name, F.col(metric)))
    best = F.max(F.when(tested, F.struct(F.col(metric), F.col(variant))))
    row = board.agg(pick(reference).alias("reference"), pick(baseline).alias("baseline"), best.alias("__best"))
    closed = F.col(f"__best.{metric}") - F.col("baseline")
    return row.select(
        F.col(f"__best.{variant}").alias("best"), F.col(f"__best.{metric}").alias("best_value"), "baseline", "reference",
        closed.alias("gap_closed"), F.try_divide(closed, F.col("reference") - F.col("baseline")).alias("share_closed"),
    )


def captain_hit_rate(df: DataFrame, period: Sequence[str], item: str, pred: str, actual: str, n: int = 11, k: int = 3) -> DataFrame:
    """How often the top prediction among the ``n`` best predicted is the best, or in the best ``k``, by outcome.

    A blind pick among ``n`` succeeds with probability 1/n, the expectation of a random draw.
    """
    squad = top_rows(df, period, [F.col(pred).desc(), F.col(item)], n, "__place")
    full = squad.groupBy(*period).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == n)
    hits = argmax_membership(squad.join(full, list(period), "left_semi"), period, item, pred, actual, k)
    return hits.agg(
        F.count(F.lit(1)).alias("n_periods"), share(F.col("pred_top") == F.col("actual_top")).alias("hit_rate"),
        share(F.col("pred_in_actual_top") == 1).alias("top_k_rate"), F.lit(1.0 / n).alias("random_rate"),
    )


def lookahead_flag(df: DataFrame, pred: str, actual: str, period: Sequence[str], tol: float = 0.01, limit: float = 0.5) -> DataFrame:
    """Periods where more than ``limit`` of the predictions equal the outcome."""
    close = share(F.abs(F.col(pred) - F.col(actual)) < tol)
    return df.groupBy(*period).agg(close.alias("share_equal")).withColumn("suspicious", F.col("share_equal") > limit)


def compare_variants(metrics: DataFrame, keys: Sequence[str], variant: str, a: str, b: str, cols: Sequence[str]) -> DataFrame:
    """Metric values of two variants and their difference (b - a), one row per key."""
    pick = lambda v, c: F.max(F.when(F.col(variant) == v, F.col(c)))
    wide = metrics.groupBy(*keys).agg(*[pick(v, c).alias(f"{c}_{v}") for c in cols for v in (a, b)])
    return wide.withColumns({f"{c}_delta": F.col(f"{c}_{b}") - F.col(f"{c}_{a}") for c in cols})


def outcome_split(df: DataFrame, cond: Column, x: str, y: str, name: str = "played") -> DataFrame:
    """Correlation, mean estimate and share of zero estimates for rows that meet a condition and the rest."""
    return df.groupBy(cond.alias(name)).agg(
        F.count(F.lit(1)).alias("n"), pearson(x, y).alias("corr"), F.avg(x).alias("mean_x"), share(F.col(x) == 0).alias("zero_rate")
    )


def retention(df: DataFrame, required: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows in total, and rows left once the required columns are known."""
    complete = F.lit(True)
    for c in required:
        complete = complete & F.col(c).isNotNull()
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), F.count(F.when(complete, 1)).alias("n_usable"))
    return out.withColumn("usable_share", F.try_divide("n_usable", "n_total"))


def importance_groups(df: DataFrame, feature: str, importance: str, groups: dict[str, Sequence[str]], other: str = "other") -> DataFrame:
    """Share of total importance per feature group; a group lists name fragments, the first match counts."""
    label = F.lit(other)
    for name, parts in reversed(list(groups.items())):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.col(feature).contains(p)
        label = F.when(hit, F.lit(name)).otherwise(label)
    total = df.agg(F.sum(importance)).scalar()
    sums = df.withColumn("feature_group", label).groupBy("feature_group").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum(importance).alias("importance"))
    return sums.withColumn("share", F.try_divide(F.col("importance"), total))


def period_summary(df: DataFrame, period: Sequence[str], pred: str, actual: str) -> DataFrame:
    """Calibration per period: mean outcome, mean prediction, mean absolute error."""
    err = F.abs(F.col(actual) - F.col(pred))
    return df.groupBy(*period).agg(
        F.count(F.lit(1)).alias("n"), F.avg(actual).alias("mean_actual"), F.avg(pred).alias("mean_pred"), F.avg(err).alias("mae")
    )


def median_period_top(
    df: DataFrame, scope: Sequence[str], period: str, item: str, pred: str, names: DataFrame, k: int = 10
) -> DataFrame:
    """Best ``k`` predictions of each scope's median period, with names."""
    mid = df.select(*scope, period).distinct().groupBy(*scope).agg(F.floor(F.percentile(period, F.lit(0.5))).alias(period))
    rows = spread_join(df, mid, [*scope, period], [item], "left_semi")
    best = top_rows(rows, [*scope, period], [F.col(pred).desc(), F.col(item)], k)
    return best.join(names, item, "left")
