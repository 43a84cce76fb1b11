"""Point-in-time windows.

Input is unique per (keys, order), one row per entity and period; that bounds every window group
by the number of periods, and all functions sharing keys and order cost a single sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..session import materialise
from .scale import first_after, lag_pair, row_numbers, running as running_scan, spread_join, top_rows

_AGG = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "max": F.max, "min": F.min}


def _w(keys: Sequence[str], order: Sequence[str] | str) -> WindowSpec:
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def lagged_rolling(
    df: DataFrame, keys: Sequence[str], order: str, specs: Sequence[tuple[str, str, int, str]]
) -> DataFrame:
    """``(output, column, window, mean|sum|std)`` over the previous rows, the current one excluded.

    A source column the table lacks gives a NULL feature.
    """
    w = _w(keys, order)
    return df.withColumns(
        {
            out: _AGG[fn](src).over(w.rowsBetween(-n, -1)) if src in df.columns else F.lit(None).cast("double")
            for out, src, n, fn in specs
        }
    )


def lagged_expanding(df: DataFrame, keys: Sequence[str], order: str, specs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``(output, column, mean|sum|count_positive)`` over all earlier rows; counts start at 0."""
    past = _w(keys, order).rowsBetween(Window.unboundedPreceding, -1)

    def feature(src: str, fn: str) -> Column:
        if fn == "count_positive":
            return F.coalesce(F.sum(F.when(F.col(src) > 0, 1).otherwise(0)).over(past), F.lit(0))
        return _AGG[fn](src).over(past)

    return df.withColumns({out: feature(src, fn) for out, src, fn in specs})


def momentum(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    w = _w(keys, order)
    return df.withColumns({f"{c}_momentum": F.col(c) - F.lag(c).over(w) for c in cols})


def team_rolling(
    a: DataFrame, b: DataFrame, keys: Sequence[str], order: str, cols: dict[str, str], w: int = 5
) -> DataFrame:
    """Full outer join of two team aggregates, then lagged means of ``cols`` (source -> output)."""
    both = a.join(b, [*keys, order], "full_outer")
    return lagged_rolling(both, keys, order, [(out, src, w, "mean") for src, out in cols.items()])


def time_window_mean(
    df: DataFrame, cutoffs: DataFrame, scope: Sequence[str], key: str, period: str, ts: str, col: str,
    days: int = 30, cutoff: str = "cutoff",
) -> DataFrame:
    """Mean over the rows of earlier periods in the ``days`` before each period's cut-off.

    Differences of prefix sums: a row, combined per (entity, period, timestamp), enters at the first
    cut-off after it and leaves at the first one more than ``days`` after it. A sweep finds both, the
    changes are added up along each entity's own line, and a value holds up to the entity's next
    change. So a row costs two changes, however many cut-offs lie in its window. Cut-offs behind rows
    of their own or a later period, which do not count for them, are put right row by row. Sums of doubles
    carry the rounding of prefix sums.
    """
    scope = list(scope)
    numbered = materialise(row_numbers(cutoffs.select(*scope, cutoff, period), scope, [cutoff, period], "__i"), "cutoffs")
    part = df.groupBy(*scope, key, period, ts).agg(F.sum(col).alias("__s"), F.count(col).alias("__n")).where("__n > 0")
    part = materialise(part, "window-rows")
    span = F.expr(f"interval {days} days")
    change = lambda at, sign: F.struct(at.cast("timestamp").alias("__at"), (F.col("__s") * sign).alias("__s"), (F.col("__n") * sign).alias("__n"))
    changes = part.select(*scope, key, F.inline(F.array(change(F.col(ts), 1), change(F.col(ts) + span, -1))))
    swept = first_after(changes, numbered.withColumn(cutoff, F.col(cutoff).cast("timestamp")), scope, "__at", cutoff).where("__next is not null")
    points = swept.groupBy(*scope, key, F.col("__next")["__i"].alias("__i")).agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n"))
    line = Window.partitionBy(*scope, key).orderBy("__i")
    sums = points.select(*scope, key, "__i", F.sum("__s").over(line).alias("__s"), F.sum("__n").over(line).alias("__n"), F.lead("__i").over(line).alias("__end"))
    sizes = numbered.groupBy(*scope).agg((F.max("__i") + 1).alias("__all"))
    held = spread_join(sums.where("__n > 0"), sizes, scope, [key, "__i"])
    each = held.withColumn("__i", F.explode(F.sequence("__i", F.coalesce("__end", "__all") - 1)))
    out = each.join(numbered, [*scope, "__i"]).select(*scope, key, period, "__s", "__n")
    first = part.groupBy(*scope, period).agg(F.min(ts).alias("__first"))
    ahead = Window.partitionBy(*scope).orderBy(F.desc(period))
    early = materialise(numbered.join(first, [*scope, period], "full_outer").withColumn("__first", F.min("__first").over(ahead)).where(F.col("__first") < F.col(cutoff)).select(*scope, period, cutoff), "cutoffs")
    if not early.isEmpty():
        late = early.withColumnRenamed(period, "__p")
        wrong = spread_join(part, late, scope, [key, ts]).where((F.col(period) >= F.col("__p")) & (F.col(ts) < F.col(cutoff)) & (F.col(ts) >= F.col(cutoff) - span))
        out = out.unionByName(wrong.select(*scope, key, F.col("__p").alias(period), (-F.col("__s")).alias("__s"), (-F.col("__n")).alias("__n")))
        out = out.groupBy(*scope, key, period).agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n")).where("__n > 0")
    return out.select(*scope, key, period, F.try_divide("__s", "__n").alias("window_mean"), F.col("__n").alias("n_rows"))


def trailing_streak(df: DataFrame, keys: Sequence[str], order: str, pred: Column, cap: int = 3, name: str = "streak") -> DataFrame:
    """How many of the last rows before this one satisfy ``pred`` without a break, at most ``cap``."""
    w = _w(keys, order)
    streak = F.lit(0)
    for back in range(cap, 0, -1):
        hit = F.coalesce(F.lag(pred, back).over(w), F.lit(False))
        streak = F.when(hit, streak + 1).otherwise(0)
    return df.withColumn(name, streak)


def last_k(df: DataFrame, keys: Sequence[str], order: str, k: int, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over the last ``k`` rows before the current one."""
    w = _w(keys, order).rowsBetween(-k, -1)
    return df.withColumns({name: agg.over(w) for name, agg in aggs.items()})


def period_window_mean(df: DataFrame, keys: Sequence[str], period: str, col: str, w: int = 5, name: str = "form") -> DataFrame:
    """Mean over the previous ``w`` period numbers; absent periods take up room but add nothing."""
    return df.withColumn(name, F.avg(col).over(_w(keys, period).rangeBetween(-w, -1)))


def shift(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], n: int = 1) -> DataFrame:
    w = _w(keys, order)
    return df.withColumns({c: F.lag(c, n).over(w) for c in cols})


def top_n_with_protected(df: DataFrame, keys: Sequence[str], metric: str, tie: str, n: int, protected: Column) -> DataFrame:
    """Best ``n`` unprotected rows per group plus every protected row."""
    kept = df.where(protected)
    best = top_rows(df.where(~protected), keys, [F.col(metric).desc(), F.col(tie)], n)
    return kept.unionByName(best.drop("rank"))


def candidate_pool(
    df: DataFrame, members: DataFrame, keys: Sequence[str], group: str, item: str, metric: str,
    groups: Sequence[str], per_group: int = 12, size: int = 50,
) -> DataFrame:
    """Up to ``per_group`` best non-members of each group, then padded to ``size`` in group order.

    ``groups`` fixes the order in which groups are served. The padding can use at most ``size``
    rows of any group, so only that many per group are ever ranked together.
    """
    free = df.join(members, [*keys, item], "left_anti")
    ranked = top_rows(free, [*keys, group], [F.col(metric).desc(), F.col(item)], per_group + size, "group_rank")
    stage = F.when(F.col("group_rank") <= per_group, 0).otherwise(1)
    place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col(group))
    pool = top_rows(
        ranked.withColumns({"__stage": stage, "__place": place}), keys,
        [F.col("__stage"), F.col("__place"), F.col("group_rank")], size, "pool_rank",
    )
    return pool.drop("__stage", "__place")


def running(df: DataFrame, keys: Sequence[str], order: str, col: str, fn: str, name: str, ties: Sequence[str] = ()) -> DataFrame:
    """Running ``sum``/``max``/``min`` over groups of any size."""
    return running_scan(df, keys, order, {name: (col, fn)}, ties)


def resume_dedup(df: DataFrame, keys: Sequence[str], order: str, step: str) -> DataFrame:
    """Drop the rows a resumed log wrote again: those whose step a later row repeats or undercuts."""
    later = running_scan(df, keys, order, {"__later": (step, "min")}, descending=True, inclusive=False)
    return later.where(F.col("__later").isNull() | (F.col(step) < F.col("__later"))).drop("__later")


def interval_rate(df: DataFrame, keys: Sequence[str], order: str, step: str, time: str, name: str = "rate") -> DataFrame:
    """Steps per time unit between neighbouring rows, NULL for the first row and for no elapsed time."""
    prev = lag_pair(df, keys, order, [step, time])
    gap = F.col(time) - F.col(f"prev_{time}")
    return prev.withColumn(name, F.try_divide(F.col(step) - F.col(f"prev_{step}"), gap)).drop(f"prev_{step}", f"prev_{time}")
