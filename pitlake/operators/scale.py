"""Scans and ranks over groups of any size.

A window gathers its whole group in one task. Panel operators avoid trouble by windowing only
rows that are unique per (entity, period), so a group is at most one row per period. Where a
group has no such bound (all rows of a period, all lines of a log) the functions here cut it
into ranges (a range partitioning), scan the ranges in parallel and carry a total per range across.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

BUCKET = "__bucket"
SPREAD = 16
# Rows of one range of a scanned group; a smaller group is one ordinary window.
ROWS_PER_RANGE = 500_000
# Times that ``first_after`` lets the planner broadcast.
FEW_TIMES = 200_000


def spread_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], salt_by: Sequence[str], how: str = "inner", spread: int = SPREAD
) -> DataFrame:
    """Join on a key with few or hot values without gathering a value's rows in one task.

    Each value is cut into ``spread`` parts by a hash of the big side's ``salt_by`` columns, and the
    small side is repeated for every part. Rows and results are those of the plain join, and what
    follows is not tied to the low-cardinality key's partitioning. Where the small side proves
    small at run time, adaptive execution broadcasts it as usual.
    """
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(spread)).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    return big.withColumn("__salt", salt).join(small.withColumn("__salt", parts), [*on, "__salt"], how).drop("__salt")


def grown_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join of two sides that both grow with the input: shuffled and merged, never broadcast.

    Rows that an ``explode`` makes, and what is aggregated from them, are missing in the planner's estimate, which
    would send a side of any size through the driver.
    """
    return left.join(right.hint("merge"), list(on), how)


def ranges(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], splits: int | None = None, rows: int = ROWS_PER_RANGE
) -> tuple[DataFrame | None, DataFrame | None]:
    """``df`` in two parts: groups of at most ``rows`` rows as they are, larger ones cut into ranges.

    Groups are counted first, which reads only the keys. Where some are too large for a window,
    their rows are range-partitioned by (keys, order) into as many partitions as their number of
    rows asks for, with the partition's number as ``__bucket``, and written once, so all that is
    built on the ranges sees the same ones. Within a group the ranges follow each other by number.
    Either part is None if there are no such groups; ``splits`` cuts all groups, into so many partitions.
    """
    keys = list(keys)
    if splits:
        return None, _placed(df, keys, order, splits)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows)
    total, groups = sizes.agg(F.sum("__n"), F.count(F.lit(1))).first()
    if not groups:
        return df, None
    parts = -(-total // rows)
    if not keys:
        return None, _placed(df, keys, order, parts)
    large = materialise(sizes.select(*keys), "large-groups")
    cond = lambda side: F.expr(" and ".join(f"df.`{k}` <=> large.`{k}`" for k in side))
    named, marks = df.alias("df"), large.alias("large")
    return named.join(marks, cond(keys), "left_anti"), _placed(named.join(marks, cond(keys), "left_semi"), keys, order, parts)


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int) -> DataFrame:
    cut = df.repartitionByRange(int(parts), *[F.col(c) for c in (*keys, *order)])
    return materialise(cut.withColumn(BUCKET, F.spark_partition_id()), "ranges")


def _both(parts: Sequence[DataFrame | None]) -> DataFrame:
    some = [p for p in parts if p is not None]
    return some[0] if len(some) == 1 else some[0].unionByName(some[1])


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}
_PICK = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest, "min": F.least}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    specs: dict[str, tuple[str, str]],
    ties: Sequence[str] = (),
    descending: bool = False,
    inclusive: bool = True,
    splits: int | None = None,
) -> DataFrame:
    """Running ``sum``/``max``/``min`` per group: ``specs`` maps output -> (column, function).

    A parallel prefix scan: small groups are one window each; a large one is scanned range by range, and
    the total of the ranges before, carried over by their number, is added to each. ``descending`` scans from
    the largest order value down (a suffix aggregate); ``inclusive=False`` leaves the current row
    out. ``ties`` complete the order, also across ranges.
    """
    keys = list(keys)
    sort = lambda c: F.col(c).desc() if descending else F.col(c).asc()

    def scan(rows: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
        inside = Window.partitionBy(*by).orderBy(*[sort(c) for c in (order, *ties)]).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return rows.withColumns({f"{prefix}{o}": _COMBINE[fn](c).over(inside) for o, (c, fn) in specs.items()})

    whole, cut = ranges(df, keys, [order, *ties], splits)
    parts = [scan(whole, keys, "").select(*df.columns, *specs) if whole is not None else None]
    if cut is not None:
        totals = cut.groupBy(*keys, BUCKET).agg(*[_COMBINE[fn](c).alias(f"__t_{out}") for out, (c, fn) in specs.items()])
        before = Window.partitionBy(*keys).orderBy(sort(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(*keys, BUCKET, *[_COMBINE[fn](f"__t_{out}").over(before).alias(f"__c_{out}") for out, (_, fn) in specs.items()])
        out = _carried(scan(cut, [*keys, BUCKET], "__l_"), carry, keys)
        out = out.withColumns({o: _PICK[fn](F.col(f"__l_{o}"), F.col(f"__c_{o}")) for o, (_, fn) in specs.items()})
        parts.append(out.select(*df.columns, *specs))
    return _both(parts)


def _carried(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a range joined to the rows of that range; NULL keys meet NULL keys."""
    named = carry.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)}).withColumnRenamed(BUCKET, "__b")
    on = F.col(BUCKET) == F.col("__b")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(named, on, "left").drop("__b", *[f"__k{i}" for i in range(len(keys))])


def lag_pair(
    df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str], ties: Sequence[str] = (), splits: int | None = None
) -> DataFrame:
    """``prev_<col>``: the value on the preceding row of the group, across the borders of ranges."""
    keys = list(keys)
    sort = [F.col(order).asc(), *[F.col(c).asc() for c in ties]]
    prev = {f"prev_{c}": F.col("__prev")[c] for c in cols}
    whole, cut = ranges(df, keys, [order, *ties], splits)
    parts = []
    if whole is not None:
        parts.append(whole.withColumn("__prev", F.lag(F.struct(*cols)).over(Window.partitionBy(*keys).orderBy(*sort))).withColumns(prev).select(*df.columns, *prev))
    if cut is not None:
        inside = Window.partitionBy(*keys, BUCKET).orderBy(*sort)
        tails = cut.groupBy(*keys, BUCKET).agg(F.max_by(F.struct(*cols), F.struct(order, *ties)).alias("__tail"))
        tails = tails.select(*keys, BUCKET, F.lag("__tail").over(Window.partitionBy(*keys).orderBy(BUCKET)).alias("__before"))
        out = _carried(cut.withColumn("__inside", F.lag(F.struct(*cols)).over(inside)), tails, keys)
        parts.append(out.withColumn("__prev", F.coalesce("__inside", "__before")).withColumns(prev).select(*df.columns, *prev))
    return _both(parts)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place", splits: int | None = None) -> DataFrame:
    """``name``: the row's number in its group from 0, by ``order``, which may hold several columns; groups of any size."""
    keys, order = list(keys), list(order)
    whole, cut = ranges(df, keys, order, splits)
    number = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long") - 1
    parts = [whole.withColumn(name, number(keys)).select(*df.columns, name) if whole is not None else None]
    if cut is not None:
        sizes = cut.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("__n"))
        before = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        carry = sizes.select(*keys, BUCKET, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
        out = _carried(cut.withColumn("__inside", number([*keys, BUCKET])), carry, keys)
        parts.append(out.withColumn(name, F.col("__inside") + F.col("__before")).select(*df.columns, name))
    return _both(parts)


def first_after(rows: DataFrame, cutoffs: DataFrame, scope: Sequence[str], ts: str, cutoff: str, name: str = "__next") -> DataFrame:
    """``name``: the cut-off row (a struct, ``cutoff`` first) next after each row's ``ts`` in its scope; NULL after the last.

    A sweep: times and cut-offs pass in one ordered stream, from the end, and the least cut-off so far is
    carried along. No scope is gathered and no time looks at more than its neighbour. Only the distinct times of a
    scope are swept, and the rows themselves meet what was found in one join, so they are not ordered; up to
    ``FEW_TIMES`` times may be broadcast, more are shuffled and merged.
    """
    scope = list(scope)
    rest = [c for c in cutoffs.columns if c not in scope and c != cutoff]
    kind = cutoffs.select(F.struct(cutoff, *rest).alias("c")).schema["c"].dataType
    times = materialise(rows.select(*scope, F.col(ts).alias("__t")).distinct(), "times")
    line = times.select(*scope, "__t", F.lit(1).alias("__kind"), F.lit(None).cast(kind).alias("__cut"))
    marks = cutoffs.select(*scope, F.col(cutoff).alias("__t"), F.lit(0).alias("__kind"), F.struct(cutoff, *rest).alias("__cut"))
    # from the end: at one time a row comes before a cut-off, so it does not see it
    swept = running(line.unionByName(marks), scope, "__t", {name: ("__cut", "min")}, ["__kind"], descending=True)
    swept = swept.where(f"__kind = 1 and {name} is not null").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(scope)], "__t", name)
    found = materialise(swept, "first-after")
    on = F.col(ts).eqNullSafe(F.col("__t"))
    for i, k in enumerate(scope):
        on &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(found if found.count() <= FEW_TIMES else found.hint("merge"), on, "left").select(*rows.columns, name)


def value_ranks(df: DataFrame, keys: Sequence[str], col: str, splits: int | None = None) -> DataFrame:
    """One row per (group, value) with its count, the number of smaller and of larger rows.

    Ranks follow from these three numbers, and the input shrinks to its distinct values
    (combined before the shuffle) before anything is ordered. The number of larger rows is the
    suffix scan of the same histogram, so no total has to be joined.
    """
    keys = list(keys)
    hist = df.where(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("n_equal"))
    hist = materialise(hist, "histogram")
    whole, cut = ranges(hist, keys, [col], splits)
    cols = [*keys, col, "n_equal"]
    parts = []
    if whole is not None:
        line = Window.partitionBy(*keys)
        upto = F.sum("n_equal").over(line.orderBy(col).rowsBetween(Window.unboundedPreceding, 0))
        parts.append(whole.select(*cols, (upto - F.col("n_equal")).alias("n_less"), (F.sum("n_equal").over(line) - upto).alias("n_greater")))
    if cut is not None:
        totals = cut.groupBy(*keys, BUCKET).agg(F.sum("n_equal").alias("__t"))
        line = Window.partitionBy(*keys)
        upto = F.sum("__t").over(line.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, 0))
        carry = totals.select(*keys, BUCKET, (upto - F.col("__t")).alias("__before"), F.sum("__t").over(line).alias("__all"))
        inside = F.sum("n_equal").over(Window.partitionBy(*keys, BUCKET).orderBy(col).rowsBetween(Window.unboundedPreceding, 0))
        out = _carried(cut.withColumn("__upto", inside), carry, keys)
        less = F.col("__before") + F.col("__upto") - F.col("n_equal")
        parts.append(out.select(*cols, less.alias("n_less"), (F.col("__all") - less - F.col("n_equal")).alias("n_greater")))
    return _both(parts)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Best ``n`` rows per group. The rank filter lets Spark cut each map task's share of a group
    to ``n`` rows before the shuffle, so a hot group never arrives whole anywhere."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
