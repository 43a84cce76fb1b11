"""NULL-safe statistics: constant or empty input gives NULL instead of an error or NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation over the rows where both sides are known."""
    x, y = col_of(x), col_of(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def share(cond: Column) -> Column:
    """Share of rows where ``cond`` is true; rows where it is NULL do not count."""
    return F.avg(cond.cast("double"))


def r6(c: Column | str) -> Column:
    return F.round(col_of(c), 6)
