"""Column expressions and projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import col_of


def coerce_numeric(df: DataFrame, cols: Sequence[str], fill: float | None = None) -> DataFrame:
    """Text to double, unreadable values to NULL or to ``fill``; columns the table lacks are skipped."""
    value = lambda c: F.col(c).try_cast("double")
    return df.withColumns(
        {c: value(c) if fill is None else F.coalesce(value(c), F.lit(float(fill))) for c in cols if c in df.columns}
    )


def coerce_boolean(col: Column | str, default: bool = False) -> Column:
    """True/False in any case, 1/0 in any type; everything else becomes ``default``."""
    text = F.lower(F.trim(col_of(col).cast("string")))
    return (
        F.when(text.isin("true", "1", "1.0"), True).when(text.isin("false", "0", "0.0"), False).otherwise(F.lit(default))
    )


# Position codes and label variants.
POSITION_LABELS = {"1": "GK", "2": "DEF", "3": "MID", "4": "FWD", "GKP": "GK", "AM": "MID"}


def normalise_label(col: Column | str, mapping: Mapping[str, str] = POSITION_LABELS) -> Column:
    """Map known spellings (numbers included) to one label, pass the others through."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    text = col_of(col).cast("string")
    return F.coalesce(F.try_element_at(pairs, text), text)


def rename_canonical(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in mapping.items() if a in df.columns})


def apply_alias(df: DataFrame, col: str, aliases: DataFrame, alias: str = "alias", name: str = "name") -> DataFrame:
    """Replace known aliases, keep unknown names."""
    lookup = aliases.select(F.col(alias).alias("__alias"), F.col(name).alias("__canonical"))
    out = df.join(lookup, F.col(col) == F.col("__alias"), "left")
    return out.withColumn(col, F.coalesce("__canonical", col)).drop("__alias", "__canonical")


def parse_percent(col: Column | str) -> Column:
    return F.trim(F.replace(col_of(col), F.lit("%"), F.lit(""))).try_cast("double")


def parse_timestamp_utc(col: Column | str) -> Column:
    """Dates, date-times and ISO strings with a zone, as UTC wall-clock time without a zone."""
    return F.try_to_timestamp(col_of(col)).cast("timestamp_ntz")


def season_key(col: Column | str, style: str) -> Column:
    """``2016-17`` as ``start`` (2016), ``long`` (2016-2017) or ``previous`` (2015-16)."""
    start = F.substring(col_of(col), 1, 4).cast("int")
    if style == "start":
        return start
    if style == "long":
        return F.concat_ws("-", start.cast("string"), (start + 1).cast("string"))
    if style == "previous":
        return F.concat_ws("-", (start - 1).cast("string"), F.lpad((start % 100).cast("string"), 2, "0"))
    raise ValueError(f"unknown season style: {style}")


def implied_probabilities(
    df: DataFrame, keys: Sequence[str], home: str, away: str, odds: tuple[str, str, str]
) -> DataFrame:
    """Two rows per match (home side, away side) with probabilities free of the bookmaker's margin.

    Matches with an unmapped side or without usable prices are left out.
    """
    h, d, a = [F.try_divide(F.lit(1.0), F.col(c)) for c in odds]
    total = h + d + a
    ok = df.where(F.col(home).isNotNull() & F.col(away).isNotNull() & (total > 0))

    def side(team: str, win: Column, loss: Column) -> Column:
        return F.struct(
            F.col(team).alias("team"), (win / total).alias("win_prob"), (d / total).alias("draw_prob"),
            (loss / total).alias("loss_prob"),
        )

    return ok.select(*keys, F.inline(F.array(side(home, h, a), side(away, a, h))))


EPS = 1e-6


def add_ratio_features(df: DataFrame, eps: float = EPS, periods: float = 38.0) -> DataFrame:
    """Interaction features, each only where its inputs exist."""

    def ratio(a: str, b: str) -> Column:
        return F.col(a) / (F.col(b) + F.lit(eps))

    def delta(a: str, b: str) -> Column:
        return F.col(a) - F.col(b)

    def per_match(a: str, b: str) -> Column:
        return F.col(a) / 5.0 - F.col(b)

    specs = {
        "pts_per_min_5": (ratio, "pts_rolling_5", "mins_rolling_5"),
        "pts_form_delta": (delta, "pts_rolling_3", "pts_rolling_10"),
        "goals_vs_xg_5": (per_match, "goals_rolling_5", "xg_rolling_5"),
        "assists_vs_xa_5": (per_match, "assists_rolling_5", "xa_rolling_5"),
        "gw_phase": (lambda a, _: F.col(a) / F.lit(periods), "gw", "gw"),
        "transfer_ratio_3": (ratio, "transfers_in_rolling_3", "transfers_out_rolling_3"),
        "ict_form_delta": (delta, "ict_rolling_3", "ict_rolling_10"),
        "bps_form_delta": (delta, "bps_rolling_5", "bps_rolling_10"),
        "nailedness": (lambda a, _: F.col(a), "starts_rolling_5", "mins_rolling_5"),
        "bonus_rate_5": (ratio, "bonus_rolling_5", "pts_rolling_5"),
    }
    have = set(df.columns)
    return df.withColumns({name: fn(a, b) for name, (fn, a, b) in specs.items() if {a, b} <= have})


def round_half(col: Column | str) -> Column:
    """To the nearest 0.5, ties to even."""
    return F.bround(col_of(col).cast("double") * 2, 0) / 2


def clip(col: Column | str, low: float, high: float) -> Column:
    """Clip that keeps NULL (``least``/``greatest`` alone would return the bound)."""
    c = col_of(col)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def playing_prob(col: Column | str, full: float = 90.0) -> Column:
    return clip(col_of(col) / F.lit(full), 0.0, 1.0)


def selling_price(purchase: Column | str, current: Column | str) -> Column:
    """A fall counts in full, a rise by half (rounded down); without a valid price, the purchase price."""
    purchase, current = col_of(purchase), col_of(current)
    gain = F.floor((current - purchase) / 2)
    return F.when(current <= 0, purchase).when(current <= purchase, current).otherwise(purchase + gain)


HIT_COST = 4
MAX_FREE = 5


def transfer_hit(n: Column | str, free: Column | str, chip: Column | str) -> Column:
    """Points paid for transfers beyond the free ones, none under a wildcard or free hit."""
    waived = F.coalesce(col_of(chip).isin("wildcard", "free_hit"), F.lit(False))
    return F.when(waived, F.lit(0)).otherwise(F.greatest(col_of(n) - col_of(free), F.lit(0)) * HIT_COST)


def population_cuts(df: DataFrame, cuts: Mapping[str, Column]) -> DataFrame:
    """One row per (row, named cut) it satisfies."""
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in cuts.items()]))
    return df.withColumn("cut", F.explode(tags))


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))
