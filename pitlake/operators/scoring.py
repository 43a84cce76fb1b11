"""Points from event counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Points per action and position.
POINTS_GOAL = {"GK": 10, "DEF": 6, "MID": 5, "FWD": 4}
POINTS_CLEAN_SHEET = {"GK": 4, "DEF": 4, "MID": 1, "FWD": 0}
POINTS_CONCEDED_PER_2 = {"GK": -1, "DEF": -1, "MID": 0, "FWD": 0}
POINTS_SAVES_PER_3 = {"GK": 1}
POINTS_PENALTY_SAVED = {"GK": 5}
POINTS_FLAT = {"assists": 3, "penalties_missed": -2, "yellow_cards": -1, "red_cards": -3, "own_goals": -2, "bonus_points": 1}
POINTS_MINUTES_UNDER_60 = 1
POINTS_MINUTES_FROM_60 = 2


def _by_position(position: Column, points: dict[str, int]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in points.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, position), F.lit(0))


def score_events(df: DataFrame, position: str, name: str = "score") -> DataFrame:
    """Score of each row from the event columns it has."""
    pos = F.col(position)
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    per_position = {
        "goals_scored": (POINTS_GOAL, 1), "clean_sheets": (POINTS_CLEAN_SHEET, 1), "goals_conceded": (POINTS_CONCEDED_PER_2, 2),
        "saves": (POINTS_SAVES_PER_3, 3), "penalties_saved": (POINTS_PENALTY_SAVED, 1),
    }
    terms = [F.floor(count(c) / n) * _by_position(pos, pts) for c, (pts, n) in per_position.items() if c in df.columns]
    terms += [count(c) * p for c, p in POINTS_FLAT.items() if c in df.columns]
    if "minutes" in df.columns:
        m = count("minutes")
        terms.append(F.when(m >= 60, POINTS_MINUTES_FROM_60).when(m > 0, POINTS_MINUTES_UNDER_60).otherwise(0))
    total = F.lit(0).cast("bigint")
    for t in terms:
        total = total + t
    return df.withColumn(name, total)
