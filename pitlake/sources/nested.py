"""Nested payloads to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = "struct<event_id:string,commence_time:string,home_team:string,away_team:string,home_odds:double,draw_odds:double,away_odds:double,last_update:string>"
EVENT = (
    "struct<id:string,commence_time:string,home_team:string,away_team:string,bookmakers:array<struct<key:string,last_update:string,"
    "markets:array<struct<key:string,outcomes:array<struct<name:string,price:double>>>>>>>"
)
RANKED = (
    "struct<TopLists:array<struct<StatList:array<struct<ParticipantName:string,StatValue:string,SubStatValue:string,"
    "MinutesPlayed:string,MatchesPlayed:string>>>>>"
)
RANKED_NAMES = {
    "ParticipantName": "player_name", "StatValue": "stat_value", "SubStatValue": "sub_stat_value",
    "MinutesPlayed": "minutes_played", "MatchesPlayed": "matches_played",
}


def explode_odds(df: DataFrame, json: str, keep: Sequence[str] = (), period: str = "gw") -> DataFrame:
    """``{period: [match, ...]}`` to one row per match."""
    maps = df.select(*keep, F.explode(F.from_json(json, f"map<string,array<{MATCH}>>")).alias(period, "__matches"))
    return maps.select(*keep, F.col(period).try_cast("int").alias(period), F.inline("__matches"))


def _with_key(items: Column, key: str) -> Column:
    return F.try_element_at(F.filter(items, lambda x: x["key"] == key), F.lit(1))


def flatten_events(df: DataFrame, json: str, bookmaker: str, market: str, keep: Sequence[str] = ()) -> DataFrame:
    """The three prices of one bookmaker's market per event; events lacking any of them are dropped.

    Of several entries with the wanted key the first counts, of repeated outcomes the last.
    """
    # inline makes columns of the record, so its text is parsed once however many of them are used
    record = F.inline(F.array(F.from_json(json, EVENT))).alias("__id", "__time", "__home", "__away", "__books")
    e = df.select(*keep, record).withColumn("__b", _with_key(F.col("__books"), bookmaker))
    e = e.select("*", _with_key(F.col("__b.markets"), market)["outcomes"].alias("__outcomes"))

    def price(name: Column) -> Column:
        return F.try_element_at(F.filter("__outcomes", lambda o: o["name"] == name), F.lit(-1))["price"]

    out = e.select(
        *keep, F.col("__id").alias("event_id"), F.col("__time").alias("commence_time"),
        F.col("__home").alias("home_team"), F.col("__away").alias("away_team"),
        price(F.col("__home")).alias("home_odds"), price(F.lit("Draw")).alias("draw_odds"),
        price(F.col("__away")).alias("away_odds"), F.coalesce("__b.last_update", F.lit("")).alias("last_update"),
    )
    return out.na.drop(subset=["home_odds", "draw_odds", "away_odds"])


def flatten_stat_lists(df: DataFrame, json: str, keep: Sequence[str] = ()) -> DataFrame:
    """Ranked lists to one row per entry, absent fields as empty text."""
    lists = df.select(*keep, F.explode(F.from_json(json, RANKED)["TopLists"]).alias("__l"))
    rows = lists.select(*keep, F.explode("__l.StatList").alias("__s"))
    return rows.select(*keep, *[F.coalesce(F.col("__s")[a], F.lit("")).alias(b) for a, b in RANKED_NAMES.items()])
