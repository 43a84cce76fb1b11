"""The given tables seen as a panel, and the same views as DuckDB common table expressions.

``panel``: one row per (season, period, entity, fixture line). An entity is a supplier, its
team is the supplier's nation, the opponent is the customer's nation (the next one if equal); the season is the order
year and the period (``gw``) the order month. ``squads``: fifteen consecutive parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggs import pre_aggregate
from ..session import co_partitioned

POSITIONS = ("GK", "DEF", "MID", "FWD")

# The panel's statistics.
SUMS = [
    "total_points", "minutes", "goals_scored", "assists", "clean_sheets", "bonus", "bps", "saves",
    "goals_conceded", "yellow_cards", "red_cards", "starts", "transfers_balance", "transfers_in",
    "transfers_out", "influence", "creativity", "threat", "ict_index",
    "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded",
    "key_passes", "tackles", "completed_passes", "big_chances_created", "recoveries",
]
DOUBLES = ("influence", "creativity", "threat", "ict_index", "expected_goals", "expected_assists", "expected_goal_involvements", "expected_goals_conceded")
LASTS = ["value", "selected"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The customer's nation, or the next one where that is the supplier's own: no team plays itself.
OPPONENT = "(case when c_nationkey = s_nationkey then (c_nationkey + 1) % 25 else c_nationkey end)"

PANEL_EXPRS: dict[str, str] = {
    "season": "cast(year(o_orderdate) as bigint)",
    "gw": "cast(month(o_orderdate) as bigint)",
    "element": "l_suppkey",
    "name": "s_name",
    "team": "cast(s_nationkey as bigint)",
    "opponent_team": f"cast({OPPONENT} as bigint)",
    "fixture": f"cast(month(o_orderdate) * 10000 + least(s_nationkey, {OPPONENT}) * 100 + greatest(s_nationkey, {OPPONENT}) as bigint)",
    "was_home": f"s_nationkey < {OPPONENT}",
    "kickoff": "o_orderdate",
    "position": "case when year(o_orderdate) <= 1996 then null when l_suppkey % 4 = 0 then 'GK' when l_suppkey % 4 = 1 then 'DEF' when l_suppkey % 4 = 2 then 'MID' else 'FWD' end",
    "line": "l_orderkey * 10 + l_linenumber",
    "part": "l_partkey",
    "minutes": "cast(case when l_quantity <= 10 then 0 else least(l_quantity * 2, 90) end as bigint)",
    "total_points": "cast(floor(l_quantity / 5) + l_linenumber % 3 - 1 as bigint)",
    "goals_scored": "cast(l_linenumber % 4 as bigint)",
    "assists": "cast(round(l_tax * 100) as bigint)",
    "clean_sheets": "cast(case when l_returnflag = 'N' then 1 else 0 end as bigint)",
    "bonus": "cast(round(l_discount * 100) as bigint) % 4",
    "bps": "cast(l_quantity + l_linenumber as bigint)",
    "saves": "cast(l_quantity as bigint) % 7",
    "goals_conceded": "cast(l_quantity as bigint) % 5",
    "yellow_cards": "cast(case when l_returnflag = 'R' then 1 else 0 end as bigint)",
    "red_cards": "cast(case when l_returnflag = 'A' and l_linenumber = 7 then 1 else 0 end as bigint)",
    "starts": "cast(case when l_quantity > 25 then 1 else 0 end as bigint)",
    "transfers_in": "o_custkey % 997",
    "transfers_out": "l_orderkey % 991",
    "transfers_balance": "o_custkey % 997 - l_orderkey % 991",
    "influence": "cast(l_quantity as double)",
    "creativity": "cast(l_quantity * 2 as double)",
    "threat": "cast(l_linenumber as double)",
    "ict_index": "cast(l_quantity * 3 + l_linenumber as double)",
    "expected_goals": "cast(cast(l_quantity as bigint) % 9 as double) / 8.0",
    "expected_assists": "cast(l_linenumber as double) / 4.0",
    "expected_goal_involvements": "cast(cast(l_quantity as bigint) % 9 as double) / 8.0 + cast(l_linenumber as double) / 4.0",
    "expected_goals_conceded": "cast(l_partkey % 17 as double) / 8.0",
    "key_passes": "l_partkey % 5",
    "tackles": "l_orderkey % 6",
    "completed_passes": "l_partkey % 70",
    "big_chances_created": "cast(l_linenumber % 2 as bigint)",
    "recoveries": "l_orderkey % 11",
    "value": "40 + l_partkey % 90",
    "selected": "l_partkey * 1000",
    "xp": "cast(cast(round(l_extendedprice * 100) as bigint) % 40 as double) / 8.0",
    "customer": "o_custkey",
    "cents": "cast(round(l_extendedprice * 100) as bigint)",
}


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture-level facts; only the columns a query uses reach the scans."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    joined = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    )
    # A total order of the lines that fits one number: day, then line, then part.
    seq = (
        F.expr("cast(datediff(o_orderdate, date'1990-01-01') as decimal(10,0)) * cast(10000000000000 as decimal(14,0))")
        + F.expr("cast(l_orderkey * 10 + l_linenumber as decimal(14,0))")
    ) * F.expr("cast(1000000000000 as decimal(13,0))") + F.expr("cast(l_partkey as decimal(13,0))")
    return joined.select(
        *[F.expr(e).alias(n) for n, e in PANEL_EXPRS.items()], seq.cast("decimal(38,0)").alias("seq")
    )


def written_panel(spark: SparkSession, sf_dir: str, cols: Sequence[str]) -> DataFrame:
    """``cols`` of the panel, written once in buckets of (season, element) for a query that reads them several times."""
    return co_partitioned(panel(spark, sf_dir).select(*cols), ["season", "element"], "panel")


def panel_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (season, element, gw): doubles summed, last price and ownership kept."""
    return pre_aggregate(panel(spark, sf_dir), ["season", "element", "gw"], SUMS, LASTS, "seq")


def squad_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(squad_id, slot) rows; the bench depends on the squad, a tenth has an illegal formation."""
    part = table(spark, sf_dir, "part")
    base = part.selectExpr(
        "cast(p_partkey div 15 as bigint) as squad_id",
        "cast(p_partkey % 15 + 1 as bigint) as slot",
        "p_partkey as element",
        "cast(substring(p_brand, 7) as bigint) as team",
        "cast(p_size as bigint) as purchase_price",
        "cast(round(p_retailprice * 100) as bigint) as xp",
    )
    return base.selectExpr(
        "*",
        "case when slot <= 2 then 'GK' when slot <= 7 then 'DEF' when slot <= 12 then 'MID' else 'FWD' end as position",
        """case when squad_id % 10 = 9 then slot not in (2, 13, 14, 15)
                when squad_id % 3 = 0 then slot not in (2, 7, 12, 15)
                when squad_id % 3 = 1 then slot not in (2, 6, 7, 15)
                else slot not in (2, 10, 11, 12) end as in_lineup""",
    )


def squads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long squad table over the twelve periods."""
    slots = squad_slots(spark, sf_dir)
    return slots.withColumn("gw", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(12).cast("bigint")))).selectExpr(
        "squad_id", "gw", "slot", "element", "position", "team", "purchase_price", "xp", "in_lineup",
        "slot = 8 + gw % 2 as is_captain", "slot = 3 + gw % 2 as is_vice",
        "case when in_lineup then null else slot end as bench_order",
    )


def squad_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, minutes and cards per (part, month), over all years."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("l_partkey").alias("element"), F.expr("cast(month(o_orderdate) as bigint)").alias("gw"))
        .agg(
            F.expr("cast(sum(floor(l_quantity / 5) + l_linenumber % 3 - 1) as bigint)").alias("total_points"),
            F.expr("cast(sum(case when l_quantity <= 10 then 0 else l_quantity end) as bigint)").alias("minutes"),
            F.expr("cast(sum(case when l_returnflag = 'R' and l_linenumber = 1 then 1 else 0 end) as bigint)").alias("yellow_cards"),
            F.expr("cast(sum(case when l_returnflag = 'A' and l_linenumber = 7 then 1 else 0 end) as bigint)").alias("red_cards"),
        )
    )


def prices(squads_df: DataFrame) -> DataFrame:
    return squads_df.selectExpr("squad_id", "gw", "element", "purchase_price + (element + gw) % 7 - 3 as current_price")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger: up to three swaps per squad and period, each with the same slot of the next squad."""
    s = squads(spark, sf_dir)
    return s.where("(slot + gw * 5) % 15 < (squad_id + gw) % 4").selectExpr(
        "squad_id", "gw", "element as element_out", "element + 15 as element_in"
    )


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = squads(spark, sf_dir).where("slot = 1").selectExpr("squad_id", "gw * 3 as gw", "squad_id * 7 + gw as h")
    return s.where("h % 3 = 0").selectExpr(
        "squad_id", "gw",
        "case when h % 5 = 0 then 'wildcard' when h % 5 = 1 then 'free_hit' when h % 5 = 2 then 'bench_boost' when h % 5 = 3 then 'triple_captain' else 'mystery' end as chip",
    )


_PG_DUCK = {
    "bps": "cast(l_quantity + l_linenumber as bigint)",
    "influence": "l_quantity",
    "creativity": "l_quantity * 2",
    "threat": "cast(l_linenumber as double)",
    "ict_index": "l_quantity * 3 + l_linenumber",
}

_PG = (
    "pg as (select "
    + ", ".join(f"{_PG_DUCK.get(n, e)} as {n}" for n, e in PANEL_EXPRS.items())
    + ", o_orderdate as seq_day, l_orderkey * 10 + l_linenumber as seq_line, l_partkey as seq_part"
    + " from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey"
    + " join supplier on l_suppkey = s_suppkey)"
)
_PA = (
    _PG
    + ", pa as (select season, element, gw, "
    + ", ".join(
        f"coalesce(sum({c}), 0)::{'double' if c in DOUBLES else 'bigint'} as {c}"
        for c in SUMS
    )
    + ", "
    + ", ".join(f"last({c} order by seq_day, seq_line, seq_part) as {c}" for c in LASTS)
    + " from pg group by season, element, gw)"
)
_SL = """sl as (select *, case when slot <= 2 then 'GK' when slot <= 7 then 'DEF' when slot <= 12 then 'MID' else 'FWD' end as position,
 case when squad_id % 10 = 9 then slot not in (2, 13, 14, 15)
      when squad_id % 3 = 0 then slot not in (2, 7, 12, 15)
      when squad_id % 3 = 1 then slot not in (2, 6, 7, 15)
      else slot not in (2, 10, 11, 12) end as in_lineup
 from (select p_partkey // 15 as squad_id, p_partkey % 15 + 1 as slot, p_partkey as element,
  substring(p_brand, 7)::bigint as team, p_size::bigint as purchase_price, round(p_retailprice * 100)::bigint as xp from part))"""
_SQ = (
    _SL
    + """, sq as (select squad_id, gw, slot, element, position, team, purchase_price, xp, in_lineup,
 slot = 8 + gw % 2 as is_captain, slot = 3 + gw % 2 as is_vice, case when in_lineup then null else slot end as bench_order
 from sl, (select unnest(range(1, 13)) as gw))"""
)
_SF = """sf as (select l_partkey as element, month(o_orderdate)::bigint as gw,
 sum(floor(l_quantity / 5) + l_linenumber % 3 - 1)::bigint as total_points,
 sum(case when l_quantity <= 10 then 0 else l_quantity end)::bigint as minutes,
 sum(case when l_returnflag = 'R' and l_linenumber = 1 then 1 else 0 end)::bigint as yellow_cards,
 sum(case when l_returnflag = 'A' and l_linenumber = 7 then 1 else 0 end)::bigint as red_cards
 from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)"""
_PR = "pr as (select squad_id, gw, element, purchase_price + (element + gw) % 7 - 3 as current_price from sq)"
_TR = """tr as (select squad_id, gw, element as element_out, element + 15 as element_in from sq
 where (slot + gw * 5) % 15 < (squad_id + gw) % 4)"""
_CH = """ch as (select squad_id, gw, case when h % 5 = 0 then 'wildcard' when h % 5 = 1 then 'free_hit'
 when h % 5 = 2 then 'bench_boost' when h % 5 = 3 then 'triple_captain' else 'mystery' end as chip
 from (select squad_id, gw * 3 as gw, squad_id * 7 + gw as h from sq where slot = 1) where h % 3 = 0)"""

CTES = {"PG": _PG, "PA": _PA, "SL": _SL, "SQ": _SQ, "SF": _SF, "PR": _PR, "TR": _TR, "CH": _CH}
