"""Checked queries: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import aggs as A
from .binding import LASTS, SUMS, panel, panel_agg, table
from .registry import query

KEYS = ["season", "element", "gw"]

_FLOATS = ("influence", "creativity", "threat", "ict_index")


@query("d01_pre_aggregate", "with @PA select * from pa")
def d01(spark, sf):
    return panel_agg(spark, sf).select(*KEYS, *SUMS, *LASTS)


@query("d02_target", "with @PG select season, element, gw, sum(total_points)::bigint as target from pg group by all")
def d02(spark, sf):
    return A.target(panel(spark, sf), KEYS, "total_points")


LOOKUP_SUMS = ["total_points", "minutes", "goals_scored", "assists", "clean_sheets", "goals_conceded", "yellow_cards",
               "red_cards", "saves", "bonus", "bps"]
LOOKUP_FIRSTS = ["xp", "ict_index", "value", "transfers_in", "transfers_out", "transfers_balance"]


@query("d03_period_lookup", "with @PG select season, element, gw, "
       + ", ".join(f"sum({c})::bigint as {c}" for c in LOOKUP_SUMS)
       + ", " + ", ".join(f"first({c} order by seq_day, seq_line, seq_part) as {c}" for c in LOOKUP_FIRSTS) + " from pg group by season, element, gw")
def d03(spark, sf):
    return A.period_lookup(panel(spark, sf), KEYS, LOOKUP_SUMS, LOOKUP_FIRSTS, "seq")


@query("d04_period_cutoffs", """with @PG, c as (select season, gw, min(kickoff) as cutoff from pg group by all)
 select season, gw, cutoff, date '2020-01-01' + to_days(cast(7 * (gw - 1) as integer)) as synthetic_cutoff from c""")
def d04(spark, sf):
    pg = panel(spark, sf)
    real = A.period_cutoffs(pg, ["season"], "gw", "kickoff")
    weekly = A.period_cutoffs(pg, ["season"], "gw", None, name="synthetic_cutoff")
    return real.join(weekly, ["season", "gw"])


@query("d05_period_average", "with @PG select season, gw, round(avg(total_points), 6) as period_avg from pg group by all")
def d05(spark, sf):
    out = A.period_average(panel(spark, sf), ["season", "gw"], "total_points")
    return out.select("season", "gw", r6("period_avg").alias("period_avg"))


@query("d06_two_level", """with @PG select season, team, gw, sum(m)::bigint as team_goals_conceded from
 (select season, team, gw, fixture, max(goals_conceded) as m from pg group by all) group by all""")
def d06(spark, sf):
    return A.two_level(panel(spark, sf), ["season", "team", "gw", "fixture"], ["season", "team", "gw"], "goals_conceded", "team_goals_conceded")


@query("d07_double_flag", """with @PG select season, team, gw, count(distinct fixture) as n_fixtures,
 case when count(distinct fixture) > 1 then 1.0::double else 0.0::double end as is_double from pg group by all""")
def d07(spark, sf):
    return A.double_flag(panel(spark, sf), ["season", "team", "gw"], "fixture")


_FIXTURES_SQL = """fx as (select distinct year(o_orderdate)::bigint as season, (week(o_orderdate))::bigint as gw,
   (o_custkey % 60)::bigint as team_h, ((o_custkey + 7) % 60)::bigint as team_a, o_orderkey as fixture from orders)"""


def _fixtures(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "cast(year(o_orderdate) as bigint) as season", "cast(weekofyear(o_orderdate) as bigint) as gw",
        "o_custkey % 60 as team_h", "(o_custkey + 7) % 60 as team_a", "o_orderkey as fixture").distinct()


@query("d08_schedule_flags", f"""with {_FIXTURES_SQL},
 p as (select season, gw, team, count(*) as n from (select season, gw, team_h as team from fx union all select season, gw, team_a from fx) group by all),
 t as (select distinct season, team from p), g as (select distinct season, gw from p)
 select t.season, g.gw, t.team, coalesce(n, 0) as n_fixtures, coalesce(n, 0) > 1 as is_double, coalesce(n, 0) = 0 as is_blank
 from t join g on t.season = g.season left join p on p.season = t.season and p.team = t.team and p.gw = g.gw""")
def d08(spark, sf):
    return A.schedule_flags(_fixtures(spark, sf), ["season", "gw"], ["team_h", "team_a"])


@query("d09_average_fixtures", """with @PG, f as (select season, element, gw, fixture, case when was_home then 1.0 else 0.0 end as home,
   max(goals_conceded) as gc from pg group by all)
 select season, element, gw, round(avg(home), 6) as home, round(avg(gc), 6) as gc, max(case when gc > 3 then 1 else 0 end) as heavy from f group by all""")
def d09(spark, sf):
    rows = panel(spark, sf).groupBy(*KEYS, "fixture", "was_home").agg(F.max("goals_conceded").alias("gc"))
    rows = rows.withColumns({"home": F.col("was_home").cast("double"), "heavy": F.when(F.col("gc") > 3, 1).otherwise(0)})
    out = A.average_fixtures(rows, KEYS, ["home", "gc"], ["heavy"])
    return out.select(*KEYS, r6("home").alias("home"), r6("gc").alias("gc"), "heavy")


@query("d10_average_probs", """with @PG, m as (select season, gw, team, fixture, (1 + count(*) % 4) / 10.0::double as w, 0.25::double as d from pg group by all)
 select season, gw, team, round(avg(w), 6) as win_prob, round(avg(d), 6) as draw_prob, round(avg(1 - w - d), 6) as loss_prob,
  round(avg(w) - avg(1 - w - d), 6) as strength from m group by all""")
def d10(spark, sf):
    m = panel(spark, sf).groupBy("season", "gw", "team", "fixture").agg(((1 + F.count(F.lit(1)) % 4) / 10.0).alias("win_prob"))
    m = m.withColumn("draw_prob", F.lit(0.25)).withColumn("loss_prob", 1 - F.col("win_prob") - F.col("draw_prob"))
    out = A.average_probs(m, ["season", "gw", "team"])
    return out.select("season", "gw", "team", *[r6(c).alias(c) for c in ("win_prob", "draw_prob", "loss_prob", "strength")])


@query("d11_per90", """with @PG, s as (select season, customer, sum(minutes)::bigint as minutes, sum(goals_scored)::bigint as goals,
   sum(assists)::bigint as assists from pg group by all)
 select season, customer, minutes, case when minutes >= 90 then round(goals / (minutes / 90.0), 6) end as goals_per90,
  case when minutes >= 90 then round(assists / (minutes / 90.0), 6) end as assists_per90 from s""")
def d11(spark, sf):
    s = panel(spark, sf).groupBy("season", "customer").agg(
        F.sum("minutes").alias("minutes"), F.sum("goals_scored").alias("goals"), F.sum("assists").alias("assists"))
    out = A.per90(s, "minutes", ["goals", "assists"])
    return out.select("season", "customer", "minutes", r6("goals_per90").alias("goals_per90"), r6("assists_per90").alias("assists_per90"))


@query("d12_set_piece_flags", """select s_suppkey as element, case when s_suppkey % 7 <= 2 and s_suppkey % 7 > 0 then 1.0::double else 0.0::double end as is_penalty_taker,
 case when s_suppkey % 5 <= 2 then 1.0::double else 0.0::double end as is_corner_taker, cast(null as double) as is_freekick_taker,
 (case when s_suppkey % 7 <= 2 and s_suppkey % 7 > 0 then 1.0::double else 0.0::double end
  + case when s_suppkey % 5 <= 2 then 1.0::double else 0.0::double end)::double as order_sum from supplier""")
def d12(spark, sf):
    s = table(spark, sf, "supplier").selectExpr("s_suppkey as element", "nullif(s_suppkey % 7, 0) as penalties_order", "s_suppkey % 5 as corners_order")
    out = A.set_piece_flags(s, {"penalties_order": "is_penalty_taker", "corners_order": "is_corner_taker", "freekicks_order": "is_freekick_taker"})
    return out.select("element", "is_penalty_taker", "is_corner_taker", "is_freekick_taker", "order_sum")


@query("d13_detect_gaps", """with @PG select season, gw, sum(case when gw % 5 = 0 then 0.0 else xp end) as sum_xp, sum(minutes)::bigint as sum_minutes
 from pg group by season, gw having sum(case when gw % 5 = 0 then 0.0 else xp end) = 0 and sum(minutes) > 0""")
def d13(spark, sf):
    df = panel(spark, sf).withColumn("xp", F.when(F.col("gw") % 5 == 0, 0.0).otherwise(F.col("xp")))
    return A.detect_gaps(df, ["season", "gw"], "xp", "minutes")


@query("d14_coverage", """with @PG, w as (select season, count(*) as n_rows, count(*) filter (where position is null) as position,
   count(*) filter (where nullif(saves, 0) is null) as saves from pg group by season)
 select season, column_name, n_rows, n_missing, n_missing / n_rows as missing_share from
  (select season, n_rows, 'position' as column_name, position as n_missing from w union all select season, n_rows, 'saves', saves from w)""")
def d14(spark, sf):
    df = panel(spark, sf).withColumn("saves", F.expr("nullif(saves, 0)"))
    return A.coverage(df, ["position", "saves"], ["season"]).select("season", "column_name", "n_rows", "n_missing", "missing_share")


_TEXT_STATS = """case when p_partkey % 3 = 0 then 'n/a' else cast(p_size as varchar) end as mostly,
   case when p_partkey % 20 = 0 then cast(p_size as varchar) else '' end as rarely, p_name as never"""


def _text_stats(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey", "case when p_partkey % 3 = 0 then 'n/a' else cast(p_size as string) end as mostly",
        "case when p_partkey % 20 = 0 then cast(p_size as string) else '' end as rarely", "p_name as never", "p_brand", "p_size")


@query("d15_valid_columns", f"""with t as (select {_TEXT_STATS} from part),
 v as (select 'mostly' as column_name, try_cast(mostly as double) is not null as ok from t union all
   select 'rarely', try_cast(rarely as double) is not null from t union all select 'never', try_cast(never as double) is not null from t)
 select column_name, round(avg(ok::int), 6) as numeric_share, avg(ok::int) > 0.5 as is_valid from v group by all""")
def d15(spark, sf):
    out = A.valid_columns(_text_stats(spark, sf), ["mostly", "rarely", "never"], 0.5)
    return out.select("column_name", r6("numeric_share").alias("numeric_share"), "is_valid")


@query("d16_best_column", f"""with t as (select p_partkey, p_brand, {_TEXT_STATS} from part),
 g as (select avg((try_cast(rarely as double) is not null)::int) as r, avg((try_cast(mostly as double) is not null)::int) as m from t)
 select p_partkey, case when r >= 0.1 then 'rarely' when m >= 0.1 then 'mostly' end as chosen,
  case when r >= 0.1 then try_cast(rarely as double) when m >= 0.1 then try_cast(mostly as double) end as stat from t, g""")
def d16(spark, sf):
    return A.best_column(_text_stats(spark, sf), ["rarely", "mostly"], "stat", 0.1).select("p_partkey", "chosen", "stat")


@query("d16_column_ladder", f"""with t as (select p_partkey, p_brand, p_size, {_TEXT_STATS} from part), v as (select p_partkey, p_size::double as size, try_cast(rarely as double) as r, try_cast(mostly as double) as m from t),
 g as (select avg((r is not null)::int) as gr, avg((m is not null)::int) as gm from v)
 select p_partkey, case when gr >= 0.1 then 'combined' when gm >= 0.1 then 'sum' else 'proxy' end as chosen, case when gr >= 0.1 then r when gm >= 0.1 then m + size else size + coalesce(m, 0) end as stat,
  case when gr >= 1.01 then r when gm >= 1.01 then m + size else size + coalesce(m, 0) end as proxy from v, g""")
def d16_ladder(spark, sf):
    """A combined column, else a sum of two, else one and what is known of its proxy."""
    steps = [("combined", ["rarely"], [], []), ("sum", ["mostly"], ["p_size"], []), ("proxy", [], ["p_size"], ["mostly"])]
    rows = _text_stats(spark, sf)
    first = A.column_ladder(rows, steps, "stat", 0.1)
    return A.column_ladder(first.withColumnRenamed("chosen", "first"), steps, "proxy", 1.01).select("p_partkey", F.col("first").alias("chosen"), "stat", "proxy")


@query("d17_feature_target_corr", """with @PA, p as (select *, nullif(red_cards, 0) as reds from pa), u as (
  select 'minutes' as feature, count(minutes) as n, covar_pop(minutes, total_points) / nullif(stddev_pop(minutes) * stddev_pop(total_points), 0) as corr from p
  union all select 'bps', count(bps), covar_pop(bps, total_points) / nullif(stddev_pop(bps) * stddev_pop(total_points), 0) from p
  union all select 'threat', count(threat), covar_pop(threat, total_points) / nullif(stddev_pop(threat) * stddev_pop(total_points), 0) from p)
 select feature, n, round(corr, 6) as corr from u where n > 100""")
def d17(spark, sf):
    out = A.feature_target_corr(panel_agg(spark, sf), ["minutes", "bps", "threat"], "total_points", 100)
    return out.select("feature", "n", r6("corr").alias("corr"))


@query("d18_summarise", """with @PA select season, count(*) as n, sum(total_points)::bigint as total, round(avg(total_points), 6) as mean,
 round(stddev_pop(total_points), 6) as std, min(total_points) as lowest, max(total_points) as highest from pa group by season""")
def d18(spark, sf):
    out = A.summarise(panel_agg(spark, sf), ["season"], "total_points")
    return out.select("season", "n", "total", r6("mean").alias("mean"), r6("std").alias("std"), "lowest", "highest")


@query("d18_extremes", """with @PA, b as (select season, element, gw, total_points,
  row_number() over (partition by season order by total_points desc, element * 100 + gw) as r1,
  row_number() over (partition by season order by total_points, element * 100 + gw) as r2 from pa)
 select season, element, gw, total_points, r1::int as rank, 'top' as side from b where r1 <= 5
 union all select season, element, gw, total_points, r2::int, 'bottom' from b where r2 <= 5""")
def d18x(spark, sf):
    df = panel_agg(spark, sf).withColumn("tie", F.col("element") * 100 + F.col("gw"))
    out = A.extremes(df, ["season"], "total_points", "tie", 5)
    return out.select("season", "element", "gw", "total_points", "rank", "side")


@query("d19_linear_fit", """with @PA select season, count(*) as n, round(regr_slope(total_points, minutes), 6) as slope,
 round(regr_intercept(total_points, minutes), 6) as intercept, round(regr_r2(total_points, minutes), 6) as r2 from pa group by season""")
def d19(spark, sf):
    out = A.linear_fit(panel_agg(spark, sf), "minutes", "total_points", ["season"])
    return out.select("season", "n", *[r6(c).alias(c) for c in ("slope", "intercept", "r2")])


@query("d20_value_counts", "with @PG select season, position, count(*) as n from pg group by all")
def d20(spark, sf):
    return A.value_counts(panel(spark, sf), "position", ["season"])
