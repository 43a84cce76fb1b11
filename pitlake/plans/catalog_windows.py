"""Checked queries: window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import ranks, windows as W
from ..operators.aggs import period_cutoffs, target, two_level
from ..operators.features import synthetic_ep
from ..operators.scale import running
from .binding import POSITIONS, panel, panel_agg, table, written_panel
from .registry import query

KEYS = ["season", "element"]

# The rolling features (output, source, rows, statistic).
ROLLING_SPECS = [
    ("pts_rolling_3", "total_points", 3, "mean"),
    ("pts_rolling_5", "total_points", 5, "mean"),
    ("pts_rolling_10", "total_points", 10, "mean"),
    ("mins_rolling_3", "minutes", 3, "mean"),
    ("mins_rolling_5", "minutes", 5, "mean"),
    ("mins_std_5", "minutes", 5, "std"),
    ("goals_rolling_3", "goals_scored", 3, "sum"),
    ("goals_rolling_5", "goals_scored", 5, "sum"),
    ("assists_rolling_3", "assists", 3, "sum"),
    ("assists_rolling_5", "assists", 5, "sum"),
    ("cs_rolling_5", "clean_sheets", 5, "mean"),
    ("cs_rolling_10", "clean_sheets", 10, "mean"),
    ("bonus_rolling_5", "bonus", 5, "mean"),
    ("bonus_rolling_10", "bonus", 10, "mean"),
    ("bps_rolling_5", "bps", 5, "mean"),
    ("bps_rolling_10", "bps", 10, "mean"),
    ("ict_rolling_3", "ict_index", 3, "mean"),
    ("ict_rolling_5", "ict_index", 5, "mean"),
    ("ict_rolling_10", "ict_index", 10, "mean"),
    ("influence_rolling_5", "influence", 5, "mean"),
    ("creativity_rolling_5", "creativity", 5, "mean"),
    ("threat_rolling_5", "threat", 5, "mean"),
    ("saves_rolling_5", "saves", 5, "mean"),
    ("goals_conceded_rolling_5", "goals_conceded", 5, "mean"),
    ("transfers_balance_rolling_3", "transfers_balance", 3, "mean"),
    ("yellows_rolling_5", "yellow_cards", 5, "sum"),
    ("reds_rolling_10", "red_cards", 10, "sum"),
    ("starts_rolling_5", "starts", 5, "mean"),
    ("exp_goals_rolling_3", "expected_goals", 3, "mean"),
    ("exp_goals_rolling_5", "expected_goals", 5, "mean"),
    ("exp_assists_rolling_3", "expected_assists", 3, "mean"),
    ("exp_assists_rolling_5", "expected_assists", 5, "mean"),
    ("exp_involvements_rolling_3", "expected_goal_involvements", 3, "mean"),
    ("exp_involvements_rolling_5", "expected_goal_involvements", 5, "mean"),
    ("exp_conceded_rolling_5", "expected_goals_conceded", 5, "mean"),
    ("transfers_in_rolling_3", "transfers_in", 3, "mean"),
    ("transfers_in_rolling_5", "transfers_in", 5, "mean"),
    ("transfers_out_rolling_3", "transfers_out", 3, "mean"),
    ("transfers_out_rolling_5", "transfers_out", 5, "mean"),
    ("detail_key_passes_rolling_5", "key_passes", 5, "mean"),
    ("tackles_rolling_5", "tackles", 5, "mean"),
    ("completed_passes_rolling_5", "completed_passes", 5, "mean"),
    ("big_chances_created_rolling_5", "big_chances_created", 5, "mean"),
    ("recoveries_rolling_5", "recoveries", 5, "mean"),
    ("dribbles_rolling_5", "dribbles", 5, "mean"),
]
# The panel has no such column: the feature is NULL.
_ABSENT = {"dribbles"}
_SQL_AGG = {"mean": "avg", "sum": "sum", "std": "stddev_samp"}


def rolling_sql() -> str:
    cols = []
    for out, src, n, fn in ROLLING_SPECS:
        if src in _ABSENT:
            cols.append(f"cast(null as double) as {out}")
        else:
            cols.append(
                f"round({_SQL_AGG[fn]}({src}) over (partition by season, element order by gw"
                f" rows between {n} preceding and 1 preceding)::double, 6) as {out}"
            )
    return ",\n".join(cols)


@query("e01_lagged_rolling", f"with @PA select season, element, gw, {rolling_sql()} from pa")
def e01(spark, sf):
    out = W.lagged_rolling(panel_agg(spark, sf), KEYS, "gw", ROLLING_SPECS)
    return out.select(*KEYS, "gw", *[r6(F.col(s[0]).cast("double")).alias(s[0]) for s in ROLLING_SPECS])


@query("e02_lagged_expanding", """with @PA select season, element, gw,
 round(avg(total_points) over w, 6) as season_avg_pts, (sum(minutes) over w)::bigint as season_total_mins,
 coalesce(sum(case when minutes > 0 then 1 else 0 end) over w, 0)::bigint as games_played
 from pa window w as (partition by season, element order by gw rows between unbounded preceding and 1 preceding)""")
def e02(spark, sf):
    out = W.lagged_expanding(panel_agg(spark, sf), KEYS, "gw", [
        ("season_avg_pts", "total_points", "mean"), ("season_total_mins", "minutes", "sum"),
        ("games_played", "minutes", "count_positive")])
    return out.select(*KEYS, "gw", r6("season_avg_pts").alias("season_avg_pts"), "season_total_mins", "games_played")


@query("e03_momentum", """with @PA select season, element, gw,
 value - lag(value) over w as value_momentum, selected - lag(selected) over w as selected_momentum
 from pa window w as (partition by season, element order by gw)""")
def e03(spark, sf):
    out = W.momentum(panel_agg(spark, sf), KEYS, "gw", ["value", "selected"])
    return out.select(*KEYS, "gw", "value_momentum", "selected_momentum")


@query("e04_team_rolling", """with @PG,
 gc as (select season, team, gw, sum(m)::bigint as team_goals_conceded from
   (select season, team, gw, fixture, max(goals_conceded) as m from pg group by all) group by all),
 pts as (select season, opponent_team as team, gw, sum(total_points)::bigint as team_pts_faced from pg group by all),
 j as (select coalesce(a.season, b.season) as season, coalesce(a.team, b.team) as team, coalesce(a.gw, b.gw) as gw,
   team_goals_conceded, team_pts_faced from gc a full join pts b on a.season = b.season and a.team = b.team and a.gw = b.gw)
 select season, team, gw, round(avg(team_goals_conceded) over w, 6) as goals_conceded_r5,
  round(avg(team_pts_faced) over w, 6) as pts_conceded_r5 from j
 window w as (partition by season, team order by gw rows between 5 preceding and 1 preceding)""")
def e04(spark, sf):
    pg = panel(spark, sf)
    gc = two_level(pg, ["season", "team", "gw", "fixture"], ["season", "team", "gw"], "goals_conceded", "team_goals_conceded")
    pts = target(pg, ["season", "opponent_team", "gw"], "total_points", "team_pts_faced").withColumnRenamed("opponent_team", "team")
    out = W.team_rolling(gc, pts, ["season", "team"], "gw",
                         {"team_goals_conceded": "goals_conceded_r5", "team_pts_faced": "pts_conceded_r5"})
    return out.select("season", "team", "gw", r6("goals_conceded_r5").alias("goals_conceded_r5"),
                      r6("pts_conceded_r5").alias("pts_conceded_r5"))


@query("e05_time_window_mean", """with @PG, cut as (select season, gw, min(kickoff) as cutoff from pg group by all)
 select p.season, p.element, c.gw, round(avg(p.total_points), 6) as window_mean, count(*) as n_rows
 from pg p join cut c on p.season = c.season and p.gw < c.gw and p.kickoff < c.cutoff
  and p.kickoff >= c.cutoff - interval 30 days
 where p.minutes > 0 group by all""")
def e05(spark, sf):
    pg = written_panel(spark, sf, ["season", "element", "gw", "kickoff", "minutes", "total_points"])
    cut = period_cutoffs(pg, ["season"], "gw", "kickoff")
    out = W.time_window_mean(pg.where("minutes > 0"), cut, ["season"], "element", "gw", "kickoff", "total_points", 30)
    return out.select("season", "element", "gw", r6("window_mean").alias("window_mean"), "n_rows")


@query("e06_trailing_streak", """with @PA, r as (select season, element, gw, minutes < 250 as z,
   row_number() over (partition by season, element order by gw) as rn from pa),
 b as (select a.season, a.element, a.gw, a.rn, max(case when not p.z then p.rn end) as last_break, count(p.rn) as n
   from r a left join r p on p.season = a.season and p.element = a.element and p.rn between a.rn - 3 and a.rn - 1 group by all)
 select season, element, gw, (case when last_break is null then n else rn - 1 - last_break end)::int as streak from b""")
def e06(spark, sf):
    out = W.trailing_streak(panel_agg(spark, sf), KEYS, "gw", F.col("minutes") < 250, cap=3)
    return out.select(*KEYS, "gw", "streak")


@query("e07_last_k_rows", """with @PA select season, element, gw, round(avg(minutes) over w3, 6) as mins_last3,
  max(case when minutes > 200 then 1 else 0 end) over w3 as any_played3, round(avg(total_points) over w5, 6) as pts_last5
 from pa window w3 as (partition by season, element order by gw rows between 3 preceding and 1 preceding),
  w5 as (partition by season, element order by gw rows between 5 preceding and 1 preceding)""")
def e07(spark, sf):
    pa = panel_agg(spark, sf)
    out = W.last_k(pa, KEYS, "gw", 3, {
        "mins_last3": F.avg("minutes"), "any_played3": F.max(F.when(F.col("minutes") > 200, 1).otherwise(0))})
    out = W.last_k(out, KEYS, "gw", 5, {"pts_last5": F.avg("total_points")})
    return out.select(*KEYS, "gw", r6("mins_last3").alias("mins_last3"), "any_played3", r6("pts_last5").alias("pts_last5"))


@query("e08_period_window_mean", """with @PA select season, element, gw, round(avg(total_points) over
  (partition by season, element order by gw range between 5 preceding and 1 preceding), 6) as form from pa""")
def e08(spark, sf):
    out = W.period_window_mean(panel_agg(spark, sf), KEYS, "gw", "total_points", 5)
    return out.select(*KEYS, "gw", r6("form").alias("form"))


@query("e09_shift", """with @PA select season, element, gw, lag(total_points) over w as total_points, lag(minutes) over w as minutes
 from pa window w as (partition by season, element order by gw)""")
def e09(spark, sf):
    return W.shift(panel_agg(spark, sf), KEYS, "gw", ["total_points", "minutes"]).select(*KEYS, "gw", "total_points", "minutes")


SYNTHETIC_SQL = """with @PG,
 a as (select season, element, gw, sum(total_points)::bigint as pts, sum(minutes)::bigint as mins, count(*) as n_fix,
   first(team order by seq_day, seq_line, seq_part) as team, first(opponent_team order by seq_day, seq_line, seq_part) as opp
   from pg group by season, element, gw),
 f as (select *, avg(pts) over (partition by season, element order by gw rows between 5 preceding and 1 preceding) as form,
   avg(mins) over (partition by season, element order by gw rows between 3 preceding and 1 preceding) as m3 from a),
 t as (select season, team, gw, avg(pts) as team_pts from a group by all),
 tf as (select season, team, gw, avg(team_pts) over (partition by season, team order by gw rows between 5 preceding and 1 preceding) as team_form from t),
 j as (select f.*, round_even((coalesce(o.team_form, 0) - coalesce(p.team_form, 0)) * 2, 0) / 2 as raw from f
   left join tf o on f.season = o.season and f.team = o.team and f.gw = o.gw
   left join tf p on f.season = p.season and f.opp = p.team and f.gw = p.gw),
 k as (select *, least(greatest(raw, -1.0), 1.0) as off, case when m3 is not null then least(greatest(m3 / 90, 0.0), 1.0) end as prob from j)
 select season, element, gw, round((coalesce(form, 0) + off) * prob * n_fix, 6) as synthetic_ep,
  round(prob, 6) as playing_prob, round(off, 6) as fixture_offset from k"""


@query("e10_synthetic_ep", SYNTHETIC_SQL)
def e10(spark, sf):
    out = synthetic_ep(panel(spark, sf), "season", "element", "gw", "team", "opponent_team", "total_points", "minutes", "seq")
    return out.select(*KEYS, "gw", *[r6(c).alias(c) for c in ("synthetic_ep", "playing_prob", "fixture_offset")])


@query("e11_top_n_with_protected", """with @PA, r as (select season, gw, element, element % 4 as pos, total_points, element % 17 = 0 as owned from pa),
 k as (select *, row_number() over (partition by season, gw, pos, owned order by total_points desc, element) as rn from r)
 select season, gw, pos, element, total_points, owned from k where owned or rn <= 5""")
def e11(spark, sf):
    df = panel_agg(spark, sf).selectExpr("season", "gw", "element", "element % 4 as pos", "total_points", "element % 17 = 0 as owned")
    out = W.top_n_with_protected(df, ["season", "gw", "pos"], "total_points", "element", 5, F.col("owned"))
    return out.select("season", "gw", "pos", "element", "total_points", "owned")


@query("e12_candidate_pool", """with @PA, f as (select season, gw, element, element % 4 as g, avg(total_points) over
   (partition by season, element order by gw range between 5 preceding and 1 preceding) as form from pa),
 r as (select *, row_number() over (partition by season, gw, g order by coalesce(form, 0) desc, element) as gr from f where element % 17 <> 0),
 s as (select *, row_number() over (partition by season, gw order by case when gr <= 12 then 0 else 1 end, g, gr) as pr from r)
 select season, gw, element, ['GK', 'DEF', 'MID', 'FWD'][g + 1] as position, gr::int as group_rank, pr::int as pool_rank from s where pr <= 50""")
def e12(spark, sf):
    pa = W.period_window_mean(panel_agg(spark, sf), KEYS, "gw", "total_points", 5)
    names = F.array(*[F.lit(p) for p in POSITIONS])
    df = pa.select("season", "gw", "element", F.element_at(names, (F.col("element") % 4 + 1).cast("int")).alias("position"),
                   F.coalesce("form", F.lit(0.0)).alias("form"))
    members = df.where("element % 17 = 0").select("season", "gw", "element")
    out = W.candidate_pool(df, members, ["season", "gw"], "position", "element", "form", POSITIONS, 12, 50)
    return out.select("season", "gw", "element", "position", "group_rank", "pool_rank")


@query("e13_running", """with d as (select event_type, event_id, cast(round(value * 100) as bigint) as v from events)
 select event_type, event_id, sum(v) over w::bigint as running_sum, max(v) over w as running_max from d
 window w as (partition by event_type order by event_id rows between unbounded preceding and current row)""")
def e13(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_type", "event_id", "cast(round(value * 100) as bigint) as v")
    out = running(df, ["event_type"], "event_id", {"running_sum": ("v", "sum"), "running_max": ("v", "max")})
    return out.select("event_type", "event_id", "running_sum", "running_max")


_LOGS_SQL = """lg as (select event_type as run, event_id as seq, event_id * 10 - case when event_id % 97 < 5 then 400 else 0 end as step from events)"""


@query("e14_resume_dedup", f"""with {_LOGS_SQL},
 m as (select *, min(step) over (partition by run order by seq rows between 1 following and unbounded following) as later from lg)
 select run, seq, step from m where later is null or step < later""")
def e14(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_type as run", "event_id as seq", "event_id * 10 - case when event_id % 97 < 5 then 400 else 0 end as step")
    return W.resume_dedup(df, ["run"], "seq", "step").select("run", "seq", "step")


@query("e15_argmax_membership", """with @PA, p as (select season, gw, element, total_points as actual, lag(total_points) over
   (partition by season, element order by gw) as pred from pa),
 r as (select *, row_number() over (partition by season, gw order by pred desc, element) as rp,
   row_number() over (partition by season, gw order by actual desc, element) as ra from p where pred is not null)
 select season, gw, max(case when rp = 1 then element end) as pred_top, max(case when ra = 1 then element end) as actual_top,
  max(case when rp = 1 then case when ra <= 5 then 1 else 0 end end) as pred_in_actual_top,
  max(case when ra = 1 then case when rp <= 5 then 1 else 0 end end) as actual_in_pred_top
 from r group by season, gw""")
def e15(spark, sf):
    df = W.shift(panel_agg(spark, sf).withColumn("pred", F.col("total_points")), KEYS, "gw", ["pred"]).where("pred is not null")
    out = ranks.argmax_membership(df, ["season", "gw"], "element", "pred", "total_points", 5)
    return out.select("season", "gw", "pred_top", "actual_top", "pred_in_actual_top", "actual_in_pred_top")


@query("e16_competition_rank", """with @PA select season, gw, element, total_points,
  count(*) over (partition by season, gw order by total_points desc range between unbounded preceding and current row) as n_at_least from pa""")
def e16(spark, sf):
    out = ranks.competition_rank(panel_agg(spark, sf), ["season", "gw"], "total_points", "n_at_least")
    return out.select("season", "gw", "element", "total_points", "n_at_least")


@query("e17_average_rank", """with @PA select season, gw, element,
  rank() over (partition by season, gw order by total_points) + (count(*) over (partition by season, gw, total_points) - 1) / 2.0 as rank_points,
  rank() over (partition by season, gw order by minutes) + (count(*) over (partition by season, gw, minutes) - 1) / 2.0 as rank_minutes from pa""")
def e17(spark, sf):
    out = ranks.average_rank(panel_agg(spark, sf), ["season", "gw"], {"total_points": "rank_points", "minutes": "rank_minutes"})
    return out.select("season", "gw", "element", "rank_points", "rank_minutes")
