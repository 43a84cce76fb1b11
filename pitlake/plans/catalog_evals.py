"""Checked queries: set operations, folds, evaluation and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r6
from ..operators import evals as H
from ..operators import folds as G
from ..operators import setops as S
from ..operators import windows as W
from ..operators.joins import scaffold
from .binding import panel, panel_agg, table, written_panel
from .catalog_scalars import _FORM_SQL, _GRID_SQL, EXPECTED_COLS, expected, grid
from .registry import query

KEYS = ["season", "element", "gw"]
P = ["season", "gw"]


def r(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


# ---------------------------------------------------------------- set operations


@query("f01_top_k", "select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 25")
def f01(spark, sf):
    return S.top_k(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 25, "p_partkey")


@query("f02_union_seasons", """with @PA select season, element, gw, total_points, case when season >= 1998 then saves end as saves, case when season < 1998 then bonus end as bonus from pa""")
def f02(spark, sf):
    pa = panel_agg(spark, sf)
    old = pa.where("season < 1998").select(*KEYS, "total_points", "bonus")
    new = pa.where("season >= 1998").select("saves", *KEYS, "total_points")
    return S.union_seasons(old, new)


@query("f03_dedup_first", """select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn from orders) where rn = 1""")
def f03(spark, sf):
    return S.dedup_first(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("f04_membership_diff", """with @PG, m as (select distinct team, season * 100 + gw as period, opponent_team as member from pg),
 d as (select team, period, lag(period) over (partition by team order by period) as prev from (select distinct team, period from m))
 select d.team, d.period, m.member, 'in' as change from d join m on m.team = d.team and m.period = d.period where prev is not null
   and not exists (select 1 from m x where x.team = d.team and x.period = d.prev and x.member = m.member)
 union all select d.team, d.period, m.member, 'out' from d join m on m.team = d.team and m.period = d.prev
   where not exists (select 1 from m x where x.team = d.team and x.period = d.period and x.member = m.member)""")
def f04(spark, sf):
    m = panel(spark, sf).selectExpr("team", "season * 100 + gw as period", "opponent_team as member")
    return S.membership_diff(m, "team", "period", "member")


@query("f05_available", """with @PG select distinct season, element from pg intersect select season, element from (select distinct season, s_suppkey as element from supplier, pg) order by 1, 2""")
def f05(spark, sf):
    """Every supplier is required in every season of the data."""
    pg = panel(spark, sf)
    required = scaffold(table(spark, sf, "supplier").selectExpr("s_suppkey as element", "1 as one"), pg.select("season", F.lit(1).alias("one")).distinct(), ["one"])
    return S.available(required.select("season", "element"), pg, ["season", "element"])


# ---------------------------------------------------------------- folds and variants

@query("g01_temporal_folds", """with @PA, sx as (select season, row_number() over (order by season) - 1 as pos, max(gw) - 4 as cut from pa where season <> (select max(season) from pa) group by season),
 f as (select pos as i, season from sx where pos >= 2)
 select pa.season, pa.element, pa.gw, (f.i - 1)::int as fold, case when sx.pos = f.i then 'test' when sx.pos = f.i - 1 and pa.gw > sx.cut then 'val' else 'train' end as role
 from pa join sx on sx.season = pa.season join f on f.i >= sx.pos""")
def g01(spark, sf):
    df = panel_agg(spark, sf).select(*KEYS)
    return G.temporal_folds(df, "season", "gw", min_train=2, val=4)


@query("g03_predict_default", "with @PA select season, element, gw, 2.0::double as prediction from pa")
def g03(spark, sf):
    from ..operators.model import predict_routed

    df = panel_agg(spark, sf).select(*KEYS, "minutes").withColumn("position", F.lit(None).cast("string"))
    return predict_routed({}, df, "position").select(*KEYS, "prediction")


@query("g06_feature_columns", "with @PA select season, total_points, minutes, bonus from pa")
def g06(spark, sf):
    df = panel_agg(spark, sf).select(*KEYS, "total_points", "minutes", "bonus")
    return df.select("season", *G.feature_columns(df, ["season", "element", "gw"]))


@query("g08_ablation_variants", """with @PA, b as (select season, element, gw, minutes, bonus, saves from pa)
 select season, element, gw, minutes, bonus, saves, 'baseline' as variant from b
 union all select season, element, gw, lag(minutes) over (partition by season, element order by gw), bonus, saves, 'shifted' from b
 union all select season, element, gw, minutes, null, saves, 'nulled' from b union all select season, element, gw, minutes, bonus, null, 'dropped' from b""")
def g08(spark, sf):
    df = panel_agg(spark, sf).select(*KEYS, "minutes", "bonus", "saves")
    return G.ablation_variants(df, ["season", "element"], "gw", ["minutes"], ["bonus"], ["saves"])


@query("g09_season_split", """with @PA, x as (select max(season) as last, max(season) filter (where season < (select max(season) from pa)) as late from pa),
 c as (select max(gw) - 8 as cut from pa where season = (select late from x))
 select season, element, gw, case when season = last then 'holdout' when season = late and gw > cut then 'val' else 'train' end as role from pa, c, x""")
def g09(spark, sf):
    """All rows: the last season of the data is held out."""
    return G.season_split(panel_agg(spark, sf).select(*KEYS), "season", "gw")


# ---------------------------------------------------------------- evaluation

_ROLL = "avg(total_points) over (partition by season, element order by gw rows between 3 preceding and 1 preceding)"
_PRED_SQL = f"""pp as (select season, element, gw, total_points as actual, minutes, {_ROLL} as pred, ['GK', 'DEF', 'MID', 'FWD'][element % 4 + 1] as position from pa),
 pd as (select * from pp where pred is not null)"""


def predictions(spark, sf):
    """A naive model: the mean of the last three periods."""
    pa = W.lagged_rolling(panel_agg(spark, sf), ["season", "element"], "gw", [("pred", "total_points", 3, "mean")])
    position = F.element_at(F.array(F.lit("GK"), F.lit("DEF"), F.lit("MID"), F.lit("FWD")), (F.col("element") % 4 + 1).cast("int"))
    return pa.where("pred is not null").select(*KEYS, F.col("total_points").alias("actual"), "minutes", "pred", position.alias("position"))


def _corr(a: str, b: str) -> str:
    return f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


_ERR = f"count(*) as n, round(avg(abs(actual - pred)), 6) as mae, round(sqrt(avg((actual - pred) * (actual - pred))), 6) as rmse, round({_corr('pred', 'actual')}, 6) as corr"


@query("h01_error_metrics", f"""with @PA, {_PRED_SQL} select 'overall' as level, 'all' as key, {_ERR} from pd
 union all select 'season', season::varchar, {_ERR} from pd group by season union all select 'position', position, {_ERR} from pd group by position""")
def h01(spark, sf):
    return r(H.error_metrics_sets(predictions(spark, sf), "pred", "actual", ["season", "position"]), "mae", "rmse", "corr")


@query("h02_mean_period_corr", f"""with @PA, {_PRED_SQL}, c as (select season, gw, {_corr('pred', 'actual')} as corr from pd group by all having count(*) > 20)
 select count(*) as n_periods, round(avg(corr), 6) as mean_corr, round(quantile_cont(corr, 0.5), 6) as median_corr from c where corr is not null""")
def h02(spark, sf):
    return r(H.mean_period_corr(predictions(spark, sf), P, "pred", "actual", 20), "mean_corr", "median_corr")


@query("h03_mean_period_spearman", f"""with @PA, {_PRED_SQL}, k as (select season, gw,
   rank() over (partition by season, gw order by pred) + (count(*) over (partition by season, gw, pred) - 1) / 2.0 as rx,
   rank() over (partition by season, gw order by actual) + (count(*) over (partition by season, gw, actual) - 1) / 2.0 as ry from pd),
 c as (select season, gw, {_corr('rx', 'ry')} as corr from k group by all having count(*) > 10)
 select count(*) as n_periods, round(avg(corr), 6) as mean_corr, round(quantile_cont(corr, 0.5), 6) as median_corr from c where corr is not null""")
def h03(spark, sf):
    return r(H.mean_period_spearman(predictions(spark, sf), P, "pred", "actual", 10), "mean_corr", "median_corr")


@query("h03_spearman_played", f"""with @PA, {_PRED_SQL}, q as (select * from pd where minutes > 300), k as (select season, gw,
   rank() over (partition by season, gw order by pred) + (count(*) over (partition by season, gw, pred) - 1) / 2.0 as rx,
   rank() over (partition by season, gw order by actual) + (count(*) over (partition by season, gw, actual) - 1) / 2.0 as ry from q),
 c as (select season, gw, {_corr('rx', 'ry')} as corr from k group by all having count(*) > 10)
 select count(*) as n_periods, round(avg(corr), 6) as mean_corr, round(quantile_cont(corr, 0.5), 6) as median_corr from c where corr is not null""")
def h03b(spark, sf):
    played = predictions(spark, sf).where("minutes > 300")
    return r(H.mean_period_spearman(played, P, "pred", "actual", 10), "mean_corr", "median_corr")


@query("h04_threshold_means", f"""with @PA, {_PRED_SQL} select count(*) filter (where actual >= 50) as n_high, round(avg(pred) filter (where actual >= 50), 6) as mean_pred_high,
 count(*) filter (where actual < 50) as n_low, round(avg(pred) filter (where actual < 50), 6) as mean_pred_low from pd""")
def h04(spark, sf):
    return r(H.threshold_means(predictions(spark, sf), "pred", "actual", 50), "mean_pred_high", "mean_pred_low")


@query("h05_tolerance_shares", f"""with @PA, {_PRED_SQL}, d as (select season, abs(pred - actual) as e from pd)
 select season, '<1' as tolerance, round(avg((e < 1)::int), 6) as share from d group by season union all select season, '<2', round(avg((e < 2)::int), 6) from d group by season
 union all select season, '<3', round(avg((e < 3)::int), 6) from d group by season union all select season, '<0.01', round(avg((e < 0.01)::int), 6) from d group by season
 union all select season, '<=0.5', round(avg((e <= 0.5)::int), 6) from d group by season union all select season, '<=1', round(avg((e <= 1.0)::int), 6) from d group by season""")
def h05(spark, sf):
    return r(H.tolerance_shares(predictions(spark, sf), "pred", "actual", [1, 2, 3, 0.01], [0.5, 1.0], ["season"]), "share")


_XP_SQL = "xq as (select season, element, gw, avg(xp) as xp, sum(total_points)::bigint as actual from pg group by all)"


@query("h06_zero_confusion", f"""with @PG, {_FORM_SQL}, xz as (select season, element, gw, sum(case when minutes > 0 then bonus else 0 end)::bigint as xp from pg group by all)
 select ep.season, count(*) filter (where xp = 0 and ep = 0) as both_zero, count(*) filter (where xp > 0 and ep = 0) as false_negative,
  count(*) filter (where xp = 0 and ep > 0) as false_positive, count(*) filter (where xp = 0) as n_zero
 from ep join xz on xz.season = ep.season and xz.element = ep.element and xz.gw = ep.gw group by ep.season""")
def h06(spark, sf):
    pg = written_panel(spark, sf, [*EXPECTED_COLS, "bonus"])
    xz = pg.groupBy(*KEYS).agg(F.sum(F.when(F.col("minutes") > 0, F.col("bonus")).otherwise(0)).alias("xp"))
    return H.zero_confusion(expected(spark, sf, pg).join(xz, KEYS), "xp", "ep", ["season"])


def _board_sql(corr_digits: int = 6) -> str:
    return f"""gx as (select g.season, g.element, g.gw, g.variant, g.ep as val, xq.xp, xq.actual from grid g join xq on xq.season = g.season and xq.element = g.element and xq.gw = g.gw),
 ga as (select * from gx union all select season, element, gw, 'reference', xp, xp, actual from gx where variant = 'A'),
 pc as (select variant, season, gw, {_corr('val', 'actual')} as corr from ga group by all having count(*) > 20),
 pm as (select variant, avg(corr) as period_corr from pc where corr is not null group by variant),
 bd as (select ga.variant, round({_corr('val', 'xp')}, 6) as corr_ref, round(avg(abs(val - xp)), 6) as mae_ref, round({_corr('val', 'actual')}, 6) as corr_actual,
   round(avg((abs(val - xp) < 0.01)::int), 6) as exact, round(avg((abs(val - xp) <= 0.5)::int), 6) as within_05, round(avg((abs(val - xp) <= 1.0)::int), 6) as within_10,
   any_value(period_corr) as period_corr from ga left join pm on pm.variant = ga.variant group by ga.variant)"""


def board(spark, sf):
    rows = grid(spark, sf).withColumnRenamed("total_points", "actual")
    return H.leaderboard(rows, "variant", "ep", "xp", "actual", P, "A")


@query("h07_leaderboard", f"with @PG, {_GRID_SQL}, {_XP_SQL}, {_board_sql()} select * replace (round(period_corr, 6) as period_corr) from bd")
def h07(spark, sf):
    return r(board(spark, sf), "corr_ref", "mae_ref", "corr_actual", "exact", "within_05", "within_10", "period_corr")


@query("h08_gap_closed", f"""with @PG, {_GRID_SQL}, {_XP_SQL}, {_board_sql()},
 z as (select max(period_corr) filter (where variant = 'reference') as ref, max(period_corr) filter (where variant = 'A') as base, max(period_corr) filter (where variant <> 'reference') as best_value from bd)
 select (select max(variant) from bd where variant <> 'reference' and period_corr = best_value) as best, round(best_value, 6) as best_value, round(base, 6) as baseline, round(ref, 6) as reference,
  round(best_value - base, 6) as gap_closed, round((best_value - base) / nullif(ref - base, 0), 6) as share_closed from z""")
def h08(spark, sf):
    return r(H.gap_closed(board(spark, sf), "variant", "A"), "best_value", "baseline", "reference", "gap_closed", "share_closed")


@query("h09_captain_hit_rate", f"""with @PA, {_PRED_SQL}, s as (select *, row_number() over (partition by season, gw order by pred desc, element) as rp from pd),
 t as (select *, row_number() over (partition by season, gw order by actual desc, element) as ra, count(*) over (partition by season, gw) as n from s where rp <= 11)
 select count(*) as n_periods, round(avg((ra = 1)::int), 6) as hit_rate, round(avg((ra <= 3)::int), 6) as top_k_rate, round(1 / 11.0::double, 6) as random_rate from t where rp = 1 and n = 11""")
def h09(spark, sf):
    return r(H.captain_hit_rate(predictions(spark, sf), P, "element", "pred", "actual"), "hit_rate", "top_k_rate", "random_rate")


@query("h10_lookahead_flag", f"""with @PA, {_PRED_SQL}, l as (select season, gw, case when gw % 5 = 0 then actual else pred end as pred, actual from pd)
 select season, gw, round(avg((abs(pred - actual) < 0.01)::int), 6) as share_equal, avg((abs(pred - actual) < 0.01)::int) > 0.5 as suspicious from l group by all""")
def h10(spark, sf):
    leaky = predictions(spark, sf).withColumn("pred", F.when(F.col("gw") % 5 == 0, F.col("actual").cast("double")).otherwise(F.col("pred")))
    return r(H.lookahead_flag(leaky, "pred", "actual", P), "share_equal")


@query("h11_compare_variants", f"""with @PA, {_PRED_SQL}, v as (select position, 'a' as variant, pred, actual from pd union all select position, 'b', pred * 0.5::double + 10, actual from pd),
 m as (select position, variant, avg(abs(actual - pred)) as mae, sqrt(avg((actual - pred) * (actual - pred))) as rmse from v group by all)
 select position, round(max(mae) filter (where variant = 'a'), 6) as mae_a, round(max(mae) filter (where variant = 'b'), 6) as mae_b,
  round(max(rmse) filter (where variant = 'a'), 6) as rmse_a, round(max(rmse) filter (where variant = 'b'), 6) as rmse_b,
  round(max(mae) filter (where variant = 'b') - max(mae) filter (where variant = 'a'), 6) as mae_delta,
  round(max(rmse) filter (where variant = 'b') - max(rmse) filter (where variant = 'a'), 6) as rmse_delta from m group by position""")
def h11(spark, sf):
    p = predictions(spark, sf)
    variants = F.array(F.struct(F.lit("a").alias("variant"), F.col("pred").alias("p")), F.struct(F.lit("b").alias("variant"), (F.col("pred") * 0.5 + 10).alias("p")))
    both = p.select("position", "actual", F.inline(variants))
    metrics = H.error_metrics(both, "p", "actual", ["position", "variant"])
    out = H.compare_variants(metrics, ["position"], "variant", "a", "b", ["mae", "rmse"])
    return r(out, "mae_a", "mae_b", "rmse_a", "rmse_b", "mae_delta", "rmse_delta")


@query("h12_outcome_split", f"""with @PG, {_XP_SQL}, m as (select xq.*, (select 1) as one from xq), a as (select p.season, p.element, p.gw, sum(minutes) > 300 as played from pg p group by all)
 select played, count(*) as n, round({_corr('xp', 'actual')}, 6) as corr, round(avg(xp), 6) as mean_x, round(avg((xp = 0)::int), 6) as zero_rate
 from m join a on a.season = m.season and a.element = m.element and a.gw = m.gw group by played""")
def h12(spark, sf):
    rows = panel(spark, sf).groupBy(*KEYS).agg(F.avg("xp").alias("xp"), F.sum("total_points").alias("actual"), F.sum("minutes").alias("minutes"))
    return r(H.outcome_split(rows, F.col("minutes") > 300, "xp", "actual"), "corr", "mean_x", "zero_rate")


@query("h13_retention", "with @PG select season, count(*) as n_total, count(*) filter (where position is not null and saves > 0) as n_usable, round(avg((position is not null and saves > 0)::int), 6) as usable_share from pg group by season")
def h13(spark, sf):
    df = panel(spark, sf).withColumn("saves", F.expr("nullif(saves, 0)"))
    return r(H.retention(df, ["position", "saves"], ["season"]), "usable_share")


@query("h14_importance_groups", """with t as (select p_name as feature, sum(p_size)::bigint as importance from part group by 1),
 g as (select *, case when contains(feature, 'ring') then 'ring' when contains(feature, 'bolt') or contains(feature, 'gear') then 'metal' else 'other' end as feature_group from t)
 select feature_group, count(*) as n_features, sum(importance)::bigint as importance, round(sum(importance) / (select sum(importance) from t), 6) as share from g group by feature_group""")
def h14(spark, sf):
    t = table(spark, sf, "part").groupBy(F.col("p_name").alias("feature")).agg(F.sum("p_size").alias("importance"))
    return r(H.importance_groups(t, "feature", "importance", {"ring": ["ring"], "metal": ["bolt", "gear"]}), "share")


@query("h14_importance_rank", "with t as (select p_name as feature, sum(p_size)::bigint as importance from part group by 1) select feature, importance, rank() over (order by importance desc)::bigint as rank from t")
def h14b(spark, sf):
    from ..operators.scale import value_ranks

    t = table(spark, sf, "part").groupBy(F.col("p_name").alias("feature")).agg(F.sum("p_size").alias("importance"))
    return t.join(value_ranks(t, [], "importance").selectExpr("importance", "n_greater + 1 as rank"), "importance").select("feature", "importance", "rank")


@query("h15_period_summary", f"with @PA, {_PRED_SQL} select season, gw, count(*) as n, round(avg(actual), 6) as mean_actual, round(avg(pred), 6) as mean_pred, round(avg(abs(actual - pred)), 6) as mae from pd group by all")
def h15(spark, sf):
    return r(H.period_summary(predictions(spark, sf), P, "pred", "actual"), "mean_actual", "mean_pred", "mae")


@query("h15_median_period_top", f"""with @PA, {_PRED_SQL}, m as (select season, floor(quantile_cont(gw, 0.5))::bigint as gw from (select distinct season, gw from pd) group by season),
 t as (select pd.*, row_number() over (partition by pd.season order by pred desc, element) as rank from pd join m on m.season = pd.season and m.gw = pd.gw)
 select season, gw, element, s_name as name, round(pred, 6) as pred, actual, rank::int as rank from t left join supplier on s_suppkey = element where rank <= 10""")
def h15b(spark, sf):
    names = table(spark, sf, "supplier").selectExpr("s_suppkey as element", "s_name as name")
    out = H.median_period_top(predictions(spark, sf), ["season"], "gw", "element", "pred", names, 10)
    return r(out, "pred").select(*KEYS, "name", "pred", "actual", "rank")
