"""Checked queries: projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.names import normalise_name
from ..functions.stats import r6
from ..operators import aggs as A
from ..operators import features as X
from ..operators import windows as W
from ..operators.scale import grown_join
from ..session import materialise
from .binding import POSITIONS, panel, panel_agg, prices, squads, table, transfers, written_panel
from .catalog_windows import ROLLING_SPECS
from .registry import query

KEYS = ["season", "element"]


@query("b01_coerce_numeric", """select p_partkey, try_cast(case when p_partkey % 4 = 0 then 'x' || p_size else cast(p_size as varchar) end as double) as size,
 coalesce(try_cast(case when p_partkey % 3 = 0 then '' else cast(p_retailprice as varchar) end as double), 0.0) as price from part""")
def b01(spark, sf):
    t = table(spark, sf, "part").selectExpr(
        "p_partkey", "case when p_partkey % 4 = 0 then concat('x', p_size) else cast(p_size as string) end as size",
        "case when p_partkey % 3 = 0 then '' else cast(p_retailprice as string) end as price")
    return S.coerce_numeric(S.coerce_numeric(t, ["size"]), ["price", "absent"], 0.0)


_SPELLINGS = "case o_orderkey % 7 when 0 then 'True' when 1 then 'False' when 2 then 'true' when 3 then '1' when 4 then '0' when 5 then 'yes' end"


@query("b02_coerce_boolean", f"select o_orderkey, coalesce(lower({_SPELLINGS}) in ('true', '1'), false) as was_home from orders")
def b02(spark, sf):
    t = table(spark, sf, "orders").selectExpr("o_orderkey", f"{_SPELLINGS} as was_home")
    return t.select("o_orderkey", S.coerce_boolean("was_home").alias("was_home"))


_LABELS = "case s_suppkey % 8 when 0 then '1' when 1 then '2' when 2 then 'GKP' when 3 then 'AM' when 4 then 'FWD' when 5 then '4' when 6 then 'COACH' end"


@query("b03_normalise_label", f"""select s_suppkey, case {_LABELS} when '1' then 'GK' when '2' then 'DEF' when 'GKP' then 'GK' when 'AM' then 'MID'
 when '4' then 'FWD' else {_LABELS} end as position from supplier""")
def b03(spark, sf):
    t = table(spark, sf, "supplier").selectExpr("s_suppkey", f"{_LABELS} as position")
    return t.select("s_suppkey", S.normalise_label("position").alias("position"))


@query("b04_rename_canonical", "select s_suppkey as element, s_name as name, s_acctbal as value from supplier")
def b04(spark, sf):
    t = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return S.rename_canonical(t, {"s_suppkey": "element", "s_name": "name", "s_acctbal": "value", "round": "gw"})


@query("b05_normalise_name", "select doc_id, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) as norm from documents")
def b05(spark, sf):
    return table(spark, sf, "documents").select("doc_id", normalise_name("text").alias("norm"))


@query("b06_apply_alias", """with al as (select n_name as alias, n_name || ' FC' as name from nation where n_nationkey % 2 = 0)
 select c_custkey, coalesce(al.name, n.n_name) as team_name from customer join nation n on c_nationkey = n_nationkey left join al on al.alias = n.n_name""")
def b06(spark, sf):
    nation = table(spark, sf, "nation")
    aliases = nation.where("n_nationkey % 2 = 0").selectExpr("n_name as alias", "concat(n_name, ' FC') as name")
    t = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey", "n_name as team_name")
    return S.apply_alias(t, "team_name", aliases)


@query("b07_parse_percent", """select l_orderkey, l_linenumber, l_partkey, try_cast(trim(replace(case when l_linenumber = 7 then '-' else
 ' ' || cast(round(l_discount * 100)::int as varchar) || '% ' end, '%', '')) as double) as pct from lineitem""")
def b07(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey",
        "case when l_linenumber = 7 then '-' else concat(' ', cast(round(l_discount * 100) as int), '% ') end as raw")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", S.parse_percent("raw").alias("pct"))


@query("b08_parse_timestamp", """select o_orderkey, case when o_orderkey % 4 = 3 then null when o_orderkey % 4 = 2 then o_orderdate + interval 2 hour
 when o_orderkey % 4 = 1 then o_orderdate + interval 15 hour else o_orderdate end as kickoff from orders""")
def b08(spark, sf):
    t = table(spark, sf, "orders").selectExpr(
        "o_orderkey", """case o_orderkey % 4 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, "yyyy-MM-dd '15:00:00'")
        when 2 then date_format(o_orderdate, "yyyy-MM-dd'T02:00:00Z'") else 'postponed' end as raw""")
    return t.select("o_orderkey", S.parse_timestamp_utc("raw").alias("kickoff"))


@query("b09_season_key", """with s as (select distinct year(o_orderdate) as y from orders)
 select y || '-' || lpad(((y + 1) % 100)::varchar, 2, '0') as season, y::int as start_year, y || '-' || (y + 1) as long_key,
 (y - 1) || '-' || lpad((y % 100)::varchar, 2, '0') as previous_key from s""")
def b09(spark, sf):
    s = table(spark, sf, "orders").select(F.year("o_orderdate").alias("y")).distinct().selectExpr(
        "concat(y, '-', lpad((y + 1) % 100, 2, '0')) as season")
    return s.select("season", S.season_key("season", "start").alias("start_year"), S.season_key("season", "long").alias("long_key"),
                    S.season_key("season", "previous").alias("previous_key"))


_ODDS_DUCK = """od as (select o_orderkey, year(o_orderdate)::bigint as season, month(o_orderdate)::bigint as gw,
  nullif(o_custkey % 26, 25) as home_id, (o_custkey + 3) % 25 as away_id, 1.5 + (o_custkey % 8) * 0.25::double as home_odds,
  3.0::double as draw_odds, 2.0::double + (o_orderkey % 16) * 0.5::double as away_odds from orders)"""


def odds(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey", "cast(year(o_orderdate) as bigint) as season", "cast(month(o_orderdate) as bigint) as gw",
        "nullif(o_custkey % 26, 25) as home_id", "(o_custkey + 3) % 25 as away_id",
        "1.5D + (o_custkey % 8) * 0.25D as home_odds", "3.0D as draw_odds", "2.0D + (o_orderkey % 16) * 0.5D as away_odds")


@query("b10_implied_probabilities", f"""with {_ODDS_DUCK}, p as (select *, 1 / home_odds as h, 1 / draw_odds as d, 1 / away_odds as a from od where home_id is not null)
 select o_orderkey, home_id as team, round(h / (h + d + a), 6) as win_prob, round(d / (h + d + a), 6) as draw_prob, round(a / (h + d + a), 6) as loss_prob from p
 union all select o_orderkey, away_id, round(a / (h + d + a), 6), round(d / (h + d + a), 6), round(h / (h + d + a), 6) from p""")
def b10(spark, sf):
    out = S.implied_probabilities(odds(spark, sf), ["o_orderkey"], "home_id", "away_id", ("home_odds", "draw_odds", "away_odds"))
    return out.select("o_orderkey", "team", *[r6(c).alias(c) for c in ("win_prob", "draw_prob", "loss_prob")])


_RAW_ROLLING = ",\n".join(
    f"avg({src}) over (partition by season, element order by gw rows between {n} preceding and 1 preceding) as {out}"
    if fn == "mean" else
    f"sum({src}) over (partition by season, element order by gw rows between {n} preceding and 1 preceding) as {out}"
    for out, src, n, fn in ROLLING_SPECS
    if out in {"pts_rolling_3", "pts_rolling_5", "pts_rolling_10", "mins_rolling_5", "transfers_in_rolling_3", "transfers_out_rolling_3",
               "ict_rolling_3", "ict_rolling_10", "bps_rolling_5", "bps_rolling_10", "starts_rolling_5", "bonus_rolling_5",
               "goals_rolling_5", "assists_rolling_5"})
RATIOS = ["pts_per_min_5", "pts_form_delta", "goals_vs_xg_5", "assists_vs_xa_5", "gw_phase", "transfer_ratio_3", "ict_form_delta",
          "bps_form_delta", "nailedness", "bonus_rate_5"]


@query("b11_ratio_features", f"""with @PA, r as (select season, element, gw, {_RAW_ROLLING},
  avg(threat / 16.0) over (partition by season, element order by gw rows between 5 preceding and 1 preceding) as xg_rolling_5,
  avg(threat / 8.0) over (partition by season, element order by gw rows between 5 preceding and 1 preceding) as xa_rolling_5 from pa)
 select season, element, gw, round(pts_rolling_5 / (mins_rolling_5 + 1e-6), 6) as pts_per_min_5, round(pts_rolling_3 - pts_rolling_10, 6) as pts_form_delta,
  round(goals_rolling_5 / 5.0::double - xg_rolling_5, 6) as goals_vs_xg_5, round(assists_rolling_5 / 5.0::double - xa_rolling_5, 6) as assists_vs_xa_5,
  round(gw / 38.0::double, 6) as gw_phase, round(transfers_in_rolling_3 / (transfers_out_rolling_3 + 1e-6), 6) as transfer_ratio_3,
  round(ict_rolling_3 - ict_rolling_10, 6) as ict_form_delta, round(bps_rolling_5 - bps_rolling_10, 6) as bps_form_delta,
  round(starts_rolling_5, 6) as nailedness, round(bonus_rolling_5 / (pts_rolling_5 + 1e-6), 6) as bonus_rate_5 from r""")
def b11(spark, sf):
    pa = panel_agg(spark, sf).withColumns({"xg": F.col("threat") / 16.0, "xa": F.col("threat") / 8.0})
    specs = [*ROLLING_SPECS, ("xg_rolling_5", "xg", 5, "mean"), ("xa_rolling_5", "xa", 5, "mean")]
    out = S.add_ratio_features(W.lagged_rolling(pa, KEYS, "gw", specs))
    return out.select(*KEYS, "gw", *[r6(c).alias(c) for c in RATIOS])


@query("b12_round_half", "select l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 4 * 2, 0) / 2 as half from lineitem")
def b12(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.round_half(F.col("l_quantity") / 4).alias("half"))


@query("b13_playing_prob", """with @PA, m as (select season, element, gw, avg(starts) over (partition by season, element order by gw rows between 3 preceding and 1 preceding) * 20 as m3 from pa)
 select season, element, gw, round(case when m3 is not null then least(greatest(m3 / 90, 0.0), 1.0) end, 6) as prob from m""")
def b13(spark, sf):
    m = W.lagged_rolling(panel_agg(spark, sf), KEYS, "gw", [("m3", "starts", 3, "mean")])
    return m.select(*KEYS, "gw", r6(S.playing_prob(F.col("m3") * 20)).alias("prob"))


_FORM_SQL = """cut as (select season, gw, min(kickoff) as cutoff from pg group by all),
 form as (select p.season, p.element, c.gw, round_even(avg(p.total_points) * 2, 0) / 2 as form from pg p join cut c on p.season = c.season and p.gw < c.gw
   and p.kickoff < c.cutoff and p.kickoff >= c.cutoff - interval 30 days where p.minutes > 0 group by all),
 games as (select season, element, gw, fixture, team, opponent_team from pg group by all),
 st as (select n_nationkey::bigint as team, (1 + n_nationkey % 5)::bigint as strength from nation where n_nationkey % 6 <> 0),
 ep as (select g.season, g.element, g.gw, round(sum(round_even((coalesce(f.form, 0.0) + (coalesce(a.strength, 3) - coalesce(b.strength, 3)) * 0.5::double) * 100.0::double / 100.0::double, 1))::double, 1) as ep,
   count(*) as n_fixtures from games g left join st a on g.team = a.team left join st b on g.opponent_team = b.team
   left join form f on f.season = g.season and f.element = g.element and f.gw = g.gw group by all)"""


EXPECTED_COLS = ["season", "element", "gw", "kickoff", "minutes", "total_points", "fixture", "team", "opponent_team"]


def expected(spark, sf, pg):
    """Formula reconstruction per (season, element, gw); the panel ``pg`` is read several times."""
    cut = A.period_cutoffs(pg, ["season"], "gw", "kickoff")
    form = W.time_window_mean(pg.where("minutes > 0"), cut, ["season"], "element", "gw", "kickoff", "total_points", 30)
    form = form.select("season", "element", "gw", S.round_half("window_mean").alias("form"))
    strengths = table(spark, sf, "nation").where("n_nationkey % 6 <> 0").selectExpr(
        "cast(n_nationkey as bigint) as team", "cast(1 + n_nationkey % 5 as bigint) as strength")
    return X.expected_points(pg, strengths, form, [*KEYS, "gw"], "fixture", "team", "opponent_team")


@query("b14_expected_points", f"with @PG, {_FORM_SQL} select season, element, gw, ep, n_fixtures from ep")
def b14(spark, sf):
    return expected(spark, sf, written_panel(spark, sf, EXPECTED_COLS))


_GRID_SQL = """f as (select season, element, gw, n_fix, total_points, minutes,
   coalesce(round_even(avg(total_points) over w2 * 2, 0) / 2, 0) as form_30d,
   coalesce(round_even(avg(case when minutes > 200 then total_points end) over w2 * 2, 0) / 2, 0) as form_30d_played,
   coalesce(round_even(avg(total_points) over w5 * 2, 0) / 2, 0) as form_r5, coalesce(round_even(avg(total_points) over wa * 2, 0) / 2, 0) as season_ppg,
   2.5::double as ppg_fallback, coalesce(case when avg(minutes) over w3 is not null then least(avg(minutes) over w3 / 900.0, 1.0) end, 0.0) as pp_mins,
   coalesce(max(case when minutes > 200 then 1.0 else 0.0 end) over w3, 0.0) as pp_any3,
   case when lag(gw) over w >= gw - 2 then 1.0 else 0.0 end as pp_recent, case when minutes > 0 then 1.0 else 0.0 end as pp_oracle,
   (element % 9 - 4) * 100.0 as sdiff
  from (select season, element, gw, count(*) as n_fix, sum(total_points)::bigint as total_points, sum(minutes)::bigint as minutes from pg group by all)
  window w as (partition by season, element order by gw),
   wa as (partition by season, element order by gw rows between unbounded preceding and 1 preceding),
   w2 as (partition by season, element order by gw rows between 2 preceding and 1 preceding),
   w3 as (partition by season, element order by gw rows between 3 preceding and 1 preceding),
   w5 as (partition by season, element order by gw rows between 5 preceding and 1 preceding)),
 fb as (select *, case when form_30d = 0 then ppg_fallback else form_30d end as fb, case when form_30d_played = 0 then ppg_fallback else form_30d_played end as fbp,
   case when form_r5 = 0 then ppg_fallback else form_r5 end as fb5, case when season_ppg = 0 then ppg_fallback else season_ppg end as fbs,
   least(greatest(round_even(sdiff / 200 * 2, 0) / 2, -1.0), 1.0) as q, least(greatest(sdiff / 200, -1.0), 1.0) as o,
   least(greatest(1.0 + sdiff / 2000.0, 0.7), 1.3)::double as lf from f),
 grid as (
  select season, element, gw, total_points, 'S1' as variant, round_even(form_30d * 2, 0) / 2 * n_fix as ep from fb
  union all select season, element, gw, total_points, 'S2', round_even(form_30d * lf * 2, 0) / 2 * n_fix from fb
  union all select season, element, gw, total_points, 'S3', round_even(greatest(form_30d, 0.5) * lf * 2, 0) / 2 * n_fix * pp_mins from fb
  union all select season, element, gw, total_points, 'S4', round_even(greatest(form_30d_played, 0.5) * lf * 2, 0) / 2 * n_fix from fb
  union all select season, element, gw, total_points, 'S5', round_even((form_30d + o) * 2, 0) / 2 * n_fix from fb
  union all select season, element, gw, total_points, 'S6', round_even((form_30d + q) * 2, 0) / 2 * n_fix from fb
  union all select season, element, gw, total_points, 'A', round_even(form_30d * 2, 0) / 2 * n_fix from fb
  union all select season, element, gw, total_points, 'B', round_even((form_30d + q) * 2, 0) / 2 * n_fix from fb
  union all select season, element, gw, total_points, 'C', round_even((fb + q) * 2, 0) / 2 * n_fix from fb
  union all select season, element, gw, total_points, 'D', round_even((fb + q) * 2, 0) / 2 * n_fix * pp_mins from fb
  union all select season, element, gw, total_points, 'E', round_even((fb + q) * 2, 0) / 2 * n_fix * pp_any3 from fb
  union all select season, element, gw, total_points, 'F', round_even((fb + q) * 2, 0) / 2 * n_fix * pp_recent from fb
  union all select season, element, gw, total_points, 'G', round_even((fb + q) * 2, 0) / 2 * n_fix * pp_oracle from fb
  union all select season, element, gw, total_points, 'H', round_even((fbp + q) * 2, 0) / 2 * n_fix * pp_oracle from fb
  union all select season, element, gw, total_points, 'I', round_even((fb5 + q) * 2, 0) / 2 * n_fix * pp_oracle from fb
  union all select season, element, gw, total_points, 'J', round_even((fbs + q) * 2, 0) / 2 * n_fix * pp_oracle from fb)"""


def grid(spark, sf):
    """Every formula variant for every (season, element, gw)."""
    agg = panel(spark, sf).groupBy(*KEYS, "gw").agg(
        F.count(F.lit(1)).alias("n_fix"), F.sum("total_points").alias("total_points"), F.sum("minutes").alias("minutes"), F.avg("xp").alias("xp"))
    zero = F.lit(0.0)
    df = W.last_k(agg, KEYS, "gw", 2, {"f2": F.avg("total_points"), "f2p": F.avg(F.when(F.col("minutes") > 200, F.col("total_points")))})
    df = W.last_k(df, KEYS, "gw", 3, {"m3": F.avg("minutes"), "any3": F.max((F.col("minutes") > 200).cast("double"))})
    df = W.lagged_rolling(df, KEYS, "gw", [("f5", "total_points", 5, "mean")])
    df = W.lagged_expanding(df, KEYS, "gw", [("ppg", "total_points", "mean")])
    df = W.shift(df.withColumn("prev_gw", F.col("gw")), KEYS, "gw", ["prev_gw"])
    df = df.withColumns({
        "form_30d": F.coalesce(S.round_half("f2"), zero), "form_30d_played": F.coalesce(S.round_half("f2p"), zero),
        "form_r5": F.coalesce(S.round_half("f5"), zero), "season_ppg": F.coalesce(S.round_half("ppg"), zero), "ppg_fallback": F.lit(2.5),
        "pp_mins": F.coalesce(S.playing_prob("m3", 900.0), zero), "pp_any3": F.coalesce("any3", zero),
        "pp_recent": F.when(F.col("prev_gw") >= F.col("gw") - 2, 1.0).otherwise(0.0), "pp_oracle": (F.col("minutes") > 0).cast("double")})
    sdiff = (F.col("element") % 9 - 4) * 100.0
    variants = X.variant_columns(F.col("n_fix"), sdiff, F.col("pp_mins"), S.clip(1.0 + sdiff / 2000.0, 0.7, 1.3))
    return X.formula_grid(df, [*KEYS, "gw", "total_points", "xp"], variants)


@query("b15_formula_grid", f"with @PG, {_GRID_SQL} select season, element, gw, variant, round(ep, 6) as ep from grid")
def b15(spark, sf):
    return grid(spark, sf).select(*KEYS, "gw", "variant", r6("ep").alias("ep"))


_AVAIL_SQL = """rr as (select season, customer, gw, case when minutes < 60 then 0 else minutes end as m, transfers_out as t,
   row_number() over (partition by season, customer order by gw, seq_day, seq_line, seq_part) as rn from pg),
 own as (select season, customer, gw, sum(m) as m, sum(t) as t from rr group by all),
 per as (select season, gw, lag(gw) over (partition by season order by gw) as last_gw from (select distinct season, gw from rr)),
 x as (select o.season, o.customer, o.gw, last_gw, max(p.gw) as prev, avg(p.t) as avg_t, max(case when p.m > 0 then p.gw end) as lp,
   least(3, coalesce(max(p.rn), 0) - coalesce(max(case when p.m <> 0 then p.rn end), 0)) as z
   from own o join per on per.season = o.season and per.gw = o.gw left join rr p on p.season = o.season and p.customer = o.customer and p.gw < o.gw where last_gw is not null group by all),
 y as (select x.*, own.m as pm, own.t as pt from x left join own on own.season = x.season and own.customer = x.customer and own.gw = x.prev),
 av as (select season, customer, gw, 'always_100' as strategy, 100 as cop from y
  union all select season, customer, gw, 'consec_zero', case when z >= 3 then 0 when z = 2 then 25 when z = 1 then 75 else 100 end from y
  union all select season, customer, gw, 'last_gw', case when prev = last_gw then case when pm > 0 then 100 else 25 end when lp >= last_gw - 2 then 75 else 0 end from y
  union all select season, customer, gw, 'tfer_spike', case when prev = last_gw and avg_t > 0 and pt > avg_t * 3 then 25 when prev = last_gw and pm = 0 then 50 else 100 end from y
  union all select season, customer, gw, 'combined', case when prev is null or prev <> last_gw then case when lp >= last_gw - 3 then 50 else 0 end
    when z >= 3 then 0 when z = 2 then 25 when z = 1 then 50 else 100 end from y)"""


def availability(spark, sf):
    """Customers as entities: they skip most periods, and have several rows in others."""
    rows = panel(spark, sf).select("season", "customer", "gw", "seq", "transfers_out", F.when(F.col("minutes") < 60, 0).otherwise(F.col("minutes")).alias("minutes"))
    return X.infer_availability(rows, ["season", "customer"], ["season"], "gw", "minutes", "transfers_out", "seq")


@query("b16_infer_availability", f"with @PG, {_AVAIL_SQL} select season, customer, gw, strategy, cop::int as cop from av")
def b16(spark, sf):
    return availability(spark, sf).select("season", "customer", "gw", "strategy", "cop")


@query("b17_selling_price", """with @SQ, @PR select pr.squad_id, pr.gw, pr.element, case when current_price <= 0 then purchase_price
 when current_price <= purchase_price then current_price else purchase_price + (current_price - purchase_price) // 2 end as selling_price
 from pr join sq on pr.squad_id = sq.squad_id and pr.gw = sq.gw and pr.element = sq.element""")
def b17(spark, sf):
    s = squads(spark, sf)
    both = grown_join(s, prices(s), ["squad_id", "gw", "element"])
    return both.select("squad_id", "gw", "element", S.selling_price("purchase_price", "current_price").alias("selling_price"))


@query("b18_transfer_hit", """with @SQ, @TR, n as (select squad_id, gw, count(*) as n, case when squad_id % 11 = 0 then 'wildcard' when squad_id % 7 = 0 then 'bench_boost' end as chip from tr group by all)
 select squad_id, gw, n, (case when chip = 'wildcard' then 0 else greatest(n - 1, 0) * 4 end)::bigint as hit from n""")
def b18(spark, sf):
    n = transfers(spark, sf).groupBy("squad_id", "gw").agg(F.count(F.lit(1)).alias("n"))
    n = n.withColumn("chip", F.expr("case when squad_id % 11 = 0 then 'wildcard' when squad_id % 7 = 0 then 'bench_boost' end"))
    return n.select("squad_id", "gw", "n", S.transfer_hit("n", F.lit(1), "chip").cast("bigint").alias("hit"))


@query("b19_score_events", """with @PG, e as (select season, element, gw, fixture, sum(goals_scored) as g, sum(assists) as a, max(clean_sheets) as cs, max(goals_conceded) as gc,
   sum(saves) as sv, sum(yellow_cards) as y, sum(red_cards) as r, least(sum(minutes), 90) as m, ['GK', 'DEF', 'MID', 'FWD'][element % 4 + 1] as pos from pg group by all)
 select season, element, gw, fixture, (g * case pos when 'GK' then 10 when 'DEF' then 6 when 'MID' then 5 else 4 end + a * 3
  + cs * case pos when 'GK' then 4 when 'DEF' then 4 when 'MID' then 1 else 0 end - (gc // 2) * case when pos in ('GK', 'DEF') then 1 else 0 end
  + (sv // 3) * case when pos = 'GK' then 1 else 0 end - y - 3 * r + case when m >= 60 then 2 when m > 0 then 1 else 0 end)::bigint as score from e""")
def b19(spark, sf):
    from ..operators.scoring import score_events

    e = panel(spark, sf).groupBy(*KEYS, "gw", "fixture").agg(
        *[F.sum(c).alias(c) for c in ("goals_scored", "assists", "saves", "yellow_cards", "red_cards")],
        F.max("clean_sheets").alias("clean_sheets"), F.max("goals_conceded").alias("goals_conceded"), F.least(F.sum("minutes"), F.lit(90)).alias("minutes"))
    e = e.withColumn("position", F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), (F.col("element") % 4 + 1).cast("int")))
    return score_events(e, "position", "score").select(*KEYS, "gw", "fixture", "score")


@query("b20_reward", """with @SQ, @SF, @PR, a as (select gw, avg(total_points) as avg_pts from sf group by gw),
 s as (select sq.squad_id, sq.gw, sum(case when in_lineup then coalesce(total_points, 0) else 0 end)::bigint as net,
   sum(case when current_price <= 0 then purchase_price when current_price <= purchase_price then current_price else purchase_price + (current_price - purchase_price) // 2 end)::bigint as val
   from sq left join sf on sf.element = sq.element and sf.gw = sq.gw join pr on pr.squad_id = sq.squad_id and pr.gw = sq.gw and pr.element = sq.element group by all),
 v as (select *, lag(val) over (partition by squad_id order by gw) as before from s)
 select squad_id, v.gw, round(net + 0.1::double * (net - coalesce(avg_pts, 0)) + 0.05::double * (coalesce(val - before, 0) / 10.0::double), 6) as reward from v left join a on a.gw = v.gw""")
def b20(spark, sf):
    from ..operators import squads as Q
    from .binding import squad_facts

    s, f = squads(spark, sf), squad_facts(spark, sf)
    net = Q.squad_points(s, f, ["squad_id", "gw"]).withColumnRenamed("lineup_points", "net")
    value = Q.team_value(s, prices(s), ["squad_id"], "gw")
    out = Q.reward(net, value, A.period_average(f, ["gw"], "total_points"), ["squad_id"], "gw")
    return out.select("squad_id", "gw", r6("reward").alias("reward"))


# The numbers of a vector, in order.
SLOTS = [
    *[X.Slot("label", p) for p in POSITIONS],
    X.Slot("pre", "value", 1000.0),
    X.Slot("past", "form", 10.0),
    X.Slot("post", "expected_goals"),
    X.Slot("post", "expected_assists"),
    X.Slot("post", "influence", 100.0),
    X.Slot("post", "creativity", 100.0),
    X.Slot("post", "threat", 100.0),
    X.Slot("post", "ict_index", 100.0),
    X.Slot("post", "bps", 100.0),
    X.Slot("pre", "selected", 1e7),
    X.Slot("post", "minutes", 90.0),
    X.Slot("post", "total_points", 15.0),
    X.Slot("post", "transfers_balance", 1e5),
    X.Slot("pre", "was_home"),
    X.Slot("past", "prediction", 15.0),
]
_SLOT_SQL = {"pre": "case when k.gw is not null then k.{0} else b.{0} end", "post": "b.{0}", "past": "form", "label": "(['GK', 'DEF', 'MID', 'FWD'][fm.element % 4 + 1] = '{0}')::int"}


@query("b21_point_in_time_vector", f"""with @PA, hm as (select season, element, gw, max(was_home::int) as was_home from pg group by all), r as (select pa.*, was_home from pa join hm using (season, element, gw)),
 g as (select e.season, e.element, p.gw from (select distinct season, element from pa) e join (select distinct season, gw from pa) p on p.season = e.season),
 fm as (select g.season, g.element, g.gw, avg(x.total_points) as form from g left join pa x on x.season = g.season and x.element = g.element and x.gw between g.gw - 5 and g.gw - 1 group by all)
 select fm.season, fm.element, fm.gw, [{", ".join(f"round(coalesce({_SLOT_SQL[s.source].format(s.column)}, 0)::double / {s.scale}::double, 6)" for s in SLOTS)}] as features
 from fm left join r k on k.season = fm.season and k.element = fm.element and k.gw = fm.gw left join r b on b.season = fm.season and b.element = fm.element and b.gw = fm.gw - 1""")
def b21(spark, sf):
    """Every entity of a season at every period of it; the mean of five periods stands for the prediction too."""
    home = panel(spark, sf).groupBy(*KEYS, "gw").agg(F.max(F.col("was_home").cast("int")).alias("was_home"))
    used = dict.fromkeys([*(s.column for s in SLOTS if s.source in ("pre", "post")), "total_points"])
    # one row per entity and period, written once: the grid of entities and periods and the vectors are made from it
    df = materialise(panel_agg(spark, sf).join(home, [*KEYS, "gw"]).select(*KEYS, "gw", *used), "vectors")
    who = df.select(*KEYS, F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), (F.col("element") % 4 + 1).cast("int")).alias("position"))
    form = lambda w: F.avg("total_points").over(w.rangeBetween(-5, -1))
    out = X.point_in_time_vector(df.withColumn("position", F.lit(None).cast("string")), who, df.select("season", "gw"), ["season"], "element", "gw", "position", SLOTS, {"form": form, "prediction": form})
    return out.withColumn("features", F.transform("features", lambda v: F.round(v, 6)))


@query("b22_population_cuts", """with @PG, c as (select 'played' as cut, total_points, xp from pg where minutes > 0 union all select 'sixty', total_points, xp from pg where minutes >= 60
   union all select 'xp2', total_points, xp from pg where xp >= 2 union all select 'confident_blank', total_points, xp from pg where xp >= 3 and minutes >= 60 and total_points <= 4
   union all select 'unexpected_haul', total_points, xp from pg where xp < 3 and total_points >= 10)
 select cut, count(*) as n, round(avg(xp), 6) as mean_xp, round(avg(total_points), 6) as mean_points, round(avg(abs(xp - total_points)), 6) as mae,
 round(covar_pop(xp, total_points) / nullif(stddev_pop(xp) * stddev_pop(total_points), 0), 6) as corr from c group by cut""")
def b22(spark, sf):
    from ..functions.stats import pearson

    c = F.col
    cuts = {"played": c("minutes") > 0, "sixty": c("minutes") >= 60, "xp2": c("xp") >= 2,
            "confident_blank": (c("xp") >= 3) & (c("minutes") >= 60) & (c("total_points") <= 4),
            "unexpected_haul": (c("xp") < 3) & (c("total_points") >= 10)}
    return S.population_cuts(panel(spark, sf), cuts).groupBy("cut").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("xp")).alias("mean_xp"), r6(F.avg("total_points")).alias("mean_points"),
        r6(F.avg(F.abs(c("xp") - c("total_points")))).alias("mae"), r6(pearson("xp", "total_points")).alias("corr"))


@query("b23_require", "with @PG select season, count(*) as n from pg where position is not null and nullif(bonus, 0) is not null group by season")
def b23(spark, sf):
    df = panel(spark, sf).withColumn("bonus", F.expr("nullif(bonus, 0)"))
    return S.require(df, ["position", "bonus"]).groupBy("season").agg(F.count(F.lit(1)).alias("n"))
