"""Checked queries: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import single_spaced
from ..functions.stats import r6
from ..operators import aggs as A
from ..operators import joins as J
from ..operators import windows as W
from .binding import panel, panel_agg, table
from .registry import query

KEYS = ["season", "element", "gw"]

_MAP_SQL = """idm as (select s.season, s_suppkey as element, s_suppkey + 100000 as code from supplier,
   (select distinct year(o_orderdate)::bigint as season from orders) s where (s_suppkey + s.season) % 6 <> 0)"""


def id_map(spark, sf):
    """Season-local ids of the suppliers for every season of the orders; some are missing in some seasons."""
    seasons = table(spark, sf, "orders").agg(F.collect_set(F.year("o_orderdate"))).scalar()
    s = table(spark, sf, "supplier").withColumn("season", F.explode(seasons))
    return s.where("(s_suppkey + season) % 6 <> 0").selectExpr(
        "cast(season as bigint) as season", "s_suppkey as element", "s_suppkey + 100000 as code")


@query("c01_attach_code", f"with @PA, {_MAP_SQL} select pa.season, pa.element, gw, code, total_points from pa join idm on pa.season = idm.season and pa.element = idm.element")
def c01(spark, sf):
    return J.attach_code(panel_agg(spark, sf), id_map(spark, sf)).select(*KEYS, "code", "total_points")


@query("c02_assemble", f"""with @PA, {_MAP_SQL},
 cut as (select season, gw, min(kickoff) as cutoff, avg(total_points) as period_avg from pg group by all),
 hm as (select season, element, gw, avg(case when was_home then 1.0 else 0.0 end) as home, count(distinct fixture) as n_fixtures from pg group by all)
 select pa.season, pa.element, pa.gw, code, total_points, round(home, 6) as home, n_fixtures, cutoff, round(period_avg, 6) as period_avg
 from pa left join idm on pa.season = idm.season and pa.element = idm.element left join hm on pa.season = hm.season and pa.element = hm.element and pa.gw = hm.gw
 left join cut on pa.season = cut.season and pa.gw = cut.gw""")
def c02(spark, sf):
    pg = panel(spark, sf)
    home = pg.groupBy(*KEYS).agg(F.avg(F.col("was_home").cast("double")).alias("home"))
    games = pg.select(*KEYS, "fixture").distinct().groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_fixtures"))
    cut = pg.groupBy("season", "gw").agg(F.min("kickoff").alias("cutoff"), F.avg("total_points").alias("period_avg"))
    base = panel_agg(spark, sf).select(*KEYS, "total_points")
    out = J.assemble(base, [(id_map(spark, sf), ["season", "element"]), (home, KEYS), (games, KEYS), (cut, ["season", "gw"])])
    return out.select(*KEYS, "code", "total_points", r6("home").alias("home"), "n_fixtures", "cutoff", r6("period_avg").alias("period_avg"))


@query("c03_asof_rolling", """with ev as (select user_id, ts, event_id, round(value * 100)::bigint as v from events),
 cut as (select distinct date_trunc('day', ts)::timestamp as cutoff from events), g as (select * from (select distinct user_id from ev), cut),
 r as (select g.user_id, g.cutoff, v, row_number() over (partition by g.user_id, g.cutoff order by ts desc, event_id desc) as back
   from g left join ev on ev.user_id = g.user_id and ev.ts < g.cutoff)
 select user_id, day(cutoff)::bigint as period, cutoff, round(avg(v) filter (where back <= 3), 6) as v_rolling_3,
  round(avg(v) filter (where back <= 10), 6) as v_rolling_10 from r group by all""")
def c03(spark, sf):
    ev = table(spark, sf, "events").selectExpr(
        "cast(year(ts) as bigint) as season", "user_id", "ts", "event_id", "cast(round(value * 100) as bigint) as v")
    cut = ev.select("season", F.date_trunc("day", "ts").alias("cutoff")).distinct().withColumn("period", F.dayofmonth("cutoff").cast("bigint"))
    out = J.asof_rolling(ev, cut, ["season"], "user_id", "ts", "event_id", [("v_rolling_3", "v", 3), ("v_rolling_10", "v", 10)])
    return out.select("user_id", "period", "cutoff", r6("v_rolling_3").alias("v_rolling_3"), r6("v_rolling_10").alias("v_rolling_10"))


@query("c04_scaffold", """with @PG, e as (select distinct season, customer from pg), p as (select distinct season, gw from pg),
 f as (select season, customer, gw, sum(total_points)::bigint as pts from pg group by all)
 select e.season, e.customer, p.gw, pts from e join p on e.season = p.season left join f on f.season = e.season and f.customer = e.customer and f.gw = p.gw""")
def c04(spark, sf):
    pg = panel(spark, sf)
    facts = A.target(pg, ["season", "customer", "gw"], "total_points", "pts")
    grid = J.scaffold(facts.select("season", "customer"), facts.select("season", "gw"), ["season"])
    return grid.join(facts, ["season", "customer", "gw"], "left")


@query("c05_conceded", """with @PG, s as (select season, gw, fixture, team, min(opponent_team) as opp, sum(total_points)::bigint as v from pg group by all)
 select a.season, a.team, a.gw, sum(coalesce(b.v, 0))::bigint as pts_conceded from s a left join s b on a.season = b.season and a.gw = b.gw
  and a.fixture = b.fixture and a.opp = b.team group by all""")
def c05(spark, sf):
    return J.conceded(panel(spark, sf), ["season"], "gw", "team", "opponent_team", "fixture", "total_points", "pts_conceded")


@query("c06_attach_opponent", """with @PG, t as (select season, team, gw, sum(total_points)::bigint as team_pts from pg group by all),
 g as (select distinct season, element, gw, fixture, opponent_team from pg)
 select g.season, g.element, g.gw, g.fixture, g.opponent_team, team_pts from g left join t on t.season = g.season and t.gw = g.gw and t.team = g.opponent_team""")
def c06(spark, sf):
    pg = panel(spark, sf)
    stats = A.target(pg, ["season", "team", "gw"], "total_points", "team_pts")
    rows = pg.select(*KEYS, "fixture", "opponent_team").distinct()
    return J.attach_opponent(rows, stats, ["season"], "gw", "team", "opponent_team").select(*KEYS, "fixture", "opponent_team", "team_pts")


_FIX_SQL = """fx as (select distinct season, fixture, case when fixture % 7 = 0 then null else 1 + fixture % 5 end as dh, 1 + (fixture + 2) % 5 as da from pg)"""


def fixtures(pg):
    return pg.select("season", "fixture").distinct().selectExpr(
        "season", "fixture", "case when fixture % 7 = 0 then null else 1 + fixture % 5 end as team_h_difficulty",
        "1 + (fixture + 2) % 5 as team_a_difficulty")


def teams(spark, sf):
    return table(spark, sf, "nation").selectExpr(
        "cast(n_nationkey as bigint) as id", "n_name as name", "1 + n_nationkey % 5 as strength", "1000 + n_nationkey * 10 as strength_attack_home",
        "1020 + n_nationkey * 9 as strength_attack_away", "1040 + n_nationkey * 8 as strength_defence_home", "1060 + n_nationkey * 7 as strength_defence_away")


_TEAMS_SQL = """tm as (select n_nationkey::bigint as id, n_name as name, 1 + n_nationkey % 5 as strength, 1000 + n_nationkey * 10 as ah, 1020 + n_nationkey * 9 as aa,
  1040 + n_nationkey * 8 as dh2, 1060 + n_nationkey * 7 as da2 from nation)"""


@query("c07_fixture_difficulty", f"""with @PG, {_FIX_SQL}, g as (select distinct season, element, gw, fixture, was_home from pg)
 select g.season, element, gw, g.fixture, round(case when dh is not null then case when was_home then dh else da end / 5.0 end, 6) as fdr from g
 left join fx on fx.season = g.season and fx.fixture = g.fixture""")
def c07(spark, sf):
    pg = panel(spark, sf)
    rows = pg.select(*KEYS, "fixture", "was_home").distinct()
    out = J.fixture_difficulty(rows, fixtures(pg), ["season", "fixture"])
    return out.select(*KEYS, "fixture", r6("fdr").alias("fdr"))


@query("c08_opponent_strength", f"""with @PG, {_TEAMS_SQL}, g as (select distinct season, element, gw, fixture, was_home, opponent_team from pg)
 select season, element, gw, fixture, round(strength / 1500.0, 6) as opp_strength, round(case when was_home then aa else ah end / 1500.0, 6) as opp_attack_strength,
  round(case when was_home then da2 else dh2 end / 1500.0, 6) as opp_defence_strength from g left join tm on id = opponent_team""")
def c08(spark, sf):
    rows = panel(spark, sf).select(*KEYS, "fixture", "was_home", "opponent_team").distinct()
    out = J.opponent_strength(rows, teams(spark, sf))
    return out.select(*KEYS, "fixture", *[r6(c).alias(c) for c in ("opp_strength", "opp_attack_strength", "opp_defence_strength")])


@query("c09_attach_team_probs", """with @PG, od as (select year(o_orderdate)::bigint as season, month(o_orderdate)::bigint as gw, c_nationkey::bigint as team,
   avg(1.0 / (1.5 + (o_custkey % 8) * 0.25::double)) as win_prob from orders join customer on o_custkey = c_custkey group by all),
 t as (select season, element, gw, first(team order by seq_day, seq_line, seq_part) as team from pg group by season, element, gw)
 select t.season, t.element, t.gw, t.team, round(win_prob, 6) as win_prob from t left join od on od.season = t.season and od.gw = t.gw and od.team = t.team""")
def c09(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    probs = o.groupBy(F.expr("cast(year(o_orderdate) as bigint)").alias("season"), F.expr("cast(month(o_orderdate) as bigint)").alias("gw"),
                      F.expr("cast(c_nationkey as bigint)").alias("team")).agg(F.expr("avg(1.0D / (1.5D + (o_custkey % 8) * 0.25D))").alias("win_prob"))
    out = J.attach_team_probs(panel(spark, sf), probs, KEYS, "team", ["season", "gw"], "seq")
    return out.select(*KEYS, "team", r6("win_prob").alias("win_prob"))


@query("c10_coalesce_sources", """with a as (select l_partkey as code, count(*) as n, case when sum(l_linenumber) % 3 = 0 then null else sum(l_linenumber)::bigint end as blocks,
   case when count(*) > 25 then null else count(*) end as passes from lineitem where l_returnflag = 'N' group by 1),
 b as (select p_partkey as code, p_size::bigint as blocks, p_size * 2::bigint as passes from part where p_size > 10)
 select coalesce(a.code, b.code) as code, n, coalesce(a.blocks, b.blocks) as blocks, coalesce(a.passes, b.passes) as passes from a full join b on a.code = b.code""")
def c10(spark, sf):
    a = table(spark, sf, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.expr("case when sum(l_linenumber) % 3 = 0 then null else sum(l_linenumber) end").alias("blocks"),
        F.expr("case when count(1) > 25 then null else count(1) end").alias("passes"))
    b = table(spark, sf, "part").where("p_size > 10").selectExpr("p_partkey as code", "cast(p_size as bigint) as blocks", "cast(p_size * 2 as bigint) as passes")
    return J.coalesce_sources(a, b, ["code"], ["blocks", "passes"])


@query("c11_repair_team", """with @PG, d as (select season, element, gw, fixture, line, opponent_team, part, cents,
   case when season <= 1996 then (select n_name from nation where n_nationkey = team) when season = 1997 then null else team::varchar end as team from pg),
 s as (select season, fixture, team, min(opponent_team) as opp from d where team is not null group by all),
 two as (select season, fixture, min(team) as a, max(team) as b, arg_min(opp, team) as oa, arg_max(opp, team) as ob from s group by all having count(*) = 2),
 nm as (select season, team, arg_max(id, fixture) as id from (select season, fixture, a as team, ob as id from two union all select season, fixture, b, oa from two) group by all),
 e as (select season, fixture, count(distinct opponent_team) as n, min(opponent_team) as lo, max(opponent_team) as hi from d group by all)
 select d.season, element, gw, d.fixture, line, part, cents, case when d.season >= 1998 then try_cast(d.team as bigint)
   when d.season = 1997 then case when e.n = 2 then case when opponent_team = lo then hi else lo end end else nm.id end as team_id
 from d left join nm on nm.season = d.season and nm.team = d.team left join e on e.season = d.season and e.fixture = d.fixture""")
def c11(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("team"), "n_name")
    d = panel(spark, sf).join(nation, "team").withColumn(
        "team", F.expr("case when season <= 1996 then n_name when season = 1997 then null else cast(team as string) end"))
    d = d.select("season", "element", "gw", "fixture", "line", "part", "cents", "opponent_team", "team")
    return J.repair_team(d, ["season"], "fixture", "team", "opponent_team").drop("team", "opponent_team")


_PEOPLE_SQL = """st as (select doc_id, i, trim(regexp_replace(parts[i + 1], '\\s+', ' ', 'g')) as s from (select doc_id, string_split(text, '.') as parts from documents), unnest(range(len(parts))) t(i)),
 pp as (select doc_id * 1073741824 + i as code, w[1] as first_name, array_to_string(w[2:], ' ') as second_name, w[-1] as web_name, s from (select *, string_split(s, ' ') as w from st where s <> ''))"""
_NORM = "trim(regexp_replace(lower(strip_accents({0})), '\\s+', ' ', 'g'))"
_INDEX_SQL = f"""va as (
   select code, code * 10 + 0 as ord, {_NORM.format("first_name || ' ' || second_name")} as norm from pp where first_name <> '' and second_name <> ''
   union all select code, code * 10 + 1, {_NORM.format("web_name")} from pp where web_name <> ''
   union all select code, code * 10 + 2, {_NORM.format("first_name || ' ' || web_name")} from pp where first_name <> '' and web_name <> '' and web_name <> first_name
   union all select code, code * 10 + 3, {_NORM.format("first_name")} from pp where first_name <> ''
   union all select code, code * 10 + 4, {_NORM.format("second_name")} from pp where second_name <> '' and second_name <> first_name
   union all select code, code * 10 + 5, {_NORM.format("first_name || ' ' || web_name")} from pp where first_name <> '' and contains(second_name, ' ')
   union all select code, code * 10 + 6, {_NORM.format("regexp_extract(first_name, '''([^'']+)''', 1)")} from pp where regexp_extract(first_name, '''([^'']+)''', 1) <> ''),
 ix as (select norm, arg_min(code, ord) as code, min(ord) as ord from va where norm <> '' group by norm)"""


# More than the sentences that a text of the largest size (2^31 bytes) can hold, so codes of documents never meet.
SENTENCES = 1 << 30


def people(spark, sf):
    """Every sentence of every document as a person: first word, the rest, last word."""
    # Texts differ in length by four orders of magnitude, so they are spread evenly before they multiply.
    parts = table(spark, sf, "documents").hint("rebalance").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("i", "raw"))
    # what is left of a piece with any letter or sign is never empty; a filter on s would make s twice
    s = parts.where(F.col("raw").rlike(r"\S")).withColumn("s", F.trim(single_spaced("raw")))
    first = F.substring_index("s", " ", 1)
    return s.select(
        (F.col("doc_id") * SENTENCES + F.col("i")).alias("code"), first.alias("first_name"),
        F.substr(F.col("s"), F.length(first) + 2).alias("second_name"), F.substring_index("s", " ", -1).alias("web_name"), "s")


@query("c12_name_index", f"with {_PEOPLE_SQL}, {_INDEX_SQL} select norm, code from ix")
def c12(spark, sf):
    variants = J.name_variants(people(spark, sf), "code", "code", "first_name", "second_name", "web_name")
    return J.name_index(variants, "code").select("norm", "code")


@query("c13_match_names", f"""with {_PEOPLE_SQL}, {_INDEX_SQL},
 px as (select norm, arg_min(code, ord) as code from (select substr(f, 1, k) || substr(norm, length(f) + 1) as norm, code, ord
   from (select *, string_split(norm, ' ')[1] as f from ix where contains(norm, ' ')), unnest(range(3, length(f))) t(k)) group by norm),
 pr as (select code as probe_id, {_NORM.format("substr(first_name, 1, greatest(length(first_name) - 2, 3)) || ' ' || second_name")} as norm from pp)
 select probe_id, pr.norm, coalesce(ix.code, case when contains(pr.norm, ' ') then px.code end) as code from pr left join ix on ix.norm = pr.norm left join px on px.norm = pr.norm""")
def c13(spark, sf):
    p = people(spark, sf)
    variants = J.name_variants(p, "code", "code", "first_name", "second_name", "web_name")
    probes = p.select(F.col("code").alias("probe_id"), F.expr(
        "concat(substring(first_name, 1, greatest(length(first_name) - 2, 3)), ' ', second_name)").alias("probe"))
    return J.match_names(probes, "probe", variants, "code").select("probe_id", "norm", "code")


@query("c14_match_full_name", f"""with {_PEOPLE_SQL}, fu as (select {_NORM.format("s")} as norm, max(code) as code from pp group by 1),
 we as (select {_NORM.format("web_name")} as norm, min(code) as code from pp group by 1), pr as (select code * 2 as probe_id, {_NORM.format("first_name")} as norm from pp
   union all select code * 2 + 1, {_NORM.format("s")} from pp)
 select probe_id, coalesce(fu.code, we.code) as code from pr left join fu on fu.norm = pr.norm left join we on we.norm = pr.norm""")
def c14(spark, sf):
    p = people(spark, sf)
    probes = p.select((F.col("code") * 2).alias("probe_id"), F.col("first_name").alias("name")).unionByName(
        p.select((F.col("code") * 2 + 1).alias("probe_id"), F.col("s").alias("name")))
    return J.match_full_name(probes, "name", p, "code", "code", "s", "web_name").select("probe_id", "code")


@query("c15_contains_lookup", """with n as (select doc_id, trim(regexp_replace(lower(strip_accents(text)), '\\s+', ' ', 'g')) as norm from documents),
 p as (select distinct unnest(string_split(p_name, ' ')) as probe from part union select distinct substr(s_name, 13) from supplier)
 select doc_id, probe from n join p on contains(norm, lower(probe))""")
def c15(spark, sf):
    words = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("probe"))
    probes = words.unionByName(table(spark, sf, "supplier").select(F.expr("substring(s_name, 13)").alias("probe"))).distinct()
    # the texts are one file of few splits here
    texts = table(spark, sf, "documents").hint("rebalance").select("doc_id", "text")
    return J.contains_lookup(texts, "text", probes, "probe").select("doc_id", "probe")


@query("c15_contains_lookup_names", """select c_custkey, s_suppkey from customer join supplier on contains(lower(c_name), lower(substr(s_name, 13)))""")
def c15b(spark, sf):
    probes = table(spark, sf, "supplier").select("s_suppkey", F.expr("substring(s_name, 13)").alias("probe"))
    out = J.contains_lookup(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", probes, "probe")
    return out.select("c_custkey", "s_suppkey")


@query("c16_unmatched", f"with @PA, {_MAP_SQL} select season, element, gw from pa where not exists (select 1 from idm where idm.season = pa.season and idm.element = pa.element)")
def c16(spark, sf):
    return J.unmatched(panel_agg(spark, sf).select(*KEYS), id_map(spark, sf), ["season", "element"])


@query("c17_backfill_attribute", """with @PG, b as (select season, element, gw, max(position) as position from pg group by all),
 k as (select element, arg_min(position, season * 100 + gw) as known from b where position is not null group by 1)
 select season, b.element, gw, coalesce(position, known) as position from b left join k on k.element = b.element""")
def c17(spark, sf):
    b = panel(spark, sf).groupBy(*KEYS).agg(F.max("position").alias("position")).withColumn("when", F.col("season") * 100 + F.col("gw"))
    return J.backfill_attribute(b, "element", "position", "when").select(*KEYS, "position")


@query("c18_resolve_attribute", """with @PG, s0 as (select season, element, max(position) as position from pg group by all having max(position) is not null),
 s1 as (select 1996::bigint as season, s_suppkey as element, case when s_suppkey % 2 = 0 then 'GK' else 'MID' end as position from supplier),
 s2 as (select se.season, l.element, l.position from (select element, arg_max(position, season) as position from s0 group by 1) l, (select distinct season from pg) se)
 select season, element, position, 0 as source from s0 union all
 select season, element, position, 1 from s1 where season not in (select season from s0) union all
 select season, element, position, 2 from s2 where season not in (select season from s0) and season not in (select season from s1)""")
def c18(spark, sf):
    pg = panel(spark, sf)
    own = pg.groupBy("season", "element").agg(F.max("position").alias("position"))
    dim = table(spark, sf, "supplier").selectExpr(
        "cast(1996 as bigint) as season", "s_suppkey as element", "case when s_suppkey % 2 = 0 then 'GK' else 'MID' end as position")
    known = own.where("position is not null").groupBy("element").agg(F.max_by("position", "season").alias("position"))
    seasons = pg.agg(F.collect_set("season"))  # a handful of years
    back = known.withColumn("seasons", seasons.scalar()).select(F.explode("seasons").alias("season"), "element", "position")
    return J.resolve_attribute([own, dim, back], ["season"], ["element"], "position").select("season", "element", "position", "source")


@query("c19_attach_predictions", """with @PA, pr as (select season, element, gw, total_points / 10.0::double as prediction from pa where minutes > 300)
 select pa.season, pa.element, pa.gw, coalesce(prediction, 0.0) as prediction from pa left join pr on pr.season = pa.season and pr.element = pa.element and pr.gw = pa.gw""")
def c19(spark, sf):
    pa = panel_agg(spark, sf)
    preds = pa.where("minutes > 300").select(*KEYS, (F.col("total_points") / 10.0).alias("prediction"))
    return J.attach_predictions(pa.select(*KEYS), preds, KEYS)


@query("c20_join_models", """with @PA, a as (select season, element, gw, lag(total_points) over (partition by season, element order by gw) as p from pa),
 b as (select season, element, gw, round(avg(total_points) over (partition by season, element order by gw rows between 3 preceding and 1 preceding), 6) as p from pa)
 select a.season, a.element, a.gw, a.p::double as prediction_a, b.p as prediction_b, round(b.p - a.p, 6) as difference from a join b on a.season = b.season and a.element = b.element and a.gw = b.gw""")
def c20(spark, sf):
    pa = panel_agg(spark, sf)
    rolled = W.lagged_rolling(pa, ["season", "element"], "gw", [("p1", "total_points", 1, "mean"), ("p3", "total_points", 3, "mean")])
    a = rolled.select(*KEYS, F.col("p1").alias("prediction"))
    b = rolled.select(*KEYS, r6("p3").alias("prediction"))
    return J.join_models(a, b, KEYS).withColumn("difference", r6("difference"))
