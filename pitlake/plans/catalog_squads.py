"""Checked queries: squads in bulk."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import selling_price, transfer_hit
from ..operators import squads as Q
from ..operators.scale import grown_join
from .binding import chips, panel, prices, squad_facts, squads, table, transfers
from .registry import query

K = ["squad_id", "gw"]


def bank(spark, sf):
    return squads(spark, sf).where("slot = 1").selectExpr("squad_id", "gw", "squad_id % 23 - 2 as bank", "squad_id % 3 as free")


_BANK = "bk as (select squad_id, gw, squad_id % 23 - 2 as bank, squad_id % 3 as free from sq where slot = 1)"
_LEGAL = "('3-4-3', '3-5-2', '4-3-3', '4-4-2', '4-5-1', '5-2-3', '5-3-2', '5-4-1')"


@query("i01_audit_squads", f"""with @SQ, {_BANK}, c as (select squad_id, gw, max(n) as most from (select squad_id, gw, team, count(*) as n from sq group by all) group by all),
 a as (select squad_id, gw, count(*) as n, count(*) filter (where in_lineup) as li, count(*) filter (where position = 'GK') as gk, count(*) filter (where position = 'DEF') as d,
   count(*) filter (where position = 'MID') as m, count(*) filter (where position = 'FWD') as f, count(*) filter (where in_lineup and position = 'GK') as lgk,
   count(*) filter (where in_lineup and position = 'DEF') || '-' || count(*) filter (where in_lineup and position = 'MID') || '-' || count(*) filter (where in_lineup and position = 'FWD') as shape,
   count(*) filter (where in_lineup and is_captain) as cap, count(*) filter (where in_lineup and is_vice) as vice from sq group by all)
 select a.squad_id, a.gw, list_filter([case when n <> 15 then 'size' end, case when gk <> 2 then 'quota_GK' end, case when d <> 5 then 'quota_DEF' end, case when m <> 5 then 'quota_MID' end,
   case when f <> 3 then 'quota_FWD' end, case when li <> 11 then 'lineup_size' end, case when n - li <> 4 then 'bench_size' end, case when lgk <> 1 then 'lineup_keeper' end,
   case when shape not in {_LEGAL} then 'formation' end, case when most > 3 then 'club_limit' end, case when cap <> 1 then 'captain' end, case when vice <> 1 then 'vice_captain' end,
   case when bank < 0 then 'bank' end], lambda x: x is not null) as violations
 from a join c on a.squad_id = c.squad_id and a.gw = c.gw left join bk on a.squad_id = bk.squad_id and a.gw = bk.gw""")
def i01(spark, sf):
    return Q.audit_squads(squads(spark, sf), bank(spark, sf), K)


@query("i02_formations", f"""with @SQ, a as (select squad_id, gw, count(*) filter (where in_lineup) as li, count(*) filter (where in_lineup and position = 'GK') as gk,
   count(*) filter (where in_lineup and position = 'DEF') || '-' || count(*) filter (where in_lineup and position = 'MID') || '-' || count(*) filter (where in_lineup and position = 'FWD') as formation from sq group by all)
 select squad_id, gw, formation, gk = 1 and li = 11 and formation in {_LEGAL} as is_legal from a""")
def i02(spark, sf):
    return Q.formations(squads(spark, sf), K)


_FORMATIONS = "fm as (select * from (values (3,4,3),(3,5,2),(4,3,3),(4,4,2),(4,5,1),(5,2,3),(5,3,2),(5,4,1)) v(d, m, f))"


@query("i03_best_lineup", f"""with @SQ, {_FORMATIONS}, rk as (select squad_id, gw, position, xp, row_number() over (partition by squad_id, gw, position order by xp desc) as rn from sq),
 s as (select squad_id, gw, d, m, f, sum(xp) + max(xp) as objective, count(*) as n from rk, fm where rn <= case position when 'GK' then 1 when 'DEF' then d when 'MID' then m else f end group by all)
 select k.squad_id, k.gw, o.objective::bigint as objective, o.formation from (select distinct squad_id, gw from sq) k left join
  (select squad_id, gw, objective, d || '-' || m || '-' || f as formation, row_number() over (partition by squad_id, gw order by objective desc, d || '-' || m || '-' || f desc) as p from s where n = 11) o
  on o.squad_id = k.squad_id and o.gw = k.gw and p = 1""")
def i03(spark, sf):
    return Q.best_lineup(squads(spark, sf), K, "xp")


@query("i04_bench_order", """with @SQ select squad_id, gw, element, row_number() over (partition by squad_id, gw order by (position = 'GK')::int desc, xp desc, element)::int as bench_place from sq where not in_lineup""")
def i04(spark, sf):
    return Q.bench_order(squads(spark, sf).where("not in_lineup"), K, "element", "xp").select("squad_id", "gw", "element", "bench_place")


_POOL_SQL = """pl as (select l.element, l.gw, l.points, l.price, case when l.element % 4 = 3 and l.element % 8 = 7 then null else ['GK', 'DEF', 'MID', 'FWD'][l.element % 4 + 1] end as position,
   nullif(s_nationkey::bigint, 3) as team from (select season * 100 + gw as gw, element, sum(total_points)::bigint as points, first(value order by seq_day, seq_line, seq_part) - 45 as price from pg group by all) l
   join supplier on s_suppkey = l.element)"""


@query("i05_build_pool", f"""with @PG, {_POOL_SQL}, pr as (select season * 100 + gw as gw, element, sum(minutes) / 8.0::double as prediction from pg group by all having sum(minutes) > 300)
 select pl.gw, pl.element, price, position, team, coalesce(prediction, 0.0) as xp from pl left join pr on pr.gw = pl.gw and pr.element = pl.element where position is not null and team is not null and price > 0""")
def i05(spark, sf):
    pg = panel(spark, sf).withColumn("gw", F.col("season") * 100 + F.col("gw")).withColumn("value", F.col("value") - 45)
    players = table(spark, sf, "supplier").selectExpr(
        "s_suppkey as element", "case when s_suppkey % 4 = 3 and s_suppkey % 8 = 7 then null else element_at(array('GK', 'DEF', 'MID', 'FWD'), cast(s_suppkey % 4 + 1 as int)) end as position",
        "nullif(cast(s_nationkey as bigint), 3) as team")
    preds = pg.groupBy("gw", "element").agg(F.sum("minutes").alias("m")).where("m > 300").select("gw", "element", (F.col("m") / 8.0).alias("prediction"))
    return Q.build_pool(pg, ["gw", "element"], "total_points", "value", "seq", players, "element", preds).select("gw", "element", "price", "position", "team", "xp")


@query("i05_build_pool_hindsight", f"with @PG, {_POOL_SQL} select gw, element, price, position, team, points::double as xp from pl where position is not null and team is not null and price > 0")
def i05b(spark, sf):
    pg = panel(spark, sf).withColumn("gw", F.col("season") * 100 + F.col("gw")).withColumn("value", F.col("value") - 45)
    players = table(spark, sf, "supplier").selectExpr(
        "s_suppkey as element", "case when s_suppkey % 4 = 3 and s_suppkey % 8 = 7 then null else element_at(array('GK', 'DEF', 'MID', 'FWD'), cast(s_suppkey % 4 + 1 as int)) end as position",
        "nullif(cast(s_nationkey as bigint), 3) as team")
    return Q.build_pool(pg, ["gw", "element"], "total_points", "value", "seq", players, "element").select("gw", "element", "price", "position", "team", "xp")


def sells(spark, sf):
    s = squads(spark, sf)
    return grown_join(s, prices(s), ["squad_id", "gw", "element"]).withColumn("sell_price", selling_price("purchase_price", "current_price")).drop("current_price")


def market(spark, sf):
    """Every part on offer in every period."""
    return squads(spark, sf).selectExpr("gw", "element", "position", "team", "purchase_price + gw % 3 as price", "xp + (element * gw) % 701 * 10 as xp")


_SELL = """sl2 as (select sq.*, case when current_price <= 0 then purchase_price when current_price <= purchase_price then current_price else purchase_price + (current_price - purchase_price) // 2 end as sell_price
   from sq join pr on sq.squad_id = pr.squad_id and sq.gw = pr.gw and sq.element = pr.element)"""
_MARKET = "mk as (select gw, element, position, team, purchase_price + gw % 3 as price, xp + (element * gw) % 701 * 10 as xp from sq)"


@query("i06_best_single_transfer", f"""with @SQ, @PR, {_BANK}, {_SELL}, {_MARKET}, {_FORMATIONS},
 cd as (select s.squad_id, s.gw, s.slot, s.position, s.team as ot, s.sell_price, m.element as ie, m.team as it, m.price, m.xp as ix
   from sl2 s join mk m on m.gw = s.gw and m.position = s.position where not exists (select 1 from sq o where o.squad_id = s.squad_id and o.gw = s.gw and o.element = m.element)),
 ok as (select c.* from cd c join bk on bk.squad_id = c.squad_id and bk.gw = c.gw where price <= bank + sell_price
   and (select count(*) from sq t where t.squad_id = c.squad_id and t.gw = c.gw and t.team = c.it and t.slot <> c.slot) < 3),
 bi as (select squad_id, gw, slot, max(ix) as ix from ok group by all),
 al as (select squad_id, gw, 0 as alt, slot, position, xp from sq union all
   select s.squad_id, s.gw, b.slot as alt, s.slot, s.position, case when s.slot = b.slot then b.ix else s.xp end from bi b join sq s on s.squad_id = b.squad_id and s.gw = b.gw),
 rk as (select *, row_number() over (partition by squad_id, gw, alt, position order by xp desc) as rn from al),
 v as (select squad_id, gw, alt, d, m, f, sum(xp) + max(xp) as o from rk, fm where rn <= case position when 'GK' then 1 when 'DEF' then d when 'MID' then m else f end group by all having count(*) = 11),
 w as (select squad_id, gw, alt, max(o) as o from v group by all),
 z as (select w.squad_id, w.gw, max(case when alt = 0 then o end)::bigint as before, max(case when alt = 0 then o else o - greatest(1 - free, 0) * 4 end)::bigint as objective
   from w join bk on bk.squad_id = w.squad_id and bk.gw = w.gw group by all)
 select k.squad_id, k.gw, before, objective, objective - before as gain from (select distinct squad_id, gw from sq) k left join z on z.squad_id = k.squad_id and z.gw = k.gw""")
def i06(spark, sf):
    return Q.best_single_transfer(sells(spark, sf), market(spark, sf), bank(spark, sf), "squad_id", "gw", "element", "xp")


@query("i07_played", "with @SF select element, gw, minutes > 0 or yellow_cards + red_cards > 0 as played from sf")
def i07(spark, sf):
    return Q.played(squad_facts(spark, sf)).select("element", "gw", "played")


_JF = """jf as (select sq.*, coalesce(total_points, 0) as pts, coalesce(minutes, 0) > 0 or coalesce(yellow_cards, 0) + coalesce(red_cards, 0) > 0 as played
   from sq left join sf on sf.element = sq.element and sf.gw = sq.gw)"""


@query("i08_squad_points", f"""with @SQ, @SF, {_JF} select squad_id, gw, coalesce(sum(pts) filter (where in_lineup), 0)::bigint as lineup_points,
 coalesce(sum(pts) filter (where not in_lineup), 0)::bigint as bench_points from jf group by all""")
def i08(spark, sf):
    return Q.squad_points(squads(spark, sf), squad_facts(spark, sf), K)


def one_chip(spark, sf):
    return chips(spark, sf).groupBy(*K).agg(F.min("chip").alias("chip"))


_CAP = """cb as (select jf.squad_id, jf.gw, any_value(chip) as chip, max(pts) filter (where is_captain and played and in_lineup) as c, max(pts) filter (where is_vice and played and in_lineup) as v
   from jf left join ch on ch.squad_id = jf.squad_id and ch.gw = jf.gw group by all),
 cp as (select squad_id, gw, (coalesce(c, v, 0) * case when chip = 'triple_captain' then 2 else 1 end)::bigint as captain_points, c is null as captain_failover from cb)"""


@query("i09_captain_bonus", f"with @SQ, @SF, @CH, {_JF}, {_CAP} select * from cp")
def i09(spark, sf):
    return Q.captain_bonus(squads(spark, sf), squad_facts(spark, sf), one_chip(spark, sf), K)


_COUNT = "len(list_filter(lineup, lambda y: y.position = '{0}')) - (x.position = '{0}')::int + (sub.position = '{0}')::int"
_AFTER = f"({_COUNT.format('GK')}) = 1 and len(lineup) = 11 and ({_COUNT.format('DEF')}) || '-' || ({_COUNT.format('MID')}) || '-' || ({_COUNT.format('FWD')}) in {_LEGAL}"
_SUBS = f"""p0 as (select squad_id, gw, list({{'place': slot, 'slot': slot, 'position': position, 'open': not played, 'o': null::bigint}} order by slot) filter (where in_lineup) as lineup,
   list({{'slot': slot, 'position': position, 'played': played}} order by bench_order) filter (where not in_lineup) as bench from jf group by all),
 st as (select squad_id, gw, coalesce(lineup, []) as lineup, bench, 0 as n from p0
   union all select squad_id, gw, case when sub.played and chosen is not null then list_transform(lineup, lambda x: case when x.place = chosen
       then {{'place': x.place, 'slot': sub.slot, 'position': sub.position, 'open': false, 'o': x.slot}} else x end) else lineup end, bench, n + 1
     from (select *, list_filter(lineup, lambda x: x.open and {_AFTER})[1].place as chosen from (select *, bench[n + 1] as sub from st where n < coalesce(len(bench), 0)))),
 fin as (select squad_id, gw, unnest(lineup) as x from st where n = coalesce(len(bench), 0)),
 fs as (select sq.* exclude (in_lineup, bench_order), fin.x.slot is not null as in_lineup, case when fin.x.slot is null then sq.bench_order end as bench_order, r.element as for_element
   from sq left join fin on fin.squad_id = sq.squad_id and fin.gw = sq.gw and fin.x.slot = sq.slot left join sq r on r.squad_id = fin.squad_id and r.gw = fin.gw and r.slot = fin.x.o)"""


@query("i10_auto_subs", f"with recursive @SQ, @SF, {_JF}, {_SUBS} select squad_id, gw, slot, element, in_lineup, bench_order, for_element from fs")
def i10(spark, sf):
    out = Q.auto_subs(squads(spark, sf), squad_facts(spark, sf), K)
    return out.select(*K, "slot", "element", "in_lineup", "bench_order", "for_element")


def ledger(spark, sf):
    n = transfers(spark, sf).groupBy(*K).agg(F.count(F.lit(1)).alias("n"))
    return grown_join(grown_join(n, one_chip(spark, sf), K, "left"), bank(spark, sf), K).withColumn("hit", transfer_hit("n", "free", "chip").cast("bigint"))


_HIT = f"""{_BANK}, hn as (select tr.squad_id, tr.gw, count(*) as n, any_value(chip) as chip, any_value(free) as free from tr left join ch on ch.squad_id = tr.squad_id and ch.gw = tr.gw
   join bk on bk.squad_id = tr.squad_id and bk.gw = tr.gw group by tr.squad_id, tr.gw),
 ht as (select squad_id, gw, (case when chip in ('wildcard', 'free_hit') then 0 else greatest(n - free, 0) * 4 end)::bigint as hit from hn)"""
_SCORE = """sc as (select p.squad_id, p.gw, p.lineup_points, p.bench_points, cp.captain_points, cp.captain_failover, ch.chip, coalesce(ht.hit, 0) as hit,
   p.lineup_points + cp.captain_points + case when ch.chip = 'bench_boost' then p.bench_points else 0 end as gw_points from
   (select squad_id, gw, coalesce(sum(pts) filter (where in_lineup), 0)::bigint as lineup_points, coalesce(sum(pts) filter (where not in_lineup), 0)::bigint as bench_points from jf group by all) p
   join cp on cp.squad_id = p.squad_id and cp.gw = p.gw left join ch on ch.squad_id = p.squad_id and ch.gw = p.gw left join ht on ht.squad_id = p.squad_id and ht.gw = p.gw)"""


@query("i11_gameweek_score", f"with @SQ, @SF, @CH, @TR, {_JF}, {_CAP}, {_HIT}, {_SCORE} select *, gw_points - hit as net_points from sc")
def i11(spark, sf):
    return Q.gameweek_score(squads(spark, sf), squad_facts(spark, sf), ledger(spark, sf).select(*K, "hit"), one_chip(spark, sf), K)


_AFTER_SUBS = f"""with recursive @SQ, @SF, @CH, @TR, {_JF}, {_SUBS}, {_JF.replace("jf as", "jf2 as").replace("from sq left join", "from fs left join").replace("sq.", "fs.")},
 {_CAP.replace("jf", "jf2")}, {_HIT}, {_SCORE.replace("from jf ", "from jf2 ")} select *, gw_points - hit as net_points from sc"""


@query("i11_score_after_subs", _AFTER_SUBS)
def i11b(spark, sf):
    facts = squad_facts(spark, sf)
    final = Q.auto_subs(squads(spark, sf), facts, K)
    return Q.gameweek_score(final, facts, ledger(spark, sf).select(*K, "hit"), one_chip(spark, sf), K)


@query("i12_free_transfer_ledger", """with recursive @SQ, @TR, @CH, mv as (select k.squad_id, k.gw, coalesce(n, 0) as n, chip from (select distinct squad_id, gw from sq) k
   left join (select squad_id, gw, count(*) as n from tr group by all) t on t.squad_id = k.squad_id and t.gw = k.gw left join ch on ch.squad_id = k.squad_id and ch.gw = k.gw),
 fl as (select squad_id, gw, 1 as free, (case when chip in ('wildcard', 'free_hit') then 1 else least(greatest(1 - n, 0) + 1, 5) end)::int as free_next from mv where gw = 1
   union all select mv.squad_id, mv.gw, free_next, (case when chip in ('wildcard', 'free_hit') then free_next else least(greatest(free_next - n, 0) + 1, 5) end)::int
   from fl join mv on mv.squad_id = fl.squad_id and mv.gw = fl.gw + 1)
 select squad_id, gw, free::int as free, free_next from fl""")
def i12(spark, sf):
    n = transfers(spark, sf).groupBy(*K).agg(F.count(F.lit(1)).alias("n"))
    moves = grown_join(squads(spark, sf).select(*K).distinct(), n, K, "left").fillna(0, ["n"])
    moves = grown_join(moves, one_chip(spark, sf), K, "left")
    return Q.free_transfer_ledger(moves, "squad_id", "gw")


@query("i13_validate_chips", """with recursive @SQ, @CH, x as (select squad_id, gw, chip from ch union all select squad_id, gw, 'bench_boost' from ch where squad_id % 4 = 1 and chip <> 'bench_boost'
   union all select squad_id, unnest([19, 20]), 'free_hit' from ch where chip = 'free_hit' and gw = 12),
 o as (select squad_id, gw, chip, row_number() over (partition by squad_id order by gw, chip) as rn from x),
 r as (select squad_id, 0::bigint as rn, null::bigint as gw, null::varchar as chip, []::varchar[] as violations, []::struct(gw bigint, chip varchar)[] as booked from (select distinct squad_id from o)
  union all select squad_id, rn, gw, chip, v, case when len(v) = 0 then list_append(booked, {'gw': gw, 'chip': chip}) else booked end from (
   select o.squad_id, o.rn, o.gw, o.chip, r.booked, list_filter([case when o.chip not in ('wildcard', 'free_hit', 'bench_boost', 'triple_captain') then 'unknown' end,
    case when len(list_filter(r.booked, lambda b: b.gw = o.gw)) > 0 then 'second_in_period' end, case when len(list_filter(r.booked, lambda b: b.chip = o.chip and (b.gw <= 19) = (o.gw <= 19))) > 0 then 'used_in_half' end,
    case when o.chip = 'free_hit' and o.gw = 20 and len(list_filter(r.booked, lambda b: b.chip = 'free_hit' and b.gw = 19)) > 0 then 'free_hit_twice' end], lambda v: v is not null) as v
   from r join o on o.squad_id = r.squad_id and o.rn = r.rn + 1))
 select squad_id, gw, chip, violations from r where rn > 0""")
def i13(spark, sf):
    c = chips(spark, sf)
    extra = c.where("squad_id % 4 = 1 and chip <> 'bench_boost'").withColumn("chip", F.lit("bench_boost"))
    middle = c.where("chip = 'free_hit' and gw = 12").select("squad_id", F.explode(F.array(F.lit(19).cast("bigint"), F.lit(20).cast("bigint"))).alias("gw"), "chip")
    return Q.validate_chips(c.unionByName(extra).unionByName(middle), "squad_id", "gw")


@query("i14_audit_transfers", f"""with @SQ, @PR, @TR, {_BANK}, {_SELL}, {_MARKET},
 mg as (select gw, element, case when element % 29 = 0 then null else position end as position, team, case when (element + gw) % 11 = 0 or element % 17 = 0 then null else price end as price from mk),
 lg as (select squad_id, gw, element_out, element_in from tr union all select squad_id, gw, element + 1, element + 2 from sq where slot = 15 and squad_id % 13 = 4),
 t as (select lg.*, s.sell_price, s.position as op, s.team as ot, s.element is not null as owned, coalesce(m.price, b.price) as price, m.position as ip, m.team as it, bank,
   coalesce(s.sell_price, 0) - coalesce(m.price, b.price, 0) as cash from lg left join sl2 s on s.squad_id = lg.squad_id and s.gw = lg.gw and s.element = lg.element_out
   left join mg m on m.gw = lg.gw and m.element = lg.element_in left join mg b on b.gw = lg.gw - 1 and b.element = lg.element_in join bk on bk.squad_id = lg.squad_id and bk.gw = lg.gw),
 u as (select *, bank + sum(cash) over (partition by squad_id, gw order by cash desc, element_out, element_in rows unbounded preceding) as run from t),
 a as (select squad_id, gw, count(*) as n, count(*) filter (where not owned) as no, min(run)::bigint as lowest_bank, count(*) filter (where price is null) as np, count(*) filter (where ip is null) as nq,
   greatest(abs(count(*) filter (where ip = 'GK') - count(*) filter (where op = 'GK')), abs(count(*) filter (where ip = 'DEF') - count(*) filter (where op = 'DEF')),
     abs(count(*) filter (where ip = 'MID') - count(*) filter (where op = 'MID')), abs(count(*) filter (where ip = 'FWD') - count(*) filter (where op = 'FWD'))) as comp from u group by all),
 cl as (select squad_id, gw, max(n) as most from (select squad_id, gw, team, sum(d) as n from (
    select sq.squad_id, sq.gw, team, 1 as d from sq join a on a.squad_id = sq.squad_id and a.gw = sq.gw union all select squad_id, gw, ot, -1 from t where ot is not null
    union all select squad_id, gw, it, 1 from t where it is not null) group by all) group by all)
 select a.squad_id, a.gw, n as n_transfers, lowest_bank, list_filter([case when no > 0 then 'not_owned' end, case when np > 0 then 'unknown_price' end, case when nq > 0 then 'unknown_position' end, case when lowest_bank < 0 then 'bank' end,
   case when comp > 0 then 'composition' end, case when most > 3 then 'club_limit' end], lambda v: v is not null) as violations
 from a left join cl on cl.squad_id = a.squad_id and cl.gw = a.gw""")
def i14(spark, sf):
    s = sells(spark, sf)
    extra = s.where("slot = 15 and squad_id % 13 = 4").selectExpr("squad_id", "gw", "element + 1 as element_out", "element + 2 as element_in")
    book = transfers(spark, sf).unionByName(extra)
    gaps = market(spark, sf).withColumns({
        "position": F.expr("case when element % 29 = 0 then null else position end"),
        "price": F.expr("case when (element + gw) % 11 = 0 or element % 17 = 0 then null else price end")})
    return Q.audit_transfers(book, s, gaps, bank(spark, sf).select(*K, "bank"), "squad_id", "gw", "element")


@query("i15_team_value", f"""with @SQ, @PR, {_SELL}, v as (select squad_id, gw, sum(sell_price)::bigint as value from sl2 group by all)
 select squad_id, gw, value, value - lag(value) over (partition by squad_id order by gw) as value_change from v""")
def i15(spark, sf):
    s = squads(spark, sf)
    return Q.team_value(s, prices(s), ["squad_id"], "gw")


@query("i16_season_report", f"""with @SQ, @SF, @CH, @TR, {_JF}, {_CAP}, {_HIT}, {_SCORE}, nm as (select p_partkey as element, p_name || ' ' || p_partkey as name from part),
 sh as (select squad_id, gw, count(*) filter (where in_lineup and position = 'DEF') || '-' || count(*) filter (where in_lineup and position = 'MID') || '-' || count(*) filter (where in_lineup and position = 'FWD') as formation from sq group by all),
 ca as (select squad_id, gw, name as captain from sq join nm on nm.element = sq.element where is_captain),
 mv as (select squad_id, gw, string_agg(coalesce(a.name, element_out::varchar) || '>' || coalesce(b.name, element_in::varchar), ', '
   order by coalesce(a.name, element_out::varchar) || '>' || coalesce(b.name, element_in::varchar)) as transfers from tr left join nm a on a.element = element_out left join nm b on b.element = element_in group by all)
 select sc.squad_id, sc.gw, formation, gw_points as gross, hit, gw_points - hit as net, (sum(gw_points - hit) over (partition by sc.squad_id order by sc.gw rows unbounded preceding))::bigint as cumulative,
  captain, coalesce(transfers, '') as transfers from sc join sh on sh.squad_id = sc.squad_id and sh.gw = sc.gw left join ca on ca.squad_id = sc.squad_id and ca.gw = sc.gw
  left join mv on mv.squad_id = sc.squad_id and mv.gw = sc.gw""")
def i16(spark, sf):
    s = squads(spark, sf)
    scores = Q.gameweek_score(s, squad_facts(spark, sf), ledger(spark, sf).select(*K, "hit"), one_chip(spark, sf), K)
    names = table(spark, sf, "part").selectExpr("p_partkey as element", "concat(p_name, ' ', p_partkey) as name")
    return Q.season_report(scores, Q.formations(s, K), s.where("is_captain").select(*K, "element"), names, transfers(spark, sf), "squad_id", "gw")


@query("i17_audit_free_hit", """with @SQ, @CH, mb as (select squad_id, gw, case when squad_id % 5 = 0 and slot = gw then element + 7777777 else element end as element from sq),
 f as (select distinct squad_id, gw as hit_period from ch where chip = 'free_hit'),
 b as (select f.squad_id, hit_period, element from f join mb on mb.squad_id = f.squad_id and mb.gw = hit_period - 1),
 a as (select f.squad_id, hit_period, element from f join mb on mb.squad_id = f.squad_id and mb.gw = hit_period + 1),
 d as (select coalesce(a.squad_id, b.squad_id) as squad_id, coalesce(a.hit_period, b.hit_period) as hit_period, a.element as ae, b.element as be
   from a full join b on a.squad_id = b.squad_id and a.hit_period = b.hit_period and a.element = b.element)
 select squad_id, hit_period, count(*) filter (where ae is null or be is null) as n_different, count(*) filter (where ae is null or be is null) = 0 as reverted
 from d group by all having count(ae) > 0 and count(be) > 0""")
def i17(spark, sf):
    s = squads(spark, sf).withColumn("element", F.expr("case when squad_id % 5 = 0 and slot = gw then element + 7777777 else element end"))
    return Q.audit_free_hit(s, chips(spark, sf), "squad_id", "gw")
