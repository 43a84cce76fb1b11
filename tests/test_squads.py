import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitlake.functions.scalars import selling_price, transfer_hit
from pitlake.operators import squads as Q

POS = ["GK"] * 2 + ["DEF"] * 5 + ["MID"] * 5 + ["FWD"] * 3
BENCH = {2: 1, 7: 2, 12: 3, 15: 4}
KEYS = ["squad_id", "gw"]
SCHEMA = ("squad_id long, gw long, slot long, element long, position string, team long, purchase_price long, xp long,"
          " in_lineup boolean, is_captain boolean, is_vice boolean, bench_order long")


def squad(sid, xp=None, team=None, bench=BENCH):
    return [
        (sid, 1, s, sid * 100 + s, POS[s - 1], (team or (lambda s: s))(s), 50, xp[s - 1] if xp else s, s not in bench, s == 8, s == 3, bench.get(s))
        for s in range(1, 16)
    ]


def legal(c):
    return c.count("GK") == 1 and (c.count("DEF"), c.count("MID"), c.count("FWD")) in Q.FORMATIONS


def best(xp):
    options = [c for c in itertools.combinations(range(15), 11) if legal([POS[i] for i in c])]
    return max(sum(xp[i] for i in c) + max(xp[i] for i in c) for c in options)


def test_best_lineup_against_all_lineups(spark):
    rng = random.Random(0)
    data = {i: [rng.randrange(-5, 20) for _ in range(15)] for i in range(12)}
    df = spark.createDataFrame([r for i, xp in data.items() for r in squad(i, xp)], SCHEMA)
    got = {r.squad_id: r.objective for r in Q.best_lineup(df, KEYS, "xp").collect()}
    assert got == {i: best(xp) for i, xp in data.items()}


def test_best_transfer_against_all_swaps(spark):
    rng = random.Random(4)
    rows, want = [], {}
    pool = [(1, 5000 + i, POS[i % 15], 1 + i % 9, rng.randrange(40, 70), rng.randrange(0, 25)) for i in range(60)]
    for sid in range(6):
        xp = [rng.randrange(0, 15) for _ in range(15)]
        teams = [1 + (s + sid) % 6 for s in range(15)]
        rows += squad(sid, xp, lambda s: teams[s - 1])
        bank, free = rng.randrange(0, 8), sid % 2
        base = best(xp)
        top = base
        for s in range(15):
            for _, e, p, t, price, x in pool:
                if p != POS[s] or price > bank + 50 or sum(teams[j] == t for j in range(15) if j != s) >= 3:
                    continue
                top = max(top, best(xp[:s] + [x] + xp[s + 1:]) - 4 * max(1 - free, 0))
        want[sid] = (base, top, bank, free)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("sell_price", F.lit(50))
    market = spark.createDataFrame(pool, "gw long, element long, position string, team long, price long, xp long")
    ledger = spark.createDataFrame([(s, 1, w[2], w[3]) for s, w in want.items()], "squad_id long, gw long, bank long, free long")
    out = Q.best_single_transfer(df, market, ledger, "squad_id", "gw", "element", "xp", first_look=2).collect()
    assert {r.squad_id: (r.before, r.objective) for r in out} == {s: w[:2] for s, w in want.items()}


def test_gain_behind_many_dearer_players(spark):
    """The only affordable better player of a position stands behind more dearer ones than are looked at first."""
    pool = [(1, 6000 + i, "GK", 100 + i, 999, 1000 - i) for i in range(400)] + [(1, 7000, "GK", 7, 50, 30), (1, 7001, "DEF", 8, 999, 99)]
    df = spark.createDataFrame(squad(0, [1] * 15), SCHEMA).withColumn("sell_price", F.lit(50))
    market = spark.createDataFrame(pool, "gw long, element long, position string, team long, price long, xp long")
    ledger = spark.createDataFrame([(0, 1, 0, 1)], "squad_id long, gw long, bank long, free long")
    r = Q.best_single_transfer(df, market, ledger, "squad_id", "gw", "element", "xp").first()
    assert (r.before, r.objective) == (12, 70)


def test_candidates_are_judged_beside_the_slot(spark, monkeypatch):
    """No join of squads times candidates with the members or clubs; a club of four stays full when one leaves."""
    joins = []
    plain = Q.grown_join
    monkeypatch.setattr(Q, "grown_join", lambda a, b, on, *how: joins.append(list(on)) or plain(a, b, on, *how))
    rows = squad(0, [1] * 15, lambda s: 7 if s <= 3 else 8 if 5 < s <= 9 else s) + squad(1, [1] * 15, lambda s: 7 if s <= 3 else s + 20)
    pool = [(1, 5000, "GK", 7, 50, 5), (1, 5001, "DEF", 7, 50, 9), (1, 5002, "MID", 8, 50, 20), (1, None, "FWD", None, 50, 2), (1, 5003, "FWD", 4, None, 99)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("sell_price", F.lit(50))
    market = spark.createDataFrame(pool, "gw long, element long, position string, team long, price long, xp long")
    ledger = spark.createDataFrame([(0, 1, 0, 1), (1, 1, 0, 1)], "squad_id long, gw long, bank long, free long")
    best = Q._best_incoming(df, market, ledger, KEYS, "gw", "element", "xp", 2).collect()
    assert {(r.squad_id, r.slot, r.in_xp) for r in best} == {
        *[(s, slot, 5) for s in (0, 1) for slot in (1, 2)], *[(s, 3, 9) for s in (0, 1)], *[(1, slot, 20) for slot in range(8, 13)], *[(s, slot, 2) for s in (0, 1) for slot in (13, 14, 15)]}
    assert not any("in_item" in on or "in_team" in on for on in joins)


def twin_subs(pdf: pd.DataFrame) -> pd.DataFrame:
    lineup = pdf[pdf.in_lineup].sort_values("slot")[["slot", "position", "played"]].values.tolist()
    opened = [not x[2] for x in lineup]
    for _, b in pdf[~pdf.in_lineup].sort_values("bench_order").iterrows():
        if not b.played:
            continue
        for i in range(len(lineup)):
            trial = [x[1] for x in lineup]
            trial[i] = b.position
            if opened[i] and legal(trial):
                lineup[i], opened[i] = [b.slot, b.position, True], False
                break
    return pd.DataFrame({"squad_id": pdf.squad_id.iloc[0], "slot": [int(x[0]) for x in lineup]})


def test_auto_subs_against_grouped_twin(spark):
    rng = random.Random(9)
    benches = [BENCH, {2: 1, 6: 2, 7: 3, 15: 4}, {2: 1, 10: 2, 11: 3, 12: 4}, {7: 1, 2: 2, 15: 3, 12: 4}]
    rows = [r for i in range(40) for r in squad(i, bench=benches[i % 4])]
    facts = [(r[3], 1, 2, rng.choice([0, 0, 60]), int(rng.random() < 0.1), 0) for r in rows if rng.random() < 0.9]
    df = spark.createDataFrame(rows, SCHEMA)
    f = spark.createDataFrame(facts, "element long, gw long, total_points long, minutes long, yellow_cards long, red_cards long")
    got = {(r.squad_id, r.slot) for r in Q.auto_subs(df, f, KEYS).where("in_lineup").collect()}
    played = Q._with_facts(df, f, "gw", "element").select("squad_id", "slot", "position", "in_lineup", "bench_order", "played")
    want = played.groupBy("squad_id").applyInPandas(twin_subs, "squad_id long, slot long").collect()
    assert got == {(r.squad_id, r.slot) for r in want}
    assert got != {(r[0], r[2]) for r in rows if r[8]}


def test_captain_failover(spark):
    df = spark.createDataFrame([r for i in range(4) for r in squad(i)], SCHEMA)
    # squad 0: captain plays; 1: captain absent, vice plays; 2: neither; 3: captain sent off without minutes
    facts = [(8, 1, 7, 90, 0, 0), (103, 1, 5, 90, 0, 0), (308, 1, -3, 0, 0, 1)]
    f = spark.createDataFrame(facts, "element long, gw long, total_points long, minutes long, yellow_cards long, red_cards long")
    chips = spark.createDataFrame([(1, 1, "triple_captain")], "squad_id long, gw long, chip string")
    got = {r.squad_id: (r.captain_points, r.captain_failover) for r in Q.captain_bonus(df, f, chips, KEYS).collect()}
    assert got == {0: (7, False), 1: (10, True), 2: (0, True), 3: (-3, False)}


@pytest.mark.parametrize("buy,now,sell", [(50, 50, 50), (50, 45, 45), (50, 60, 55), (50, 53, 51), (50, 51, 50), (60, 100, 80), (50, 0, 50)])
def test_selling_price(spark, buy, now, sell):
    assert spark.range(1).select(selling_price(F.lit(buy), F.lit(now)).alias("x")).first().x == sell


@pytest.mark.parametrize("n,free,chip,hit", [(0, 1, None, 0), (1, 1, None, 0), (2, 3, None, 0), (2, 1, None, 4), (5, 2, None, 12), (1, 0, None, 4), (9, 1, "wildcard", 0), (3, 1, "bench_boost", 8)])
def test_transfer_hit(spark, n, free, chip, hit):
    assert spark.range(1).select(transfer_hit(F.lit(n), F.lit(free), F.lit(chip).cast("string")).alias("x")).first().x == hit


@pytest.mark.parametrize("free,made,chip,nxt", [(1, 0, None, 2), (2, 1, None, 2), (4, 0, None, 5), (5, 0, None, 5), (3, 5, "wildcard", 3), (4, 3, "free_hit", 4), (2, 2, None, 1), (1, 3, None, 1)])
def test_free_transfers(spark, free, made, chip, nxt):
    df = spark.createDataFrame([(1, 1, made, chip)], "s long, gw long, n long, chip string")
    r = Q.free_transfer_ledger(df, "s", "gw", start=free).first()
    assert (r.free, r.free_next) == (free, nxt)


def test_chip_rules(spark):
    rows = [(1, 3, "wildcard"), (1, 10, "wildcard"), (1, 25, "wildcard"), (1, 19, "free_hit"), (1, 20, "free_hit"), (1, 30, "magic"), (2, 5, "bench_boost"), (2, 5, "free_hit")]
    out = Q.validate_chips(spark.createDataFrame(rows, "s long, gw long, chip string"), "s", "gw").collect()
    got = {(r.s, r.gw, r.chip): r.violations for r in out}
    assert got[1, 3, "wildcard"] == [] and got[1, 10, "wildcard"] == ["used_in_half"] and got[1, 25, "wildcard"] == []
    assert got[1, 20, "free_hit"] == ["free_hit_twice"] and got[1, 30, "magic"] == ["unknown"]
    assert sorted(map(len, (got[2, 5, "bench_boost"], got[2, 5, "free_hit"]))) == [0, 1]


def test_audit_squads(spark):
    good = squad(1, team=lambda s: s)
    crowded = squad(2, team=lambda s: 1 if s <= 4 else s)
    no_captain = [(*r[:9], False, *r[10:]) for r in squad(3)]
    short = squad(4)[:14]
    bank = spark.createDataFrame([(1, 1, 0), (2, 1, 5), (3, 1, -1)], "squad_id long, gw long, bank long")
    df = spark.createDataFrame(good + crowded + no_captain + short, SCHEMA)
    got = {r.squad_id: r.violations for r in Q.audit_squads(df, bank, KEYS).collect()}
    assert got == {1: [], 2: ["club_limit"], 3: ["captain", "bank"], 4: ["size", "quota_FWD", "bench_size"]}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _grown(spark, path):
    """Squads of twelve periods, made by an explode that the planner's estimate doesn't see."""
    spark.createDataFrame(squad(1) + squad(2), SCHEMA).drop("gw").write.parquet(path)
    one = spark.read.parquet(path)
    return one.withColumn("gw", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(12).cast("bigint"))))


def test_squads_are_not_broadcast(spark, tmp_path):
    s = _grown(spark, f"{tmp_path}/squads")
    prices = s.selectExpr("squad_id", "gw", "element", "purchase_price + 4 as current_price")
    facts = s.selectExpr("gw", "element", "slot as total_points", "slot - 1 as minutes", "0 as yellow_cards", "0 as red_cards").hint("merge")
    bank = s.where("slot = 1").selectExpr("squad_id", "gw", "5 as bank")
    sold = s.withColumn("sell_price", F.lit(50))
    book = s.where("slot = 4").selectExpr("squad_id", "gw", "element as element_out", "element + 1 as element_in")
    pool = s.selectExpr("gw", "element", "position", "team", "purchase_price as price")
    for df in (Q.team_value(s, prices, ["squad_id"], "gw"), Q.auto_subs(s, facts, KEYS), Q.audit_squads(s, bank, KEYS),
               Q.audit_transfers(book, sold, pool, bank, "squad_id", "gw", "element")):
        assert "BroadcastExchange" not in _plan(df)


def test_registered_prices_are_not_broadcast(spark, tmp_path):
    from pitlake.plans.catalog import QUERIES

    rows = [(i, f"p{i}", f"Brand#{i % 5}", "T", i % 50, 900.0 + i) for i in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["b17_selling_price"](spark, str(tmp_path))
    assert "BroadcastExchange" not in _plan(df)
    assert df.count() == 60 * 12


def test_audit_counts_squads_after_their_shuffle(spark, tmp_path):
    s = _grown(spark, f"{tmp_path}/squads")
    out = Q.audit_squads(s, s.where("slot = 1").selectExpr("squad_id", "gw", "5 as bank"), KEYS)
    assert "HashAggregate" not in _plan(out).split("REPARTITION_BY_COL", 1)[1]
    assert out.count() == 24
