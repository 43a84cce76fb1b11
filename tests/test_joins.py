import random

from pitlake.functions.names import normalise_name
from pitlake.operators import joins as J

SCENARIO = [
    (1, g, t, 3 - t, (g % 2 == 1) == (t == 1), g if t == 1 else 2 * g, g if t == 1 else g + 1, 1000 + g, 100 * t + i)
    for g in range(1, 6) for t in (1, 2) for i in (1, 2)
]
COLS = "season long, gw long, team long, opponent_team long, was_home boolean, goals_conceded long, total_points long, fixture long, element long"


def test_opponent_scenario(spark):
    df = spark.createDataFrame(SCENARIO, COLS)
    fixtures = spark.createDataFrame([(1, 1000 + g, 4, 2) for g in range(1, 6)], "season long, fixture long, team_h_difficulty long, team_a_difficulty long")
    teams = spark.createDataFrame([(1, 4, 1200, 1100, 1000, 900), (2, 3, 1300, 1250, 1150, 1050)],
                                  "id long, strength long, strength_attack_home long, strength_attack_away long, strength_defence_home long, strength_defence_away long")
    out = J.opponent_features(df, fixtures, teams, ["season"], "element", "gw", "total_points", "goals_conceded")
    rows = [r for r in out.orderBy("gw").collect() if r.element == 101]
    assert [r.opp_goals_conceded_r5 for r in rows] == [None, 2.0, 3.0, 4.0, 5.0]
    # team 2 gave up 2 x gw points per period to team 1's two players
    assert [r.opp_pts_conceded_r5 for r in rows] == [None, 2.0, 3.0, 4.0, 5.0]
    assert [r.was_home for r in rows] == [1.0, 0.0, 1.0, 0.0, 1.0]
    assert [r.fdr for r in rows][:2] == [0.8, 0.4]
    assert [r.opp_attack_strength for r in rows][:2] == [1250 / 1500, 1300 / 1500]
    assert all(r.is_dgw == 0.0 for r in rows)


def test_missing_dimensions_give_null(spark):
    df = spark.createDataFrame(SCENARIO, COLS)
    fixtures = spark.createDataFrame([], "season long, fixture long, team_h_difficulty long, team_a_difficulty long")
    teams = spark.createDataFrame([], "id long, strength long, strength_attack_home long, strength_attack_away long, strength_defence_home long, strength_defence_away long")
    rows = J.opponent_features(df, fixtures, teams, ["season"], "element", "gw", "total_points", "goals_conceded").collect()
    assert len(rows) == 20 and all(r.fdr is None and r.opp_strength is None for r in rows)


def test_names(spark):
    names = ["Rúben  Dias", "Ødegaard", "MARTÍN\tŽivković", "Łukasz", "é", "plain", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string")
    got = [r.x for r in df.select("i", normalise_name("n").alias("x")).orderBy("i").collect()]
    assert got == ["ruben dias", "ødegaard", "martin zivkovic", "łukasz", "e", "plain", None]


PEOPLE = [(1, "Benjamin", "White", "White"), (2, "Rúben", "dos Santos Gato Alves Dias", "Rúben"), (3, "Rodrigo 'Rodri'", "Hernandez", "Rodri H."), (4, "Ben", "White", "B.White")]


def test_variants_and_prefixes(spark):
    people = spark.createDataFrame([(c * 100, i, f, s, w) for i, (c, f, s, w) in enumerate(PEOPLE)], "code long, ord long, f string, s string, w string")
    variants = J.name_variants(people, "code", "ord", "f", "s", "w")
    index = {r.norm: r.code for r in J.name_index(variants, "code").collect()}
    assert index["benjamin white"] == 100 and index["white"] == 100
    assert index["ruben dias"] == 200 and index["rodri"] == 300 and index["ben white"] == 400
    probes = spark.createDataFrame([("Ben White",), ("Benj White",), ("RODRI",), ("Ben",), ("Nobody",), ("Be White",)], "name string")
    got = {r.name: r.code for r in J.match_names(probes, "name", variants, "code").collect()}
    assert got == {"Ben White": 400, "Benj White": 100, "RODRI": 300, "Ben": 400, "Nobody": None, "Be White": None}


def test_contains_against_brute_force(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 14))).strip() or "a" for _ in range(120)]
    probes = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(40)})
    people = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, name string")
    wanted = spark.createDataFrame([(p,) for p in probes], "probe string")
    got = {(r.i, r.probe) for r in J.contains_lookup(people, "name", wanted, "probe").collect()}
    clean = [" ".join(n.split()) for n in names]
    want = {(i, p) for i, n in enumerate(clean) for p in probes if p in n}
    assert got == want
    # several automata, one after the other; equal probes, empty ones and missing names
    again = wanted.unionByName(wanted.limit(3)).unionByName(spark.createDataFrame([("",), (None,), (" ",)], "probe string"))
    more = people.unionByName(spark.createDataFrame([(999, None)], "i long, name string"))
    pairs = [(r.i, r.probe) for r in J.contains_lookup(more, "name", again, "probe", block_chars=20).collect()]
    assert set(pairs) == want and len(pairs) == len(want) + sum(1 for _, p in want if p in {r.probe for r in wanted.limit(3).collect()})
    assert J.contains_lookup(people, "name", wanted.limit(0), "probe").count() == 0


def test_repair_team_cases(spark):
    rows = [
        ("ids", 1, "7", 8), ("ids", 1, "8", 7),
        ("names", 1, "Ajax", 8), ("names", 1, "Brest", 7), ("names", 2, "Ajax", 8),
        ("none", 1, None, 8), ("none", 1, None, 7), ("none", 2, None, 7),
    ]
    df = spark.createDataFrame(rows, "season string, fixture long, team string, opp long")
    out = {(r.season, r.fixture, r.team, r.opp): r.team_id for r in J.repair_team(df, ["season"], "fixture", "team", "opp").collect()}
    assert out["ids", 1, "7", 8] == 7
    assert out["names", 1, "Ajax", 8] == 7 and out["names", 1, "Brest", 7] == 8 and out["names", 2, "Ajax", 8] == 7
    assert out["none", 1, None, 8] == 7 and out["none", 1, None, 7] == 8 and out["none", 2, None, 7] is None


def test_named_sides_take_own_list_then_master_list(spark):
    own = spark.createDataFrame([(1, "Ajax", 7), (1, "Ajax", 5), (1, None, 9), (2, "Ajax", None)], "season int, name string, id long")
    master = spark.createDataFrame([(1, "Brest", 3), (2, "Ajax", 4), (2, "Brest", 6)], "season int, name string, id long")
    names = J.team_names(own, master, ["season"])
    assert {tuple(r) for r in names.collect()} == {(1, "Ajax", 7), (2, "Ajax", 4), (2, "Brest", 6)}
    rows = [(1, "Ajax", "Brest"), (2, "AFC Ajax", "Brest"), (2, "Brest", "Ajax"), (3, "Ajax", "Brest"), (2, None, "Brest"), (2, "Brest", "Ajax")]
    matches = spark.createDataFrame(rows, "season int, home string, away string")
    aliases = spark.createDataFrame([("AFC Ajax", "Ajax")], "alias string, name string")
    out = J.sides_to_ids(matches, names, ["season"], ["home", "away"], ["away"], aliases)
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(key, out.collect())) == sorted([(1, 7, -1), (2, 4, 6), (2, 6, 4), (2, 6, 4), (3, -1, -1), (2, -1, 6)])
    assert out.columns == ["season", "home", "away"]


def test_full_names_are_joined_once(spark):
    """Full names before short ones, the last and the first person of a name; one join, by a key of fixed size."""
    people = spark.createDataFrame(
        [(1, 10, "Ana Lima", "Lima"), (2, 20, "ANA  Lima", "Ana"), (3, 30, None, "Lima"), (4, 40, "Lima", None), (5, None, "Rui", "Rui")], "code long, ord long, full string, web string")
    probes = spark.createDataFrame([(1, "ana lima"), (2, "Lima"), (3, "Aná"), (4, None), (5, "nobody"), (6, "Rui")], "id long, name string")
    out = J.match_full_name(probes, "name", people, "code", "ord", "full", "web")
    assert {(r.id, r.norm, r.code) for r in out.collect()} == {(1, "ana lima", 2), (2, "lima", 4), (3, "ana", 2), (4, None, None), (5, "nobody", None), (6, "rui", None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1


def test_texts_are_cut_into_tasks(spark):
    texts = spark.createDataFrame([(i, "abc " * 50 + str(i)) for i in range(60)] + [(99, None)], "id long, text string").coalesce(1)
    probes = spark.createDataFrame([("c 1",), ("c 59",), ("zzz",)], "probe string")
    out = J.contains_lookup(texts, "text", probes, "probe", task_chars=500)
    assert {(r.id, r.probe) for r in out.collect()} == {(59, "c 59"), (1, "c 1"), *[(i, "c 1") for i in range(10, 20)]}
    assert "RoundRobinPartitioning(25)" in out._jdf.queryExecution().executedPlan().toString()
