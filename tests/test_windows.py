import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitlake.operators import joins as J
from pitlake.operators import windows as W
from pitlake.operators.aggs import pre_aggregate
from pitlake.operators.ranks import average_rank, competition_rank
from pitlake.operators.scale import lag_pair, ranges, row_numbers, running, spread_join, value_ranks

KEYS = ["season", "element"]
SPECS = [("p3", "total_points", 3, "mean"), ("p5", "total_points", 5, "mean"), ("m3", "minutes", 3, "mean"), ("s5", "minutes", 5, "std"), ("g3", "total_points", 3, "sum")]
FAST = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, rows):
    return spark.createDataFrame([(1, e, g, p, m, i) for i, (e, g, p, m) in enumerate(rows)], "season long, element long, gw long, total_points long, minutes long, seq long")


def features(spark, rows):
    agg = pre_aggregate(frame(spark, rows), [*KEYS, "gw"], ["total_points", "minutes"])
    out = W.lagged_rolling(agg, KEYS, "gw", SPECS)
    return {(r.element, r.gw): tuple(r[s[0]] for s in SPECS) for r in out.collect()}


def test_rolling_by_hand(spark):
    got = features(spark, [(1, g, 2 * g, 100 - 10 * g) for g in range(1, 6)])
    assert got[1, 1] == (None,) * 5
    assert [got[1, g][0] for g in range(2, 6)] == [2.0, 3.0, 4.0, 6.0]
    assert got[1, 5][1] == 5.0
    assert got[1, 4][2] == 80.0


def test_double_period_is_summed_first(spark):
    got = features(spark, [(1, 1, 3, 90), (1, 2, 5, 90), (1, 2, 7, 90), (1, 3, 4, 90)])
    assert len(got) == 3
    assert got[1, 3][0] == 7.5


def test_std(spark):
    assert features(spark, [(1, g, 1, 90) for g in range(1, 8)])[1, 7][3] == 0.0
    got = features(spark, [(1, 1, 0, 90), (1, 2, 0, 0), (1, 3, 0, 90)])[1, 3][3]
    assert got == pytest.approx(pd.Series([90.0, 0.0]).std())


ROWS = st.lists(st.tuples(st.integers(1, 3), st.integers(1, 8), st.integers(-3, 15), st.integers(0, 90)), min_size=3, max_size=40)


@FAST
@given(rows=ROWS, k=st.integers(2, 8))
def test_the_future_does_not_matter(spark, rows, k):
    before = features(spark, rows)
    after = features(spark, [(e, g, p + 100 if g >= k else p, m + 7 if g >= k else m) for e, g, p, m in rows])
    assert {x: v for x, v in before.items() if x[1] <= k} == {x: v for x, v in after.items() if x[1] <= k}


@FAST
@given(rows=ROWS)
def test_row_order_and_other_entities_do_not_matter(spark, rows):
    mixed = list(rows)
    random.Random(1).shuffle(mixed)
    assert features(spark, rows) == features(spark, mixed)
    mine = [r for r in rows if r[0] == rows[0][0]]
    got = features(spark, rows)
    assert all(got[x] == v for x, v in features(spark, mine).items())


def test_asof_is_strictly_before_the_cutoff(spark):
    ev = spark.createDataFrame(
        [(1, 100, "2023-08-12", 0.5), (1, 100, "2023-08-19", 1.0), (1, 100, "2023-08-26", 0.3), (1, 100, "2023-09-02", 0.8), (1, 100, "2023-09-16", 0.6)],
        "season long, code long, d string, xg double").selectExpr("season", "code", "cast(d as timestamp) ts", "d tie", "xg")
    cut = spark.createDataFrame(
        [(1, 1, "2023-08-12"), (1, 2, "2023-08-22"), (1, 3, "2023-08-29"), (1, 4, "2023-09-05"), (1, 5, "2023-09-19"), (1, 6, "2023-10-01")],
        "season long, period long, c string").selectExpr("season", "period", "cast(c as timestamp) cutoff")
    who = spark.createDataFrame([(1, 100), (1, 200)], "season long, code long")
    out = J.asof_rolling(ev, cut, ["season"], "code", "ts", "tie", [("xg3", "xg", 3)], entities=who)
    got = {(r.code, r.period): r.xg3 for r in out.collect()}
    assert got[100, 1] is None
    assert [round(got[100, p], 4) for p in range(2, 7)] == [0.75, 0.6, 0.7, 0.5667, 0.5667]
    assert all(got[200, p] is None for p in range(1, 7))


def test_asof_with_one_key_holding_most_rows(spark):
    rng = random.Random(3)
    rows = [(1, 7 if i % 3 else i % 50, i * 60, rng.randrange(100)) for i in range(5000)]
    ev = spark.createDataFrame(rows, "season long, code long, s long, v long").selectExpr("season", "code", "timestamp_seconds(s) ts", "s tie", "v")
    cuts = [(1, p, p * 9000) for p in range(1, 30)]
    cut = spark.createDataFrame(cuts, "season long, period long, s long").selectExpr("season", "period", "timestamp_seconds(s) cutoff")
    got = {(r.code, r.period): r.m for r in J.asof_rolling(ev, cut, ["season"], "code", "ts", "tie", [("m", "v", 10)]).collect()}
    by = {}
    for _, c, s, v in rows:
        by.setdefault(c, []).append((s, v))
    for c, items in by.items():
        for _, p, lim in cuts:
            last = [v for s, v in sorted(items) if s < lim][-10:]
            assert got[c, p] == (pytest.approx(sum(last) / len(last)) if last else None)


@FAST
@given(st.lists(st.tuples(st.sampled_from(["a", "a", "b"]), st.integers(0, 50), st.integers(-9, 9)), min_size=1, max_size=60))
def test_running_matches_pandas(spark, rows):
    rows = [(k, o * 100 + i, v) for i, (k, o, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = {r.o: (r.s, r.m) for r in running(df, ["k"], "o", {"s": ("v", "sum"), "m": ("v", "max")}, splits=5).collect()}
    p = pd.DataFrame(rows, columns=["k", "o", "v"]).sort_values("o")
    p["s"], p["m"] = p.groupby("k").v.cumsum(), p.groupby("k").v.cummax()
    assert got == {o: (s, m) for o, s, m in zip(p.o, p.s, p.m)}
    prev = {r.o: r.prev_v for r in lag_pair(df, ["k"], "o", ["v"], splits=5).collect()}
    want = dict(zip(p.o, p.groupby("k").v.shift(1)))
    assert all(prev[o] == (None if pd.isna(w) else w) for o, w in want.items())


def test_window_means_at_any_cutoffs(spark):
    """Cut-offs out of order, equal ones and periods without a cut-off, against a plain loop."""
    rng = random.Random(11)
    day = 86400
    rows = [(s, rng.choice("ab"), rng.randrange(1, 9), rng.randrange(90) * day, rng.choice([None, 1, 2, 5])) for s in (1, 2) for _ in range(80)]
    cuts = [(s, p, rng.randrange(100) * day) for s in (1, 2) for p in range(2, 9)] + [(1, 20, 50 * day), (1, 21, 50 * day)]
    df = spark.createDataFrame(rows, "season long, code string, gw long, t long, v long").withColumn("ts", F.timestamp_seconds("t"))
    cut = spark.createDataFrame(cuts, "season long, gw long, t long").select("season", "gw", F.timestamp_seconds("t").alias("cutoff"))
    got = {(r.season, r.code, r.gw): (r.window_mean, r.n_rows) for r in W.time_window_mean(df, cut, ["season"], "code", "gw", "ts", "v").collect()}
    want = {}
    for s, p, c in cuts:
        for k in "ab":
            own = [v for s2, k2, q, t, v in rows if s2 == s and k2 == k and q < p and c - 30 * day <= t < c and v is not None]
            if own:
                want[s, k, p] = (pytest.approx(sum(own) / len(own)), len(own))
    assert got == want


def test_as_of_and_window_means_with_very_many_cutoffs(spark):
    n = 100_000
    ev = spark.createDataFrame([(1, k, i, i * 40, k * 10 + i) for k in (1, 2) for i in range(20)], "season long, code long, tie long, t long, v long").withColumn("ts", F.timestamp_seconds("t"))
    cut = spark.range(n).select(F.lit(1).cast("long").alias("season"), F.col("id").alias("period"), F.timestamp_seconds("id").alias("cutoff"))
    out = J.asof_rolling(ev, cut, ["season"], "code", "ts", "tie", [("m", "v", 3)])
    assert out.count() == 2 * n
    got = {(r.code, r.period): r.m for r in out.where("period in (0, 1, 40, 41, 99999)").collect()}
    assert got == {(k, p): None if p == 0 else k * 10 + {1: 0, 40: 0, 41: 0.5, 99999: 18}[p] for k in (1, 2) for p in (0, 1, 40, 41, 99999)}
    means = W.time_window_mean(ev.withColumn("period", F.lit(-1).cast("long")), cut, ["season"], "code", "period", "ts", "v", days=1)
    assert means.count() == 2 * (86400 + 19 * 40)
    last = {r.code: (r.window_mean, r.n_rows) for r in means.where("period = 86800").collect()}
    assert last == {k: (k * 10 + 14.5, 10) for k in (1, 2)}


def test_only_large_groups_are_cut(spark):
    rows = [("a", i % 7, i) for i in range(100)] + [("b", i, i) for i in range(5)] + [(None, i, i) for i in range(30)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    whole, cut = ranges(df, ["k"], ["o", "v"], rows=20)
    assert {r.k for r in whole.collect()} == {"b"}
    assert cut.count() == 130 and cut.select("__bucket").distinct().count() > 3
    assert ranges(df, ["k"], ["o"], rows=1000)[1] is None


def test_prefix_scan_over_ranges(spark):
    rng = random.Random(3)
    rows = [(g, rng.randrange(40), i) for g in ("a", "b", None) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o long, i long")
    order = lambda r: (r[1], r[2])
    want = {(g, i): n for g in ("a", "b", None) for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == g), key=order))}
    for splits in (None, 7):
        assert {(r.k, r.i): r.place for r in row_numbers(df, ["k"], ["o", "i"], splits=splits).collect()} == want
        for r in value_ranks(df, ["k"], "o", splits=splits).collect():
            own = [x[1] for x in rows if x[0] == r.k]
            assert (r.n_equal, r.n_less, r.n_greater) == (own.count(r.o), sum(x < r.o for x in own), sum(x > r.o for x in own))
        back = {(r.k, r.i): r.s for r in running(df, ["k"], "o", {"s": ("o", "sum")}, ["i"], descending=True, inclusive=False, splits=splits).collect()}
        for g, o, i in rows:
            later = [x[1] for x in rows if x[0] == g and order(x) > (o, i)]
            assert back[g, i] == (sum(later) if later else None)


def test_resume_dedup(spark):
    steps = [10, 20, 30, 40, 25, 35, 45, 41, 50]
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate(steps)], "run string, i long, step long")
    kept = [r.step for r in W.resume_dedup(df, ["run"], "i", "step").orderBy("i").collect()]
    assert kept == [10, 20, 25, 35, 41, 50]


def test_ranks_match_pandas(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randrange(9)) for g in (1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "gw long, i long, v long")
    p = pd.DataFrame(rows, columns=["gw", "i", "v"])
    avg = {(r.gw, r.i): r.r for r in average_rank(df, ["gw"], {"v": "r"}).collect()}
    low = {(r.gw, r.i): r.r for r in competition_rank(df, ["gw"], "v", "r").collect()}
    p["a"] = p.groupby("gw").v.rank()
    p["c"] = p.groupby("gw").v.rank(method="max", ascending=False)
    assert avg == {(g, i): a for g, i, a in zip(p.gw, p.i, p.a)}
    assert low == {(g, i): c for g, i, c in zip(p.gw, p.i, p.c)}


def test_streak_is_capped_and_broken(spark):
    rows = [(1, g, 0, m) for g, m in enumerate([0, 0, 0, 0, 90, 0, 45], 1)]
    from pyspark.sql import functions as F

    out = W.trailing_streak(frame(spark, rows), KEYS, "gw", F.col("minutes") == 0).orderBy("gw").collect()
    assert [r.streak for r in out] == [0, 1, 2, 3, 3, 0, 1]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_is_the_plain_join(spark, how):
    big = spark.createDataFrame([(i % 3 if i % 2 else 0, i) for i in range(200)], "k long, i long")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spread_join(big, small, ["k"], ["i"], how).select(big.join(small, ["k"], how).columns)) == key(big.join(small, ["k"], how))


def test_time_window_counts_only_earlier_periods(spark):
    rows = [(1, 1, 1, "2024-01-01", 4), (1, 1, 2, "2024-01-20", 8), (1, 1, 2, "2024-02-06", 100), (1, 1, 3, "2024-02-05", 6)]
    df = spark.createDataFrame(rows, "season long, e long, gw long, d string, v long").selectExpr("season", "e", "gw", "cast(d as timestamp) ts", "v")
    cut = spark.createDataFrame([(1, 2, "2024-01-20"), (1, 3, "2024-02-05"), (1, 4, "2024-03-06")], "season long, gw long, d string")
    cut = cut.selectExpr("season", "gw", "cast(d as timestamp) cutoff")
    out = W.time_window_mean(df, cut, ["season"], "e", "gw", "ts", "v", 30)
    assert {r.gw: (r.window_mean, r.n_rows) for r in out.collect()} == {2: (4.0, 1), 3: (8.0, 1), 4: (53.0, 2)}


def test_vector_carries_only_what_slots_read(spark, tmp_path):
    from pyspark.sql import functions as F

    from pitlake.operators import features as X

    rows = [(1, 1, g, "GK", 10 * g, 7 * g, "x") for g in (1, 2, 3)]
    spark.createDataFrame(rows, "season long, element long, gw long, position string, value long, points long, ballast string").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    past = {"form": lambda w: F.avg("points").over(w.rangeBetween(-5, -1))}
    slots = [X.Slot("pre", "value"), X.Slot("post", "points"), X.Slot("past", "form")]
    out = X.point_in_time_vector(df, df, df, ["season"], "element", "gw", "position", slots, past)
    assert "ballast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.gw: r.features for r in out.collect()} == {1: [10.0, 0.0, 0.0], 2: [20.0, 7.0, 7.0], 3: [30.0, 14.0, 10.5]}
