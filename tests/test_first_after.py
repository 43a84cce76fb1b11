"""The sweep over cut-offs looks at distinct times only."""

from pitlake.operators import scale


def test_only_distinct_times_are_swept(spark, monkeypatch):
    swept = []
    monkeypatch.setattr(scale, "running", lambda df, *a, _f=scale.running, **k: (swept.append(df.count()), _f(df, *a, **k))[1])
    rows = spark.range(900).selectExpr("if(id % 9 = 8, null, id % 2) as s", "if(id % 7 = 6, null, cast(id % 5 as int)) as t", "id")
    cuts = spark.createDataFrame([(0, 1, 10), (0, 3, 30), (0, 3, 31), (1, 2, 20), (None, 4, 40)], "s long, c int, p long")
    got = {r.id: r.n and (r.n.c, r.n.p) for r in scale.first_after(rows, cuts, ["s"], "t", "c", "n").collect()}
    lists = {s: sorted((r.c, r.p) for r in cuts.collect() if r.s == s) for s in (0, 1, None)}
    # a missing time comes before every cut-off
    want = {r.id: next((c for c in lists[r.s] if r.t is None or c[0] > r.t), None) for r in rows.collect()}
    assert got == want
    assert swept and max(swept) <= 3 * 6 + 5


def test_many_times_are_merged(spark, monkeypatch):
    monkeypatch.setattr(scale, "FEW_TIMES", 0)
    rows = spark.range(50).selectExpr("id % 2 as s", "id as t")
    cuts = spark.createDataFrame([(0, 10), (1, 25)], "s long, c long")
    out = scale.first_after(rows, cuts, ["s"], "t", "c", "n")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.s, r.t): r.n and r.n.c for r in out.collect()} == {(i % 2, i): c if i < (c := (10, 25)[i % 2]) else None for i in range(50)}
