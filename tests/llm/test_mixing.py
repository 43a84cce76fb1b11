import random

import pytest

from pitlake.llm import mixing as m


def fill(sizes, weights, total, limit=3):
    """Share by weight, cap, share the excess again."""
    target = {s: 0.0 for s in sizes}
    open_, left = {s for s in sizes if sizes[s]}, total
    while open_ and left > 1e-9:
        w = sum(weights[s] for s in open_)
        for s in open_:
            target[s] += left * weights[s] / w
        left = 0.0
        for s in list(open_):
            if target[s] >= limit * sizes[s]:
                left += target[s] - limit * sizes[s]
                target[s] = float(limit * sizes[s])
                open_.discard(s)
    return target


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 12345])
def test_highest_quotients(spark, seats):
    rng = random.Random(seats)
    votes = [(g, i, float(rng.choice([0, 1, 5, 5, 30, 1000, 9999]))) for g in "ab" for i in range(8)]
    got = {(r.g, r.i): r.quota for r in m.sainte_lague(spark.createDataFrame([(*v, seats) for v in votes], "g string, i int, v double, seats long"), "g", ["i"], "v", "seats").collect()}
    for g in "ab":
        won = dict.fromkeys(range(8), 0)
        for _ in range(seats):
            best = max((v / (2 * won[i] + 1), -i) for h, i, v in votes if h == g)
            won[-best[1]] += 1
        assert {i: got[(g, i)] for i in range(8)} == won


def docs(spark, seed=0):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "B", "é", None]), rng.choice([0, 1, 5, 40, 400])) for i in range(3000)]
    rows += [(5000, "tiny", 7), (5001, "empty", 0), (5002, "gone", None), (None, "a", 9), (7, "a", 4), (7, "a", 4)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, size long")


def test_mix_meets_its_targets(spark, monkeypatch):
    monkeypatch.setattr(m, "SHARD_DOCS", 100)
    rows, frame = docs(spark)
    weights = m.cyclic_weights(frame)
    given = {r.source: r.weight for r in weights.collect()}
    order = sorted([s for s in given if s is not None], key=lambda s: s.encode()) + [None]
    assert [given[s] for s in order] == [i % 3 + 1 for i in range(len(order))]
    out = m.mix(frame, weights, ["doc_id"]).collect()
    assert len(out) == len(rows)
    sizes = {s: sum(r[2] or 0 for r in rows if r[1] == s) for s in given}
    want = fill(sizes, given, sum(sizes.values()))
    for s in given:
        own = [r for r in out if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * (1 + want[s]) and r.source_size == sizes[s] for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= m.BLOCK_TOKENS * 20
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    again = m.mix(frame.repartition(7), weights, ["doc_id"]).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_empty_and_zero(spark):
    _, frame = docs(spark)
    weights = m.cyclic_weights(frame)
    assert m.mix(frame.limit(0), weights, ["doc_id"]).count() == 0
    zero = m.mix(frame.filter("source in ('empty', 'gone')"), weights, ["doc_id"]).collect()
    assert [r.taken for r in zero] == [0, 0]


def test_stage_drops_what_is_not_taken(spark):
    frame = spark.createDataFrame([(1, "a b c", "s", "clash"), (2, None, "s", "clash"), (3, "d " * 500, None, "clash")], "doc_id long, text string, source string, size string")
    out = m.stage(spark, frame, "").collect()
    assert {r.doc_id for r in out} <= {1, 3} and all(r.taken > 0 for r in out)
