"""Clustering against a plain loop over all centroids, and cases that it must stand."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlake.llm.clustering import Centroids, centroid_clustering, cluster, cluster_table, digest, first_centroids, shallot, usable, whole_components


def nearest(v, centroids):
    return min(range(len(centroids)), key=lambda c: (sum((x - y) ** 2 for x, y in zip(v, centroids[c])), c))


def plain(vectors, start, rounds):
    at = [list(map(int, c)) for c in start]
    for _ in range(rounds):
        own = [nearest(v, at) for v in vectors]
        for c in range(len(at)):
            mine = [v for v, o in zip(vectors, own) if o == c]
            if mine:
                at[c] = [sum(x) // len(mine) for x in zip(*mine)]
    own = [nearest(v, at) for v in vectors]
    return own, [sum((x - y) ** 2 for x, y in zip(v, at[o])) for v, o in zip(vectors, own)], at


@pytest.mark.parametrize("k, spread, seed", [(1, 5, 0), (2, 1, 1), (7, 3, 2), (16, 40, 3), (16, 1, 4)])
def test_rounds_match_a_plain_loop(spark, k, spread, seed):
    rng = random.Random(seed)
    vectors = [[rng.randint(-spread, spread) for _ in range(4)] for _ in range(300)]  # few values: many ties and equal rows
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, vector array<long>").repartition(5)
    start = first_centroids(df, k, "vec_id")
    order = sorted(range(300), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:k]
    assert start.tolist() == [vectors[i] for i in order]
    got, at = cluster(df, start, 3)
    own, far, want = plain(vectors, start.tolist(), 3)
    assert at.tolist() == want
    assert {r.vec_id: (r.cluster, r.distance) for r in got.collect()} == {i: (o, d) for i, (o, d) in enumerate(zip(own, far))}
    per = {r.cluster: (r.cluster_inertia, r.inertia, r.centroid_sha256) for r in cluster_table(spark, got, at).collect()}
    assert per == {c: (sum(d for o, d in zip(own, far) if o == c), sum(far), digest(want[c])) for c in set(own)}


def test_search_keeps_the_order_of_ties_and_valid_bounds():
    rng = np.random.default_rng(7)
    vectors = rng.integers(-3, 4, (500, 3))
    at = rng.integers(-3, 4, (12, 3))
    at[5] = at[2]  # equal centroids: the smaller number takes all
    state = (np.zeros(500, np.int64), np.ones(500, np.int64), np.full(500, np.inf), np.zeros(500))
    moved = np.zeros(12)
    for _ in range(4):
        first, second, upper, lower = shallot(Centroids(at, moved), vectors, *state)
        d = np.sqrt(((vectors[:, None] - at[None]) ** 2).sum(2))
        assert first.tolist() == [nearest(v, at.tolist()) for v in vectors.tolist()]
        assert (upper >= d[np.arange(500), first] * (1 - 1e-12)).all()
        d[np.arange(500), first] = np.inf
        assert (lower <= d.min(1) * (1 + 1e-12)).all()
        state = (first, second, upper, lower)
        new = at + rng.integers(-1, 2, at.shape)
        moved, at = np.sqrt(((new - at) ** 2).sum(1).astype(float)), new


def test_search_looks_at_few_centroids(monkeypatch):
    rng = np.random.default_rng(1)
    at = rng.integers(-1000, 1000, (64, 8))
    vectors = at[rng.integers(0, 64, 2000)] + rng.integers(-5, 6, (2000, 8))
    looked = []
    plain_squared = Centroids.squared
    monkeypatch.setattr(Centroids, "squared", lambda self, v, w: looked.append(len(v)) or plain_squared(self, v, w))
    table = Centroids(at, np.zeros(64))
    state = shallot(table, vectors, np.zeros(2000, np.int64), np.ones(2000, np.int64), np.full(2000, np.inf), np.zeros(2000))
    looked.clear()
    again = shallot(table, vectors, *state)
    assert (again[0] == state[0]).all() and sum(looked) == 0  # bounds settle everything
    shallot(table, vectors, state[0], state[1], np.full(2000, np.inf), np.zeros(2000))
    assert sum(looked) < 2000 * 8  # the walk ends early from the remembered centroid


def test_unusable_vectors_empty_tables_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [-0.01, 0.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").where(usable(F.col("embedding"), 2))
    kept = df.select("vec_id", whole_components(F.col("embedding")).alias("vector"), F.lit("x").alias("cluster"), F.lit(1).alias("_row"), F.lit(2).alias("upper"))
    assert sorted((r.vec_id or 0, r.vector) for r in kept.collect()) == [(0, [64, 128]), (1, [64, 128]), (1, [64, 128]), (8, [-1, 0])]
    start = first_centroids(kept, 16, "vec_id")
    assert len(start) == 4  # fewer vectors than centroids
    got, _ = cluster(kept, start, 3)
    assert got.columns == ["vec_id", "_row", "vector", "cluster", "distance"]
    assert [r.distance for r in got.collect()] == [0, 0, 0, 0]
    none = kept.limit(0)
    empty, at = cluster(none, first_centroids(none, 16, "vec_id"), 3)
    assert empty.count() == 0 and len(at) == 0
    large = spark.createDataFrame([(1, [1 << 40])], "vec_id long, vector array<long>")
    with pytest.raises(Exception, match="too large"):
        cluster(large, np.array([[0]]), 1)


def test_query_on_a_table_with_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)], 0) for i in range(120)] + [(200, None, 0), (201, [0.0] * 63, 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in centroid_clustering(spark, str(tmp_path)).collect()}
    vectors = [[int(np.floor(64 * float(np.float32(x)))) for x in v] for _, v, _ in rows[:120]]
    order = sorted(range(120), key=lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest())[:16]
    own, far, at = plain(vectors, [vectors[i] for i in order], 3)
    assert {i: (r.cluster, r.distance, r.centroid_sha256) for i, r in got.items()} == {i: (o, d, digest(at[o])) for i, (o, d) in enumerate(zip(own, far))}
