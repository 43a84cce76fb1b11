"""Centroid clustering: exact k-means rounds in integers by Shallot search, one pass over the vectors a round."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise, release
from .common import query, table

#: Centroids go to every task with the distances between them, so their number is bounded.
MAX_CENTROIDS = 4096
#: Largest size of a component: squared distances of up to 1024 components then fit in 64 bits.
MAX_COMPONENT = 1 << 25
#: Relative room for the rounding of bounds, which are floating-point; decisions between survivors are made in integers.
SLACK = 1e-9
#: Vectors that are compared at once in a task.
BLOCK = 4096


def whole_components(vector: Column, scale: int = 64) -> Column:
    """The integers floor(scale * x) of the components, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(vector: Column, size: int) -> Column:
    """True for vectors with exactly ``size`` components, none of them NULL, NaN or infinite; never NULL."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: finite(x.cast("double"))), F.lit(False))


def first_centroids(vectors: DataFrame, k: int, key: str, vector: str = "vector", seed: int = 1) -> np.ndarray:
    """The ``k`` vectors whose ``seed:key`` has the least SHA-256 (hexadecimal), in that order; equal ones by their components.

    Only ``k`` rows of each partition travel.
    """
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    chosen = vectors.select(mark.alias("_mark"), vector).orderBy("_mark", vector).limit(k).collect()
    return np.array([r[vector] for r in chosen], np.int64)


@dataclass
class Centroids:
    """Centroids in integers, with what a search needs to know of them.

    ``near[c]`` lists all centroids by distance from c (itself first), ``far[c]`` those distances,
    ``moved`` how far each went since the bounds were taken.
    """

    at: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        k = len(self.at)
        apart = np.zeros((k, k))
        for c in range(k):
            apart[c] = np.sqrt(((self.at - self.at[c]) ** 2).sum(1).astype(float))
            apart[c, c] = -1.0  # itself comes first, also before equal centroids
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.far = np.maximum(np.take_along_axis(apart, self.near, 1), 0.0)
        self.half = self.far[:, 1] / 2 if k > 1 else np.full(k, np.inf)
        order = np.argsort(-self.moved, kind="stable")
        self.most_moved = np.full(k, self.moved[order[0]])
        self.most_moved[order[0]] = self.moved[order[1]] if k > 1 else 0.0

    def squared(self, vectors: np.ndarray, which: np.ndarray) -> np.ndarray:
        return ((vectors - self.at[which]) ** 2).sum(1)


def shallot(centroids: Centroids, vectors: np.ndarray, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """The nearest and second-nearest centroid of each vector, and the bounds on the distances to them.

    ``upper`` bounds the distance to ``first`` from above, ``lower`` that to all others from below.
    Bounds are widened by how far centroids moved; a vector whose bounds, or half the distance from its
    centroid to the next one, still tell it apart is done. The others start from the closer of
    the two remembered centroids and walk along the neighbours of that pivot by distance. A neighbour
    beyond the distance to the pivot plus the distance to the second-nearest found so far can't come
    before either, so the ball shrinks as nearer ones turn up. Distances are compared as integers;
    of equally distant centroids the smaller number is nearer.
    """
    first, second = first.copy(), second.copy()
    upper = (upper + centroids.moved[first]) * (1 + SLACK)
    lower = np.maximum(lower - centroids.most_moved[first], 0.0) * (1 - SLACK)
    k = len(centroids.at)
    if k == 1:
        return first, second, upper, lower
    clear = lambda rows: upper[rows] * (1 + SLACK) < np.maximum(lower[rows], centroids.half[first[rows]] * (1 - SLACK))
    open_ = np.flatnonzero(~clear(slice(None)))
    upper[open_] = np.sqrt(centroids.squared(vectors[open_], first[open_]).astype(float)) * (1 + SLACK)
    open_ = open_[~clear(open_)]
    for begin in range(0, len(open_), BLOCK):
        rows = open_[begin : begin + BLOCK]
        own = vectors[rows]
        a, b = first[rows], second[rows]
        da, db = centroids.squared(own, a), centroids.squared(own, b)
        swap = (db < da) | ((db == da) & (b < a))
        a, b, da, db = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)
        pivot, reach = a.copy(), np.sqrt(da.astype(float))
        walking = np.arange(len(rows))
        for step in range(1, k):
            ball = (reach[walking] + np.sqrt(db[walking].astype(float))) * (1 + SLACK)
            walking = walking[centroids.far[pivot[walking], step] <= ball]
            if not len(walking):
                break
            c = centroids.near[pivot[walking], step]
            other = (c != a[walking]) & (c != b[walking])
            at, c = walking[other], c[other]
            d = centroids.squared(own[at], c)
            nearest = (d < da[at]) | ((d == da[at]) & (c < a[at]))
            next_ = ~nearest & ((d < db[at]) | ((d == db[at]) & (c < b[at])))
            up, side = at[nearest], at[next_]
            b[up], db[up] = a[up], da[up]
            a[up], da[up] = c[nearest], d[nearest]
            b[side], db[side] = c[next_], d[next_]
        first[rows], second[rows] = a, b
        upper[rows] = np.sqrt(da.astype(float)) * (1 + SLACK)
        lower[rows] = np.sqrt(db.astype(float)) * (1 - SLACK)
    return first, second, upper, lower


STATE = "was int, cluster int, second int, upper double, lower double, distance long"


def _assign(state: DataFrame, centroids: Centroids, with_distance: bool) -> DataFrame:
    """One pass: every row's nearest centroid under ``centroids``; ``was`` is its cluster before."""
    schema = state.schema
    names = state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = centroids.at.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(names)}
            vectors = np.asarray(col["vector"].flatten()).astype(np.int64).reshape(-1, size)
            numpy = lambda n: col[n].to_numpy(zero_copy_only=False)
            was = numpy("cluster").astype(np.int64)
            first, second, upper, lower = shallot(centroids, vectors, was, numpy("second").astype(np.int64), numpy("upper"), numpy("lower"))
            distance = centroids.squared(vectors, first) if with_distance else np.zeros(len(first), np.int64)
            new = {"was": was, "cluster": first, "second": second, "upper": upper, "lower": lower, "distance": distance}
            types = {"was": pa.int32(), "cluster": pa.int32(), "second": pa.int32(), "upper": pa.float64(), "lower": pa.float64(), "distance": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(new[n], types[n]) if n in new else col[n] for n in names], names=names)

    return state.mapInArrow(run, schema)


def _sums(state: DataFrame, size: int, changed: bool) -> list:
    """Per cluster the number of its vectors and their componentwise sums; ``changed``: only of what came, less what went."""
    if changed:
        moves = state.where("cluster <> was").select("vector", F.inline(F.array(
            F.struct(F.col("cluster").alias("c"), F.lit(1).cast("long").alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).cast("long").alias("sign")))))
    else:
        moves = state.select("vector", F.col("cluster").alias("c"), F.lit(1).cast("long").alias("sign"))
    wide = "decimal(38,0)"
    parts = [F.sum(F.col("vector")[i] * F.col("sign")).cast(wide).alias(f"s{i}") for i in range(size)]
    # sums of a part fit in 64 bits; parts are added as decimals
    part = moves.withColumn("_p", F.spark_partition_id()).groupBy("c", "_p").agg(F.sum("sign").alias("n"), *parts)
    return part.groupBy("c").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(size)]).collect()


def cluster(vectors: DataFrame, start: np.ndarray, rounds: int, vector: str = "vector") -> tuple[DataFrame, np.ndarray]:
    """``vectors`` with ``cluster`` and exact squared ``distance`` after ``rounds`` rounds, and the final centroids.

    ``vector`` holds arrays of as many integers as a row of ``start``, the first centroids. A round
    assigns every vector to its nearest centroid (ties: the smaller number) and replaces each centroid
    that has vectors by their componentwise floor(sum / count); then vectors are assigned once
    more. What a vector remembers between rounds (cluster, second-nearest, two bounds) is
    written with it; sums change only by the vectors that moved. The driver holds the centroids alone.

    Equal vectors are each counted. Other columns stay, except that ``cluster``, ``distance``,
    ``was``, ``second``, ``upper`` and ``lower`` are replaced. No start, or an empty table: no rows.
    Components beyond ``MAX_COMPONENT`` raise an error, as their distances might not fit in a long.
    """
    spark = vectors.sparkSession
    own = ["was", "cluster", "second", "upper", "lower", "distance"]
    if len(start) > MAX_CENTROIDS:
        raise ValueError(f"at most {MAX_CENTROIDS} centroids")
    rest = [c for c in vectors.columns if c not in own and c != vector]
    none = [F.lit(0).alias("was"), F.lit(0).alias("cluster"), F.lit(min(1, len(start) - 1)).alias("second"),
            F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("distance")]
    kept = F.struct(*rest).alias("_row") if rest else F.struct(F.lit(0).alias("_none")).alias("_row")
    state = vectors.select(kept, F.col(vector).alias("vector"), *none)
    if not len(start):
        empty = state.limit(0)
        return empty.select(*[F.col("_row")[c].alias(c) for c in rest], F.col("vector").alias(vector), "cluster", "distance"), start
    too_large = F.exists("vector", lambda x: F.abs(x) > MAX_COMPONENT)
    state = state.withColumn("vector", F.when(too_large, F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(F.col("vector")))
    at, moved = np.array(start, np.int64), np.zeros(len(start))
    sums = [[0] * at.shape[1] for _ in at]
    counts = [0] * len(at)
    before = None
    for turn in range(rounds + 1):
        state = materialise(_assign(state, Centroids(at, moved), turn == rounds), "clusters")
        if before is not None:
            release(before)
        before = state
        if turn == rounds:
            break
        for r in _sums(state, at.shape[1], turn > 0):
            counts[r.c] += r.n
            sums[r.c] = [s + int(r[f"s{i}"]) for i, s in enumerate(sums[r.c])]
        new = np.array([[s // n for s in sums[c]] if (n := counts[c]) else at[c] for c in range(len(at))], np.int64)
        moved = np.sqrt(((new - at) ** 2).sum(1).astype(float)) * (1 + SLACK)
        at = new
    return state.select(*[F.col("_row")[c].alias(c) for c in rest], F.col("vector").alias(vector), "cluster", "distance"), at


def digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def cluster_table(spark: SparkSession, labelled: DataFrame, centroids: np.ndarray) -> DataFrame:
    """One row a cluster that has vectors: ``cluster``, ``cluster_inertia``, ``inertia`` (of all) and ``centroid_sha256``."""
    per = {r.cluster: r.s for r in labelled.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, s, sum(per.values()), digest(centroids[c])) for c, s in per.items()]
    return spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")


@query("op12_centroid_clustering")
def centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings`` vectors of 64 finite components in 16 clusters after 3 rounds; other vectors have no row."""
    rows = table(spark, sf_dir, "embeddings").where(usable(F.col("embedding"), 64)).select("vec_id", whole_components(F.col("embedding")).alias("vector"))
    start = first_centroids(rows, 16, "vec_id")
    labelled, centroids = cluster(rows, start, 3)
    # one row a centroid, so its size is bounded by their number
    return labelled.select("vec_id", "cluster", "distance").join(F.broadcast(cluster_table(spark, labelled, centroids)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
