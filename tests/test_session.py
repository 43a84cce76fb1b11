"""Scratch tables: folders that go away, tables that are released, buckets that spare a shuffle; seasons from the data."""

import glob
import os

from pyspark.sql import functions as F

from pitlake.operators import folds as G
from pitlake.session import co_partitioned, materialise, release, run_folder


def test_run_folder_removes_what_was_written_inside(spark):
    df = spark.range(10)
    with run_folder(spark) as outer:
        assert materialise(df, "a").count() == 10
        with run_folder(spark) as inner:
            assert inner.startswith(outer) and materialise(df, "b").count() == 10
        assert not os.path.exists(inner.removeprefix("file:")) and glob.glob(f"{outer.removeprefix('file:')}/a-*")
    assert not os.path.exists(outer.removeprefix("file:"))


def test_release_deletes_one_table(spark):
    kept, gone = materialise(spark.range(3), "kept"), materialise(spark.range(3), "gone")
    path = os.path.dirname(gone.inputFiles()[0].removeprefix("file://"))
    release(gone)
    release(gone)  # nothing more to delete
    assert not os.path.exists(path) and kept.count() == 3


def test_buckets_spare_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("id % 7 as a", "id % 11 as b", "id % 3 as c", "id as v")
    table = co_partitioned(rows, ["a", "b"], "facts")
    total = table.groupBy("a", "b", "c").agg(F.sum("v").alias("s"))
    assert "Exchange" not in total._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" not in total._jdf.queryExecution().executedPlan().toString()
    assert total.agg(F.sum("s")).first()[0] == sum(range(1000))


def test_seasons_come_from_the_data(spark):
    rows = [(s, g) for s in ("2001", "1999", "2000", None) for g in range(1, 13)]
    df = spark.createDataFrame(rows, "season string, gw long")
    split = {}
    for r in G.season_split(df, "season", "gw", val=3).collect():
        split.setdefault((r.season, r.role), []).append(r.gw)
    assert {k: sorted(v) for k, v in split.items()} == {
        ("1999", "train"): list(range(1, 13)), ("2000", "train"): list(range(1, 10)), ("2000", "val"): [10, 11, 12], ("2001", "holdout"): list(range(1, 13))}
    given = {(r.season, r.role) for r in G.season_split(df, "season", "gw", ["1999"], "2000", 3).collect()}
    assert given == {("1999", "train"), ("1999", "val"), ("2000", "holdout")}
    folds = {(r.fold, r.role, r.season) for r in G.temporal_folds(df, "season", "gw", min_train=1, val=3).collect()}
    assert folds == {(1, "train", "1999"), (1, "val", "1999"), (1, "test", "2000")}
