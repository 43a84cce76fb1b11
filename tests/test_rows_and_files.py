"""Hand cases: records over several lines, sinks written again, listings, availability on rows, vectors of absent periods."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pitlake.operators import features as X
from pitlake.sources import files as S


def test_records_over_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name,n\n1,"multi\nline",5\n2,"say ""hi"", you\n\n",6\n3,plain,7\n')
    (tmp_path / "b.csv").write_text('id,name\n4,5" pipe\n5,x\n')  # a stray quote: lines stay records
    (tmp_path / "c.csv").write_bytes('name,id\n"é\nè",6\n'.encode("latin-1"))
    (tmp_path / "d.csv").write_text('"id","na\nme","name"\n7,a,b\n')  # the header goes over two lines
    got = {r.id: (r.name, r.n) for r in S.read_csv_safe(spark, str(tmp_path), StructType.fromDDL("id long, name string, n int")).collect()}
    assert got[1] == ("multi\nline", 5) and got[2] == ('say "hi", you\n\n', 6) and got[3] == ("plain", 7)
    assert got[5] == ("x", None) and got[6] == ("é\nè", None) and got[7] == ("b", None)
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}


def test_rewriting_one_partition_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(s, i) for s in (1, 2, 3) for i in range(4)], "season long, v long")
    S.write_table(rows, path, ["season"])
    new = spark.createDataFrame([(2, 99)], "season long, v long")
    for _ in range(2):
        S.write_table(new, path, ["season"])
    got = sorted((r.season, r.v) for r in spark.read.schema("v long, season long").parquet(path).collect())
    assert got == sorted([(s, i) for s in (1, 3) for i in range(4)] + [(2, 99)])
    S.write_table(new, str(tmp_path / "u"))
    S.write_table(rows.limit(0), str(tmp_path / "u"))
    assert spark.read.schema("season long, v long").parquet(str(tmp_path / "u")).count() == 0


def test_manifest_lists_files_without_reading_them(spark, tmp_path):
    for source, season, text in (("x", 1, "abc"), ("x", 2, ""), ("y", 1, "é")):
        folder = tmp_path / f"source={source}" / f"season={season}"
        folder.mkdir(parents=True)
        (folder / "f.csv").write_text(text, encoding="utf-8")
    (tmp_path / "source=x" / "season=1" / "_SUCCESS").write_text("")
    got = {(r["keys"]["source"], r["keys"]["season"]): (r.n_bytes, r.ok) for r in S.file_manifest(spark, str(tmp_path)).collect()}
    assert got == {("x", "1"): (3, True), ("x", "2"): (0, False), ("y", "1"): (2, True)}


def test_availability_counts_rows_not_periods(spark):
    # entity 1 plays, then sits out both rows of period 2; entity 2 sits out one of them; entity 3 is absent in period 2
    rows = [(1, 1, 0, 90, 5), (1, 2, 1, 0, 5), (1, 2, 2, 0, 5), (1, 3, 3, 0, 0), (1, 4, 4, 0, 0),
            (2, 1, 0, 90, 5), (2, 2, 1, 0, 5), (2, 2, 2, 60, 100), (2, 3, 3, 90, 0),
            (3, 1, 0, 90, 5), (3, 3, 1, 90, 0)]
    df = spark.createDataFrame([(1, *r) for r in rows], "season long, e long, gw long, line long, minutes long, out long")
    got = {}
    for r in X.infer_availability(df, ["season", "e"], ["season"], "gw", "minutes", "out", "line").collect():
        got.setdefault((r.e, r.gw), {})[r.strategy] = r.cop
    assert (1, 1) not in got  # nothing is known before the first period
    assert got[1, 3] == {"always_100": 100, "consec_zero": 25, "last_gw": 25, "tfer_spike": 50, "combined": 25}
    assert got[1, 4]["consec_zero"] == 0  # three rows in a row, at most
    assert got[2, 3] == {"always_100": 100, "consec_zero": 100, "last_gw": 100, "tfer_spike": 100, "combined": 100}
    assert got[3, 3] == {"always_100": 100, "consec_zero": 100, "last_gw": 75, "tfer_spike": 100, "combined": 50}


def test_vector_of_absent_periods_falls_back_by_one(spark):
    df = spark.createDataFrame([(1, 7, 1, 50, 30.0, 4), (1, 7, 2, 60, 45.0, 8), (1, 7, 5, 70, 90.0, 2), (1, 8, 4, 1, 1.0, 1)], "season long, e long, gw long, value long, minutes double, pts long")
    who = spark.createDataFrame([(1, 7, "MID"), (1, 8, None)], "season long, e long, position string")
    periods = spark.createDataFrame([(1, g) for g in (1, 2, 3, 4, 5, 6)], "season long, gw long")
    slots = [X.Slot("label", "MID"), X.Slot("pre", "value", 10.0), X.Slot("post", "minutes", 90.0), X.Slot("past", "form")]
    out = X.point_in_time_vector(df.withColumn("position", F.lit("x")), who, periods, ["season"], "e", "gw", "position", slots, {"form": lambda w: F.avg("pts").over(w.rangeBetween(-5, -1))})
    got = {(r.e, r.gw): r.features for r in out.collect()}
    assert got[7, 1] == [1, 5, 0, 0] and got[7, 2] == [1, 6, pytest.approx(1 / 3), 4]
    assert got[7, 3] == [1, 6, 0.5, 6]  # absent: the fields of period 2
    assert got[7, 4] == [1, 0, 0, 6] and got[7, 5] == [1, 7, 0, 6] and got[7, 6] == [1, 7, 1, pytest.approx(14 / 3)]
    assert got[8, 1] == [0, 0, 0, 0] and got[8, 5] == [0, pytest.approx(0.1), pytest.approx(1 / 90), 1] and len(got) == 12


def test_records_go_over_the_ends_of_splits(spark, tmp_path):
    """Line breaks in quoted fields of files that are read in splits of a few bytes: no text is shuffled, all records come back."""
    want, text = {}, ["id,name,n"]
    for i in range(60):
        name = ["plain", "two\nlines", 'a "quoted"\n\nword, with a comma', "x" * 90 + "\n" + "y\n" * 40, "é\nè", "\n"][i * 7 % 6]
        want[i] = (name, i * 3)
        text.append(f'{i},"{name.replace(chr(34), chr(34) * 2)}",{i * 3}')
    (tmp_path / "a.csv").write_text("\n".join(text) + "\n", encoding="utf-8")
    (tmp_path / "stray.csv").write_text('id,name,n\n9000,"open,1\n9001,fine,2\n', encoding="utf-8")
    (tmp_path / "plain.csv").write_text("id,name,n\n8000,fine,2\n", encoding="utf-8")
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    old = [spark.conf.get(x) for x in names]
    try:
        for size in ("90", "1000000"):
            for x in names:
                spark.conf.set(x, size)
            rows = S.read_csv_safe(spark, str(tmp_path), StructType.fromDDL("id long, name string, n int")).collect()
            got = {r.id: (r.name, r.n) for r in rows}
            assert {k: got[k] for k in want} == want and got[8000] == ("fine", 2) and got[9001] == ("fine", 2)
            assert len(rows) == len(want) + 3
    finally:
        for x, value in zip(names, old):
            spark.conf.set(x, value)
