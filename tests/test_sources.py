import json

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from pitlake.functions import scalars as S
from pitlake.sources import files, nested, schema
from pitlake.streaming.ingest import ingest_files

PLAYERS = StructType().add("id", LongType()).add("name", StringType()).add("price", DoubleType())


def test_csv_encodings_and_bad_lines(spark, tmp_path):
    (tmp_path / "utf8.csv").write_bytes("id,name,price\n1,Núñez,5.5\n2,short\n3,too,long,line,here\n4,\"a, b\",x\n".encode())
    (tmp_path / "latin.csv").write_bytes("id,name,price\r\n5,Peña,4.0\r\n6,Plain,4.5\r\n".encode("latin-1"))
    got = {r.id: (r.name, r.price) for r in files.read_csv_safe(spark, str(tmp_path), PLAYERS).collect()}
    assert got == {1: ("Núñez", 5.5), 2: ("short", None), 4: ("a, b", None), 5: ("Peña", 4.0), 6: ("Plain", 4.5)}


def test_csv_by_header(spark, tmp_path):
    (tmp_path / "more.csv").write_text("id,team,name,price\n1,7,Ann,2.5\nid,team,name,price\n2,7,Bo,x,long\n")
    (tmp_path / "turned.csv").write_text("\ufeffprice,id,name\n3.5,3,\"Cy, D\"\n4.5,4\n\n", encoding="utf-8")
    (tmp_path / "less.csv").write_text("name,id\nEd,5\n")
    (tmp_path / "empty.csv").write_text("")
    got = [tuple(r) for r in files.read_csv_safe(spark, str(tmp_path), PLAYERS).collect()]
    assert sorted(got, key=str) == sorted([(1, "Ann", 2.5), (None, "name", None), (3, "Cy, D", 3.5), (4, None, 4.5), (5, "Ed", None)], key=str)


def test_optional_source(spark, tmp_path):
    df = files.read_optional(spark, str(tmp_path / "nothing.csv"), PLAYERS)
    assert df.schema == PLAYERS and df.count() == 0


def test_match_files(spark, tmp_path):
    (tmp_path / "1234.json").write_text(json.dumps([{"date": "2023-08-12 17:30:00", "xG": "0.5", "shots": "bad"}, {"date": "2023-08-19", "xG": "1.0"}]))
    (tmp_path / "77.json").write_text("[]")
    rows = files.read_match_json(spark, str(tmp_path), "date", ["xG", "shots"]).orderBy("date").collect()
    assert [(r.player_id, str(r.date), r.xG, r.shots) for r in rows] == [(1234, "2023-08-12 17:30:00", 0.5, 0.0), (1234, "2023-08-19 00:00:00", 1.0, 0.0)]


def test_league_file(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"id": "9", "player_name": "A", "time": "900", "xG": "3"}, {"id": "x", "player_name": "B", "time": "1", "xG": "1"}]))
    rows = files.read_league_json(spark, str(tmp_path / "l.json"), ["player_name"], ["time", "xG"]).collect()
    assert [tuple(r) for r in rows] == [(9, "A", 900.0, 3.0)]


def test_ranked_lists(spark):
    doc = {"TopLists": [{"StatList": [{"ParticipantName": "Ana", "StatValue": "2.5", "SubStatValue": "85%"}, {"ParticipantName": "Bo"}]}, {"StatList": []}]}
    df = spark.createDataFrame([(json.dumps(doc),), ("{}",)], "j string")
    rows = nested.flatten_stat_lists(df, "j").collect()
    assert [(r.player_name, r.stat_value, r.sub_stat_value) for r in rows] == [("Ana", "2.5", "85%"), ("Bo", "", "")]


def test_stream_takes_each_file_once(spark, tmp_path):
    src, out, state = (str(tmp_path / d) for d in ("src", "out", "state"))
    part = lambda a, b: spark.range(a, b).write.mode("append").json(src)
    schema_ = StructType().add("id", LongType())
    part(0, 5)
    ingest_files(spark, src, schema_, out, state)
    ingest_files(spark, src, schema_, out, state)
    part(5, 8)
    ingest_files(spark, src, schema_, out, state)
    assert sorted(r.id for r in spark.read.schema(schema_).parquet(out).collect()) == list(range(8))


def test_id_map_last_row_wins(spark):
    wide = spark.createDataFrame([(100, 0, 1, None), (200, 1, 1, 5)], "code long, ord long, `23-24` long, `24-25` long")
    got = {(r.season, r.element_id): r.code for r in schema.unpivot_id_map(wide, ["code"], ["23-24", "24-25"], "ord").collect()}
    assert got == {("23-24", 1): 200, ("24-25", 5): 200}


def test_scalars(spark):
    df = spark.createDataFrame([("True", "82%", "2023-08-12T15:00:00Z", "GKP", 1.25), ("0", "", "2024-08-01", "3", 1.75), (None, None, "x", "FWD", None)],
                               "b string, p string, t string, l string, h double")
    rows = df.select(S.coerce_boolean("b").alias("b"), S.parse_percent("p").alias("p"), S.parse_timestamp_utc("t").cast("string").alias("t"),
                     S.normalise_label("l").alias("l"), S.round_half("h").alias("h"), S.playing_prob(F.col("h") * 100).alias("q")).collect()
    assert [tuple(r) for r in rows] == [
        (True, 82.0, "2023-08-12 15:00:00", "GK", 1.0, 1.0), (False, None, "2024-08-01 00:00:00", "MID", 2.0, 1.0), (False, None, None, "FWD", None, None)]
    assert S.coerce_numeric(df, ["absent"]).columns == df.columns


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(1, 10, 20, 2.0, 3.5, 4.0), (2, 10, None, 2.0, 3.0, 4.0)], "m long, h long, a long, ho double, d double, ao double")
    rows = S.implied_probabilities(df, ["m"], "h", "a", ("ho", "d", "ao")).collect()
    assert {r.team for r in rows} == {10, 20}
    assert all(abs(r.win_prob + r.draw_prob + r.loss_prob - 1) < 1e-12 for r in rows)
    home, away = sorted(rows, key=lambda r: r.team)
    assert home.win_prob == away.loss_prob


def test_find_col():
    cols = ["Unnamed: 1_level_0_Player", "Standard_SoT", "Standard_SoT/90"]
    assert files.find_col(cols, "player") == cols[0]
    assert files.find_col(cols, "sot", "/90") == cols[2]
    assert files.find_col(cols, "blocks") is None


def test_csv_records_are_put_together_once(spark, tmp_path):
    from pyspark.sql.types import StructType

    from pitlake.sources.files import read_csv_safe

    (tmp_path / "a.csv").write_text('id,note\n1,"one\ntwo"\n2,three\n')
    out = read_csv_safe(spark, str(tmp_path), StructType.fromDDL("id int, note string"))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(1, "one\ntwo"), (2, "three")]
