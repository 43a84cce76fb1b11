"""Checked queries: sources, sinks and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.stats import r6
from ..operators import joins as J
from ..session import materialise, scratch_dir
from ..sources import files as S
from ..sources import logs as L
from ..sources import nested as N
from ..sources import schema as C
from .binding import panel_agg, table
from .registry import query

@query("a01_csv_lines", """select l_orderkey, l_linenumber::bigint as l_linenumber, l_partkey, case when l_linenumber = 3 then null else round(l_quantity)::bigint end as qty,
 case when l_linenumber = 3 then null else l_shipdate end as shipped from lineitem where l_linenumber <> 5""")
def a01(spark, sf):
    raw = table(spark, sf, "lineitem").selectExpr("""case l_linenumber when 3 then concat_ws(',', l_orderkey, l_linenumber, l_partkey)
      when 5 then concat_ws(',', l_orderkey, l_linenumber, l_partkey, cast(l_quantity as int), l_shipdate, 'x', 'y')
      else concat_ws(',', l_orderkey, l_linenumber, l_partkey, cast(l_quantity as int), l_shipdate) end as line""")
    schema = StructType.fromDDL("l_orderkey bigint, l_linenumber bigint, l_partkey bigint, qty bigint, shipped timestamp")
    return S.parse_csv_lines(raw, "line", schema)


@query("a01_csv_line_breaks", """select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then 'one' || chr(10) || '"two", three' || chr(10) when 1 then l_returnflag || ', x' else l_linestatus end as note,
 l_quantity from lineitem""")
def a01_breaks(spark, sf):
    """Line items with line breaks, quotes and commas inside quoted fields, in files of many splits, and back."""
    t = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity",
        """case l_linenumber % 3 when 0 then 'one\\n""two"", three\\n' when 1 then concat(l_returnflag, ', x') else l_linestatus end as note""")
    path = scratch_dir(spark, "csv-breaks")
    lines = t.select(F.concat_ws(",", "l_orderkey", F.concat(F.lit('"'), "note", F.lit('"')), "l_linenumber", "l_quantity").alias("value"))
    lines.mapInArrow(_with_header("l_orderkey,note,l_linenumber,l_quantity"), "value string").write.text(path)
    return S.read_csv_safe(spark, path, StructType.fromDDL("l_orderkey bigint, l_linenumber int, note string, l_quantity double"))


@query("a01_csv_files", """select l_orderkey, l_linenumber, l_partkey, case when l_linenumber = 4 then null else l_suppkey end as l_suppkey, l_returnflag || 'é' as flag,
 case when l_linenumber = 3 then null else l_quantity end as l_quantity from lineitem where l_linenumber <> 5""")
def a01_files(spark, sf):
    """Line items written as files of four layouts, then read by name: extra and missing columns, Latin-1, short and long lines."""
    t = table(spark, sf, "lineitem").withColumn("flag", F.concat("l_returnflag", F.lit("é")))
    layouts = [
        ("l_linenumber <= 2", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flag", "l_quantity"], "UTF-8", []),
        ("l_linenumber = 3", ["l_quantity", "flag", "l_suppkey", "l_partkey", "l_linenumber", "l_orderkey"], "ISO-8859-1", []),
        ("l_linenumber = 4", ["flag", "l_tax", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey"], "UTF-8", []),
        ("l_linenumber = 5", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flag", "l_quantity"], "UTF-8", ["l_tax"]),
        ("l_linenumber > 5", ["l_suppkey", "l_comment", "l_partkey", "l_orderkey", "l_quantity", "l_linenumber", "flag"], "UTF-8", []),
    ]
    t = t.withColumn("l_comment", F.concat(F.lit("a, "), "l_linestatus"))
    paths = []
    for i, (rows, columns, encoding, more) in enumerate(layouts):
        own = t.where(rows).withColumn("l_quantity", F.when(F.col("l_linenumber") != 3, F.col("l_quantity")))
        paths.append(scratch_dir(spark, f"csv-{i}"))
        values = [F.concat(F.lit('"'), F.col(c), F.lit('"')) if c == "l_comment" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*columns, *more]]
        body = own.select(F.concat_ws(",", *values).alias("value"))
        # every part file begins with its header
        lines = body.mapInArrow(_with_header(",".join(columns)), "value string")
        lines.write.option("encoding", encoding).option("lineSep", "\n").text(paths[-1]) if encoding == "UTF-8" else lines.select(
            F.encode("value", "ISO-8859-1").cast("string").alias("value")).write.text(paths[-1])
    schema = StructType.fromDDL("l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, flag string, l_quantity double")
    return S.read_csv_safe(spark, paths, schema)


def _with_header(header):
    import pyarrow as pa

    def run(batches):
        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([header], batch.schema.field(0).type)], schema=batch.schema)
                first = False
            yield batch

    return run


@query("a02_read_optional", "select s_suppkey, s_name, s_acctbal from supplier")
def a02(spark, sf):
    schema = table(spark, sf, "supplier").schema
    there = S.read_optional(spark, f"{sf}/supplier.parquet", schema, "parquet")
    absent = S.read_optional(spark, f"{sf}/no_such_table.parquet", schema, "parquet")
    return there.unionByName(absent).select("s_suppkey", "s_name", "s_acctbal")


@query("a03_normalise_schema", """with @PA select season, element, gw, total_points::double as total_points, case when season < 1998 then 0.0::double else threat end as expected_goals,
 case when season < 1998 then null else value end as value from pa""")
def a03(spark, sf):
    pa = panel_agg(spark, sf)
    spec = {"season": "bigint", "element": "bigint", "gw": "bigint", "total_points": "double", "expected_goals": "double", "value": "bigint"}
    old = pa.where("season < 1998").select("season", "element", "gw", F.col("total_points").cast("string"))
    new = pa.where("season >= 1998").select("season", "element", "gw", "total_points", F.col("threat").alias("expected_goals"), F.col("value").cast("string"))
    parts = [C.normalise_schema(df, spec, ["expected_goals"]) for df in (old, new)]
    return parts[0].unionByName(parts[1])


@query("a04_missing_columns", """select 'o_orderkey' as column_name, true as is_present, count(o_orderkey) as n_values from orders union all
 select 'o_totalprice', true, count(o_totalprice) from orders union all select 'expected_goals', false, 0 from region where r_regionkey = 0""")
def a04(spark, sf):
    return C.missing_columns(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice", "expected_goals"])


def match_payloads(spark, sf):
    """Event lists as JSON text, at most fifty events a piece."""
    e = table(spark, sf, "events").select("user_id", F.expr("event_id div 50").alias("piece"), F.struct(
        F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("date"),
        F.col("value").cast("string").alias("xG"), F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("event_id").cast("string")).alias("shots")).alias("m"))
    return e.groupBy("user_id", "piece").agg(F.to_json(F.collect_list("m")).alias("payload"))


@query("a05_match_json", """select user_id, case when event_id % 2 = 0 then date_trunc('day', ts)::timestamp else date_trunc('second', ts)::timestamp end as date, value as "xG",
 case when event_type = 'error' then 0.0::double else event_id::double end as shots from events""")
def a05(spark, sf):
    return S.parse_match_json(match_payloads(spark, sf), ["user_id"], "payload", "date", ["xG", "shots"])


@query("a06_league_json", "select p_partkey as id, p_name as player_name, case when p_size % 9 = 0 then null else p_size::double end as time, case when p_size % 9 = 0 then null when p_size % 7 = 0 then 0 else p_retailprice end as \"xG\" from part where p_size <> 13")
def a06(spark, sf):
    p = table(spark, sf, "part").select(F.expr("p_partkey div 40").alias("piece"), F.struct(
        F.expr("case when p_size = 13 then 'unknown' else cast(p_partkey as string) end").alias("id"), F.col("p_name").alias("player_name"), F.col("p_size").cast("string").alias("time"),
        F.expr("case when p_size % 9 = 0 then '' when p_size % 7 = 0 then null else cast(p_retailprice as string) end").alias("xG")).alias("m"))
    doc = p.groupBy("piece").agg(F.to_json(F.collect_list("m")).alias("payload"))
    return S.parse_league_json(doc, "payload", ["player_name"], ["time", "xG"])


@query("a07_explode_odds", """select year(o_orderdate)::bigint as season, month(o_orderdate)::int as gw, o_orderkey::varchar as event_id, 'C' || o_custkey as home_team,
 case when o_custkey % 5 = 0 then null else 'A' || (o_custkey + 1) end as away_team, 1.5 + (o_custkey % 8) * 0.25::double as home_odds, 3.0::double as draw_odds, 2.0::double as away_odds from orders""")
def a07(spark, sf):
    o = table(spark, sf, "orders").selectExpr(
        "cast(year(o_orderdate) as bigint) as season", "cast(month(o_orderdate) as string) as gw", "o_orderkey div 8 as piece",
        """named_struct('event_id', cast(o_orderkey as string), 'home_team', concat('C', o_custkey), 'away_team', case when o_custkey % 5 = 0 then null else concat('A', o_custkey + 1) end,
          'home_odds', 1.5D + (o_custkey % 8) * 0.25D, 'draw_odds', 3.0D, 'away_odds', 2.0D) as m""")
    doc = o.groupBy("season", "gw", "piece").agg(F.collect_list("m").alias("ms")).select("season", F.to_json(F.create_map("gw", "ms")).alias("payload"))
    return N.explode_odds(doc, "payload", ["season"]).select("season", "gw", "event_id", "home_team", "away_team", "home_odds", "draw_odds", "away_odds")


@query("a08_flatten_events", """select o_orderkey::varchar as event_id, 'C' || o_custkey as home_team, 'A' || o_custkey as away_team, 2.0::double + (o_custkey % 4) as home_odds, 3.5::double as draw_odds,
 1.25::double as away_odds, strftime(o_orderdate, '%Y-%m-%d') as last_update from orders where o_custkey % 3 <> 0 and o_custkey % 7 <> 0""")
def a08(spark, sf):
    o = table(spark, sf, "orders").selectExpr("""to_json(named_struct('id', cast(o_orderkey as string), 'home_team', concat('C', o_custkey), 'away_team', concat('A', o_custkey), 'bookmakers', array(
      named_struct('key', 'soft', 'last_update', '', 'markets', array(named_struct('key', 'h2h', 'outcomes', array(named_struct('name', 'Draw', 'price', 9.0D))))),
      named_struct('key', case when o_custkey % 3 = 0 then 'other' else 'sharp' end, 'last_update', date_format(o_orderdate, 'yyyy-MM-dd'), 'markets', array(
        named_struct('key', 'totals', 'outcomes', array(named_struct('name', 'Over', 'price', 1.9D))),
        named_struct('key', 'h2h', 'outcomes', array(named_struct('name', concat('A', o_custkey), 'price', 1.25D), named_struct('name', concat('C', o_custkey), 'price', 2.0D + (o_custkey % 4)),
          named_struct('name', case when o_custkey % 7 = 0 then 'Tie' else 'Draw' end, 'price', 3.5D)))))))) as payload""")
    out = N.flatten_events(o, "payload", "sharp", "h2h")
    return out.select("event_id", "home_team", "away_team", "home_odds", "draw_odds", "away_odds", "last_update")


@query("a09_flatten_stat_lists", """select p_brand as stat, p_name as player_name, p_size::varchar as stat_value, case when p_size % 2 = 0 then '' else p_size || '%' end as sub_stat_value, '' as minutes_played, '' as matches_played from part""")
def a09(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_brand as stat", "p_partkey div 30 as piece", """named_struct('ParticipantName', p_name, 'StatValue', cast(p_size as string),
      'SubStatValue', case when p_size % 2 = 0 then null else concat(p_size, '%') end) as s""")
    doc = p.groupBy("stat", "piece").agg(F.to_json(F.struct(F.array(F.struct(F.collect_list("s").alias("StatList"))).alias("TopLists"))).alias("payload"))
    return N.flatten_stat_lists(doc, "payload", ["stat"])


@query("a10_resolved_columns", "select p_partkey, p_retailprice as per90, p_size as total, cast(null as double) as blocks from part")
def a10(spark, sf):
    p = table(spark, sf, "part").withColumnsRenamed({"p_retailprice": "Standard_SoT/90", "p_size": "Standard_SoT"})
    return S.select_resolved(p, ["p_partkey"], {"per90": ["sot", "/90"], "total": ["standard", "SOT"], "blocks": ["blocks", "blocks"]}).select(
        "p_partkey", "per90", F.col("total"), "blocks")


_WIDE_SQL = """wide as (select s_suppkey + 100000 as code, s_suppkey as ord, s_name as web_name, case when s_suppkey % 4 = 0 then null else s_suppkey end as "95-96",
   s_suppkey // 2 as "96-97" from supplier),
 lg as (select * from (select code, ord, web_name, '95-96' as season, "95-96" as element_id from wide union all select code, ord, web_name, '96-97', "96-97" from wide) where element_id is not null),
 mp as (select season, element_id, arg_max(code, ord) as code, arg_max(web_name, ord) as web_name from lg group by all)"""


def id_long(spark, sf):
    wide = table(spark, sf, "supplier").selectExpr(
        "s_suppkey + 100000 as code", "s_suppkey as ord", "s_name as web_name", "case when s_suppkey % 4 = 0 then null else s_suppkey end as `95-96`", "s_suppkey div 2 as `96-97`")
    return C.unpivot_id_map(wide, ["code", "web_name"], ["95-96", "96-97"], "ord")


@query("a11_unpivot_id_map", f"with {_WIDE_SQL} select code, web_name, season, element_id from mp")
def a11(spark, sf):
    return id_long(spark, sf)


@query("a12_lookup_ids", f"""with {_WIDE_SQL}, pr as (select distinct case when year(o_orderdate) % 2 = 0 then '96-97' else '95-96' end as season, o_custkey as element_id from orders)
 select pr.season, pr.element_id, code from pr left join mp on mp.season = pr.season and mp.element_id = pr.element_id""")
def a12(spark, sf):
    probes = table(spark, sf, "orders").selectExpr("case when year(o_orderdate) % 2 = 0 then '96-97' else '95-96' end as season", "o_custkey as element_id").distinct()
    return C.lookup_ids(id_long(spark, sf), probes, ["season", "element_id"], "code")


@query("a12_codes_of_season", f"with {_WIDE_SQL} select distinct code from mp where season = '96-97'")
def a12b(spark, sf):
    return C.codes_of_season(id_long(spark, sf), "96-97")


@query("a13_ingest_new", "select e.event_id, e.user_id from events e where not exists (select 1 from documents d where d.doc_id = e.event_id)")
def a13(spark, sf):
    return S.ingest_new(table(spark, sf, "events").select("event_id", "user_id"), table(spark, sf, "documents").withColumnRenamed("doc_id", "event_id"), ["event_id"])


@query("a13_stream_ingest", "select c_custkey, c_name, c_nationkey from customer")
def a13s(spark, sf):
    from ..streaming.ingest import ingest_files

    base = scratch_dir(spark, "ingest")
    t = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    t.write.json(f"{base}/src")
    for _ in range(2):  # the second call finds nothing new
        ingest_files(spark, f"{base}/src", t.schema, f"{base}/out", f"{base}/state")
    return spark.read.schema(t.schema).parquet(f"{base}/out")


@query("a14_coverage_report", """select o_orderpriority as source, year(o_orderdate)::bigint as season, count(*) filter (where o_orderstatus = 'F') as n_ok, count(*) as n_total,
 case when count(*) filter (where o_orderstatus = 'F') = count(*) then 'OK' when count(*) filter (where o_orderstatus = 'F') > 0 then 'PARTIAL' else 'FAILED' end as status from orders group by all""")
def a14(spark, sf):
    m = table(spark, sf, "orders").selectExpr("o_orderpriority as source", "cast(year(o_orderdate) as bigint) as season", "o_orderstatus = 'F' as ok")
    return S.coverage_report(m, "source", "season", "ok")


@query("a14_file_manifest", """with s as (select distinct event_type as source from events), d as (select distinct day(ts)::bigint as season from events),
 f as (select event_type as source, day(ts)::bigint as season, count(*) filter (where value > 60) as n from events group by all)
 select s.source, d.season, coalesce(n > 0, false) as found from s cross join d left join f on f.source = s.source and f.season = d.season""")
def a14f(spark, sf):
    """Events written as one folder per type and day, some of them with an empty file; the listing of the files says what is there."""
    path = scratch_dir(spark, "collected")
    ev = table(spark, sf, "events").selectExpr("event_type as source", "cast(day(ts) as bigint) as season", "case when value > 60 then concat(event_id, ',', value) end as line")
    ev.where("line is not null").repartition("source", "season").write.partitionBy("source", "season").text(path)
    spark.createDataFrame([], "line string").write.text(f"{path}/source=view/season=0")  # an empty file
    found = S.file_manifest(spark, path).groupBy(F.col("keys")["source"].alias("source"), F.col("keys")["season"].cast("bigint").alias("season")).agg(F.bool_or("ok").alias("found"))
    expected = J.scaffold(ev.select("source", F.lit(1).alias("one")), ev.select("season", F.lit(1).alias("one")), ["one"]).drop("one")
    return expected.join(found, ["source", "season"], "left").fillna(False, ["found"])


@query("a14_coverage_matrix", """select year(ts)::bigint * 100 + day(ts) as season, bool_or(event_type = 'click' and value > 60) as click, bool_or(event_type = 'error' and value > 60) as error,
 bool_or(event_type = 'view' and value > 60) as view from events group by 1""")
def a14m(spark, sf):
    m = table(spark, sf, "events").selectExpr("event_type as source", "cast(year(ts) as bigint) * 100 + day(ts) as season", "value > 60 as ok")
    return S.coverage_matrix(m, "source", "season", "ok", ["click", "error", "view"])


@query("a15_write_parquet", "with @PA select season, element, gw, total_points, value from pa")
def a15(spark, sf):
    path = scratch_dir(spark, "table")
    out = panel_agg(spark, sf).select("season", "element", "gw", "total_points", "value")
    S.write_table(out, path, ["season"])
    return spark.read.schema(out.schema).parquet(path).select(*out.columns)


@query("a15_rewrite_season", """with @PA, x as (select max(season) as last from pa)
 select season, element, gw, case when season = last then -total_points else total_points end as total_points from pa, x""")
def a15r(spark, sf):
    """All seasons written, then the last one again with other values: the others stay as they were."""
    path = scratch_dir(spark, "seasons")
    rows = panel_agg(spark, sf).select("season", "element", "gw", "total_points")
    S.write_table(rows, path, ["season"])
    before = spark.read.schema(rows.schema).parquet(path)
    last = before.where(F.col("season") == before.agg(F.max("season")).scalar()).withColumn("total_points", -F.col("total_points"))
    last = materialise(last.select(*rows.columns), "season")
    for _ in range(2):  # writing again changes nothing
        S.write_table(last, path, ["season"])
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


@query("a15_write_json", "with @PA select season, element, gw, total_points from pa")
def a15j(spark, sf):
    path = scratch_dir(spark, "json")
    out = panel_agg(spark, sf).select("season", "element", "gw", "total_points")
    S.write_table(out, path, ["season"], "json")
    return spark.read.schema(out.schema).json(path).select(*out.columns)


_LINE_SPARK = """case when event_type = 'click' then concat(date_format(ts, 'HH:mm:ss'), ' [INFO] Eval at step ', event_id * 1000, ': ', cast(value as string), ' +/- ', cast(value as string), ' pts (', user_id, ' episodes)')
  when event_type = 'view' then concat('12:00:00 [INFO] PPO step ', event_id, ': loss=', cast(value as string), ' | entropy=-', user_id) else concat('noise ', event_id) end"""


def log_lines(spark, sf):
    return table(spark, sf, "events").selectExpr("event_id", f"{_LINE_SPARK} as line")


@query("a16_parse_eval_log", """select event_id, strftime(ts, '%H:%M:%S') as time, event_id * 1000 as step, value as mean, value as std, user_id as episodes from events where event_type = 'click'""")
def a16(spark, sf):
    return L.parse_eval_lines(log_lines(spark, sf), "line", ["event_id"])


@query("a16_parse_metric_log", "select event_id as step, value as loss, -user_id::double as entropy, cast(null as double) as approx_kl from events where event_type = 'view'")
def a16m(spark, sf):
    return L.parse_metric_lines(log_lines(spark, sf), "line", ["loss", "entropy", "approx_kl"])


@query("a17_elapsed_and_rate", """with t as (select event_type as run, event_id, event_id * 100 as step, strftime(ts, '%H:%M:%S') as time,
   (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 60.0 as m from events)
 select run, event_id, step, time, round(m - first_value(m) over (partition by run order by event_id), 6) as elapsed,
  round((step - lag(step) over (partition by run order by event_id)) / nullif(m - lag(m) over (partition by run order by event_id), 0), 6) as rate from t""")
def a17(spark, sf):
    t = table(spark, sf, "events").selectExpr("event_type as run", "event_id", "event_id * 100 as step", "date_format(ts, 'HH:mm:ss') as time")
    out = L.elapsed_and_rate(t, ["run"], "event_id", "step", "time")
    return out.withColumns({"elapsed": r6("elapsed"), "rate": r6("rate")})
