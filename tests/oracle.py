"""Run catalogue queries on Spark and their statements on DuckDB and compare the results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    if isinstance(v, float):
        return "float"
    if isinstance(v, decimal.Decimal):
        return "decimal"
    return type(v).__name__


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got_cols, got = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return ("rows", len(got))
    res = con.execute(sql)
    want_cols, want = rows([d[0] for d in res.description], res.fetchall())
    if got_cols != want_cols:
        return ("BAD columns", (got_cols, want_cols))
    if len(got) != len(want):
        return ("BAD count", (len(got), len(want), got[:2], want[:2]))
    for i, c in enumerate(got_cols):
        a = {kind(r[i]) for r in got} - {"NoneType"}
        b = {kind(r[i]) for r in want} - {"NoneType"}
        if a != b:
            return ("BAD type", (c, a, b))
    for g, w in zip(got, want):
        if g != w:
            return ("BAD value", (got_cols, g, w))
    return ("ok", len(got))


def main(argv):
    from pitlake.session import build_session

    import __spark_entry__ as entry

    sf_dir = argv[0]
    wanted = argv[1:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    q, o = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in q.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            status, detail = compare(spark, con, name, fn, o.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            status, detail = "BAD error", str(e)[:900]
        if status.startswith("BAD"):
            bad += 1
        if status == "ok" and detail == 0:
            status = "ok EMPTY"
        print(f"{name:38s} {status} {detail} {time.time() - t:.1f}s", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
