"""Queries that read the panel several times join it once."""

import datetime as dt

from pyspark.sql import functions as F

from pitlake.plans import catalog_evals, catalog_scalars, catalog_windows


def _tables(spark, at):
    day = lambda i: dt.datetime(1996, 1 + i % 6, 1 + i % 28)
    n = 120
    spark.createDataFrame([(i, f"C{i}", (i * 3) % 5) for i in range(6)], "c_custkey long, c_name string, c_nationkey int").write.parquet(f"{at}/customer.parquet")
    spark.createDataFrame([(i, f"S{i}", i % 5) for i in range(4)], "s_suppkey long, s_name string, s_nationkey int").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame([(i, f"N{i}") for i in range(5)], "n_nationkey int, n_name string").write.parquet(f"{at}/nation.parquet")
    spark.createDataFrame([(i, i % 6, day(i)) for i in range(n)], "o_orderkey long, o_custkey long, o_orderdate timestamp").write.parquet(f"{at}/orders.parquet")
    spark.createDataFrame(
        [(i, i % 30, i % 4, 1 + k, float((i * 7 + k * 11) % 50 + 1), 10.0 * i, (i % 11) / 100, 0.02, "NRA"[(i + k) % 3]) for i in range(n) for k in range(3)],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string",
    ).write.parquet(f"{at}/lineitem.parquet")
    return n


def test_the_panel_is_joined_once(spark, tmp_path):
    at = str(tmp_path / "t")
    n = _tables(spark, at)
    for query in (catalog_evals.h06, catalog_scalars.b14, catalog_windows.e05):
        out = query(spark, at)
        assert not [f for f in out.inputFiles() if "lineitem" in f or "orders" in f]
    zeros = catalog_evals.h06(spark, at).collect()
    rows = spark.read.parquet(f"{at}/lineitem.parquet").join(spark.read.parquet(f"{at}/orders.parquet"), F.expr("l_orderkey = o_orderkey"))
    bonus = F.when(F.col("l_quantity") > 10, F.round(F.col("l_discount") * 100).cast("long") % 4).otherwise(0)
    want = rows.groupBy("l_suppkey", F.month("o_orderdate")).agg(F.sum(bonus).alias("b")).where("b = 0").count()
    assert [r.n_zero for r in zeros] == [want]
    assert sum(r.n_fixtures for r in catalog_scalars.b14(spark, at).collect()) > 0 and n
