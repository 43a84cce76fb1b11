"""Connected components of a large graph, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link neighbours to the least of a node and its neighbours.

    For every node: all larger neighbours (``larger_only``), or itself and all smaller ones, get an
    edge to that least node. ``edges`` hold each link once, ``u`` > ``v``.
    """
    if larger_only:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    with_least = near.join(least, "u")
    if larger_only:
        new = with_least.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = with_least.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return new.filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge at most, to a node that has none: then that node is its component's least."""
    n, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return n == nodes and edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``component`` (least node reachable) for all nodes of ``links``, a table of long pairs.

    Each round relinks every node to lower ones and writes the new edges to the shared folder, until
    all hang on the least of their component, after a number of rounds that grows with the logarithm
    of the longest chain. Self links and repeats count nothing; NULL ends are left out.
    """
    proper = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = materialise(proper.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    while not _settled(edges):
        edges = materialise(_stars(_stars(edges, True), False), "links")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
