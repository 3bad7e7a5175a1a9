"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attach, salt, stage


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, root): root is the smallest node reachable. Nodes without an edge are left out.

    Each round lets every node hand its larger neighbours to its smallest one (large star), then its smaller
    neighbours (small star); the rounds stop when every component is a star around its smallest node. A round is two
    aggregations with partial sums and two joins, written to the shared folder; the number of rounds grows with the
    logarithm of the components' diameter. Nothing but a count and a checksum reaches the driver.
    """
    now = stage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = None
    while (state := _checksum(now)) != before:
        before = state
        now = stage(_small_star(_large_star(now)))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with the least m of their u; the edges of one node, however many, are spread over many join keys."""
    return attach(edges.withColumn("_salt", salt("v")), least, ["u"], "_salt").drop("_salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return _with_least(both, least).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return _with_least(edges, least).select(hung.alias("u"), F.col("m").alias("v")).distinct()
