"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a, b with a > b. Neighbours of a node are hung below the smallest of them; minima are summed up before rows
    are dealt, so that a node with many neighbours is no burden."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")).withColumnRenamed("a", "u")
    met = both.join(least, F.col("a") == F.col("u"))
    if large:
        out = met.filter(F.col("b") > F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs: (node, component) for every node with an edge, component being the smallest node."""
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    mark = None
    while True:
        sums = now.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))), F.lit(0))).first()
        if sums == mark or not sums[0]:
            break
        mark = sums
        now = saved(_star(_star(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
