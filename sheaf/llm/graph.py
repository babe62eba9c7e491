"""Connected components of a distributed edge list (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round replaces the edges by stars around smaller nodes; a hub's rows are only summed to a minimum
    (map-side) and joined back (a join whose large partitions Spark can split). Rounds are written, so a lost
    executor costs one round. Self-loops are ignored; an empty edge list gives an empty result.
    """
    now = written(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u > v").distinct(), "components")
    while True:
        # settled when it is a star forest: each child has one parent, and no parent is itself a child
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
            now.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        ends = ends.groupBy("x").agg(F.sum("child").alias("children"), F.max("parent").alias("parent"))
        if ends.where("children > 1 or (children = 1 and parent = 1)").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(spark, large, "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(spark, small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v")
                      .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
