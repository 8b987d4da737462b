"""Connected components of a graph that is too large for one task, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import Scratch

SALTS = 16


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Every node's neighbours (``both``: larger ones; else smaller ones) are tied to the smallest of node and
    neighbours.  A node may have a third of all edges: the minimum is aggregated before the shuffle, and its return to
    the edges is salted by the far end, in a merge join (Spark would judge the repeated side by its size before)."""
    if both:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    least = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tied = edges.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(least.hint("merge"), ["a", "_salt"])
    if both:
        return tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    own = least.where("_salt = 0").select("a", F.col("m").alias("b"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).where("a > b").distinct()


def _are_stars(pair: DataFrame) -> bool:
    """Whether every node is tied to one smaller node that is tied to none: another step would change nothing."""
    ends = pair.select(F.col("a").alias("node"), F.lit(1).alias("tied"), F.lit(0).alias("root")).unionByName(pair.select(F.col("b").alias("node"), F.lit(0).alias("tied"), F.lit(1).alias("root")))
    return not ends.groupBy("node").agg(F.sum("tied").alias("tied"), F.max("root").alias("root")).where("tied + root > 1").take(1)


def connected_components(scratch: Scratch, name: str, edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b)."""
    pair = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pair = scratch.keep(pair, f"{name}-0")
    step = 0
    while not _are_stars(pair):
        step += 1
        large = _stars(pair, True)  # edges (node, smallest around it)
        pair = scratch.keep(_stars(large, False), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    nodes = pair.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(pair.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
