"""Connected components by alternating large-star and small-star rounds.

Every round is a join with a per-node minimum and is written to the shared
folder, so lineage stays short and lost executors cost one round; the round
before is deleted then. Edges are kept as stars towards the smallest node; their
number never grows. The minima are aggregated map-side and written before they
are joined, so that both sides of a join come straight from an exchange and
Spark splits a node that many edges share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u, v), u > v. large: larger neighbours join the least one; small: smaller ones and the node itself."""
    if large:
        ways = edges.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("w")))
        least = materialise(ways.groupBy("n").agg(F.least("n", F.min("w")).alias("m")), "least")
        made = ways.filter("w > n").join(least.hint("merge"), "n").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = edges.join(least.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        made = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return made.distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the long edges (u, v), component its least node; u <> v."""
    spark = edges.sparkSession
    edges = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    digest = F.struct(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)))
    before = None
    while before != (now := edges.select(digest).first()[0]):
        before, old = now, edges.written_to
        with scratch() as made:
            large = materialise(_star(edges, True), "edges")
            edges = materialise(_star(large, False), "edges")
        discard(spark, old, *(p for p in made if p != edges.written_to))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
