"""Connected components by alternating large-star and small-star rounds, each written to the shared folder.

Links never reach the driver; only their number and a checksum do, to see when a round changes nothing. A node with very
many links is dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gnomon.llm import _runtime as R


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable. Loops and repeated
    links do no harm; null ends are left out."""
    a, b = F.col("a"), F.col("b")
    edges = links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = R.table(spark, edges.distinct(), "edges")
    last = _state(edges)
    while last[0]:
        # Large star: every larger neighbour of u is tied to the smallest node around u.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = R.attach(both.where("v > u"), low, ["u"], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = R.table(spark, large, "large")
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = R.attach(large, low, ["u"], ["v"]).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = R.table(spark, small.where("u != v").distinct(), "edges")
        now = _state(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()
