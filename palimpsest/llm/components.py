"""Connected components of an edge list that only ever exists as a distributed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import discard, durable


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Large star: each neighbour above a node goes to the node's least neighbour. Small star: the node and its lesser ones do."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    # the table of minima is far smaller than a hub's edges, which AQE splits
    moved = around.join(least, "a")
    moved = moved.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node, component (its least node), for each node of an edge between two nodes. Null ends and loops are no edges.

    Large-star and small-star rounds until nothing moves; their number grows with the logarithm of a component's width.
    Each round is written to the shared folder, and the one before it is deleted.
    """
    now = durable(edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where(f"`{left}` IS NOT NULL AND `{right}` IS NOT NULL AND `{left}` <> `{right}`").distinct(), "edges")
    before = None
    while True:
        last, now = now, durable(_star(_star(now, True), False), "stars")
        discard(last)
        # both stars leave a forest of stars unchanged: as many edges, and the same sum of their lesser ends
        state = now.agg(F.count(F.lit(1)), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
