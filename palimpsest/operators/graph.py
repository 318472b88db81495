"""Connected components within groups of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import discard, durable


def connected(edges: DataFrame, groups: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """groups, id, component: the least id that edges lead to, of each id on an edge.

    Every round each id takes its neighbours' least label, and then that label's own label; each round is written, so plans stay short, and the one before it is deleted.
    """
    both = edges.select(*groups, F.col(a).alias("id"), F.col(b).alias("other")).unionByName(edges.select(*groups, F.col(b).alias("id"), F.col(a).alias("other"))).distinct()
    both = durable(both, "graph")
    labels = durable(both.groupBy(*groups, "id").agg(F.least(F.min("other"), F.col("id")).alias("component")), "labels")
    before = labels
    while True:
        near = both.join(labels.withColumnRenamed("id", "other"), [*groups, "other"]).groupBy(*groups, "id").agg(F.min("component").alias("near"))
        stepped = labels.join(near, [*groups, "id"]).select(*groups, "id", F.col("component").alias("old"), F.least("component", "near").alias("mid"))
        jump = labels.select(*groups, F.col("id").alias("mid"), F.col("component").alias("far"))
        new = durable(stepped.join(jump, [*groups, "mid"], "left").select(*groups, "id", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")), "labels")
        moved = new.filter("old <> component").limit(1).count()
        discard(before)
        before, labels = new, new.drop("old")
        if not moved:
            discard(both)
            return labels
