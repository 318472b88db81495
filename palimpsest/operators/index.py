"""Approximate nearest neighbours by a forest of cutting trees: candidates share a leaf, distances are exact.

Each tree cuts a sample again and again at the median of one of its widest dimensions, drawn by a seed. Every row of the table goes down every tree; rows of one leaf meet in blocks, as
matrix products (`matching.nearest`, with leaves for images), and a row's best over all trees is what it gets. The sample is bounded by `sample_rows`, so the trees are, and they
are broadcast; leaves beyond what the sample can tell apart grow with the table and split into more blocks.

Equal vectors are one row of the search: a group of copies, however large, stands for its k + 1 least ids, as ties go by id, and each copy gets the group's neighbours without itself.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.matching import nearest
from palimpsest.session import durable, prepare

#: Dimensions of greatest spread that a cut is drawn from, and groups a hot vector's copies are split into first.
WIDEST, SALTS = 5, 64


class Forest(NamedTuple):
    dimensions: np.ndarray  # (trees, 2^depth - 1), in heap order
    cuts: np.ndarray
    depth: int

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """(rows, trees): numbers from 0 that no two trees share."""
        out = np.zeros((len(vectors), len(self.dimensions)), np.int64)
        rows = np.arange(len(vectors))
        for t, (dimensions, cuts) in enumerate(zip(self.dimensions, self.cuts, strict=True)):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (vectors[rows, dimensions[node]] > cuts[node])
            out[:, t] = node - ((1 << self.depth) - 1) + (t << self.depth)
        return out


def grow(sample: np.ndarray, trees: int, depth: int, seed: int = 0) -> Forest:
    """Trees over a sample; a node that gets no row of it sends all to its left."""
    random = np.random.default_rng(seed)
    nodes = (1 << depth) - 1
    dimensions, cuts = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf)
    for t in range(trees):
        rows = [np.arange(len(sample))] + [np.zeros(0, np.int64)] * (2 * nodes)
        for node in range(nodes):
            own = sample[rows[node]]
            if len(own):
                at = random.choice(np.argsort(-own.var(axis=0), kind="stable")[:WIDEST])
                cut = np.median(own[:, at])
                dimensions[t, node], cuts[t, node] = at, cut
                right = own[:, at] > cut
                rows[2 * node + 1], rows[2 * node + 2] = rows[node][~right], rows[node][right]
    return Forest(dimensions, cuts, depth)


def _first_ids(features: DataFrame, most: int) -> DataFrame:
    """vec, id (the least), ids: the least ids of each distinct vector, at most so many; first within salts, so a hot vector is many keys."""
    rows = features.select("vec", "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for keys in (["vec", "salt"], ["vec"]):
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("id"))).filter(F.col("r") <= most).drop("r")
    return rows.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "vec", "ids")


def fit(vectors: DataFrame, rows: int, trees: int, leaf_rows: int, sample_rows: int, seed: int = 0) -> Forest:
    """A forest for so many rows (id, vec), of leaves of about leaf_rows, from the rows of least hashes: at least eight of the sample to a leaf."""
    sample = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample_rows).select("vec").toPandas()  # sample_rows rows
    values = np.array(sample["vec"].tolist(), dtype=float)
    depth = int(np.ceil(np.log2(max(1.0, rows / leaf_rows))))
    return grow(values, trees, max(0, min(depth, int(np.log2(max(1, len(values) / 8))))), seed)


def approximate_nearest(features: DataFrame, k: int, trees: int = 8, leaf_rows: int = 1024, sample_rows: int = 65_536, seed: int = 0) -> DataFrame:
    """id, other, distance, rank: about the k nearest rows (id, vec) of each, by exact Euclidean distances, ties by id; ids are told apart, vectors not null and of one length."""
    spark = prepare(features.sparkSession)
    groups = durable(_first_ids(features, k + 1), "groups")
    n = groups.count()
    if not n:
        return features.sparkSession.createDataFrame([], f"id {dict(features.dtypes)['id']}, other {dict(features.dtypes)['id']}, distance double, rank int")
    forest = fit(groups, n, trees, leaf_rows, sample_rows, seed)
    sent = spark.sparkContext.broadcast(forest)  # at most sample_rows / 8 nodes a tree

    @F.pandas_udf("array<long>")
    def leaves(vec: pd.Series) -> pd.Series:
        return pd.Series(list(sent.value.leaves(np.array(vec.tolist(), dtype=float))))

    spread = groups.select("id", "vec", F.explode(leaves("vec")).alias("image_id"))
    found = nearest(spread, k).groupBy("id", "other").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("id").orderBy("distance", "other")
    found = found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("id", "other", "distance")
    # each group's candidates: its own first ids, and those of its neighbours
    own = groups.select("id", F.col("id").alias("other"), F.lit(0.0).alias("distance"))
    members = groups.select(F.col("id").alias("other"), "ids")
    listed = found.unionByName(own).join(members, "other").select("id", "distance", F.explode("ids").alias("other"))
    listed = listed.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k + 1).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("distance", "other"))).alias("near"))
    whose = features.join(groups.select("vec", F.col("id").alias("group")), "vec").select("id", "group").join(listed.withColumnRenamed("id", "group"), "group")
    mine = F.slice(F.filter("near", lambda c: c["other"] != F.col("id")), 1, k)
    return whose.select("id", F.posexplode(mine).alias("at", "c")).select("id", F.col("c.other").alias("other"), F.col("c.distance").alias("distance"), (F.col("at") + 1).alias("rank"))
