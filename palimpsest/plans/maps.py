"""How the driver's tables stand for images: each embedding is an 8 x 8 image of one band."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import images
from palimpsest.session import table

SIDE = 8

#: The same in SQL: px(image_id, cls, y, x, v, g).
PX = """px AS (
  SELECT vec_id AS image_id, label AS cls, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x,
         CAST(embedding[i + 1] AS DOUBLE) AS v, CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5) AS INT) AS g
  FROM embeddings, (SELECT unnest(range(64)) AS i))"""
GT = "gt AS (SELECT image_id, y, x, 1 AS label FROM px WHERE v > 0.15)"
DET = "det AS (SELECT image_id, y, x, CASE WHEN y < 4 THEN 1 ELSE 2 END AS label FROM px WHERE v > 0.10 AND (y * 8 + x) % 7 <> 0)"
IMAGES = "images AS (SELECT vec_id AS image_id FROM embeddings)"
#: Components of gt: comp(image_id, y, x, c), c the least y * 2^20 + x of a component.
COMP = """step AS (
  SELECT a.image_id, a.y * 1048576 + a.x AS p, b.y * 1048576 + b.x AS q FROM gt a JOIN gt b
  ON a.image_id = b.image_id AND a.label = b.label AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
reach AS (
  SELECT image_id, y * 1048576 + x AS p, y * 1048576 + x AS q FROM gt
  UNION SELECT r.image_id, r.p, s.q FROM reach r JOIN step s ON s.image_id = r.image_id AND s.p = r.q),
comp AS (SELECT image_id, CAST(p // 1048576 AS INT) AS y, CAST(p % 1048576 AS INT) AS x, CAST(min(q) AS BIGINT) AS c FROM reach GROUP BY image_id, p)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, cls, y, x, v, g (gray)."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.select(F.col("vec_id").alias("image_id"), F.col("label").alias("cls"), F.posexplode("embedding").alias("pos", "e"))
    rows = rows.select("image_id", "cls", F.expr(f"pos div {SIDE}").cast("int").alias("y"), (F.col("pos") % SIDE).cast("int").alias("x"), F.col("e").cast("double").alias("v"))
    return rows.withColumn("g", images.gray(F.col("v")))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.threshold(pixels(spark, sf_dir), 0.15)


def detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    dotted = pixels(spark, sf_dir).filter((F.col("y") * SIDE + F.col("x")) % 7 != 0)
    return images.threshold(dotted, 0.10, F.when(F.col("y") < 4, 1).otherwise(2))


def image_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"))


#: Sheets of 16 vectors, 32 x 32: sh(image_id, y, x, g).
SHEET = """sh AS MATERIALIZED (
  SELECT vec_id // 16 AS image_id, CAST(vec_id % 16 // 4 * 8 + i // 8 AS INT) AS y, CAST(vec_id % 4 * 8 + i % 8 AS INT) AS x,
         CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5) AS INT) AS g
  FROM embeddings, (SELECT unnest(range(64)) AS i))"""


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, g: images of 32 x 32, each of 16 vectors side by side; the last may end early."""
    rows = pixels(spark, sf_dir)
    y, x = F.expr("cast(image_id % 16 div 4 * 8 + y AS int)"), F.expr("cast(image_id % 4 * 8 + x AS int)")
    return rows.select(F.expr("image_id div 16").alias("sheet"), y.alias("y"), x.alias("x"), "g").withColumnRenamed("sheet", "image_id")


#: Boards of 64 vectors, 64 x 64, black where the last has none: bd(image_id, y, x, g).
BOARD = """bd AS (
  SELECT board AS image_id, CAST(tile // 8 * 8 + i // 8 AS INT) AS y, CAST(tile % 8 * 8 + i % 8 AS INT) AS x,
         coalesce(CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5) AS INT), 0) AS g
  FROM (SELECT id // 64 AS board, id % 64 AS tile, any_value(embedding) AS embedding
        FROM (SELECT vec_id AS id, embedding FROM embeddings UNION ALL SELECT board * 64 + t, NULL FROM (SELECT DISTINCT vec_id // 64 AS board FROM embeddings), (SELECT unnest(range(64)) AS t)) GROUP BY id),
       (SELECT unnest(range(64)) AS i))"""


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, g: images of 64 x 64, each of 64 vectors side by side, black where the last has none."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    tiles = vectors.select(F.expr("vec_id div 64").alias("image_id")).distinct().withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(63))))
    rows = tiles.join(vectors, F.col("image_id") * 64 + F.col("tile") == F.col("vec_id"), "left").withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1))))
    y, x = F.expr(f"cast(tile div 8 * 8 + pos div {SIDE} AS int)"), F.expr(f"cast(tile % 8 * 8 + pos % {SIDE} AS int)")
    return rows.select("image_id", y.alias("y"), x.alias("x"), F.coalesce(images.gray(F.get("embedding", F.col("pos")).cast("double")), F.lit(0)).alias("g"))
