"""Queries over raster primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import grids
from palimpsest.functions.arrays import angular_difference, log_polar_factor
from palimpsest.operators import raster as R
from palimpsest.operators import scoring as S
from palimpsest.operators.images import XY
from palimpsest.plans import maps
from palimpsest.plans.catalog import query
from palimpsest.plans.maps import COMP, DET, GT, IMAGES, PX, SIDE
from palimpsest.session import table


@query(f"WITH {PX} SELECT image_id, y, x, least(255, greatest(0, g + 40)) AS bright, round(least(255.0::DOUBLE, g * power(2.0, 0.5)), 6) AS exposed, least(255, greatest(0, CAST(floor(g * 1.5 - 20) AS INT))) AS contrasted FROM px")
def brightness_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brightness, exposure and contrast with saturation."""
    px = maps.pixels(spark, sf_dir)
    return px.select(*XY, R.brighten(F.col("g"), F.lit(40)).alias("bright"), F.round(R.expose(F.col("g"), 0.5), 6).alias("exposed"), R.contrast(F.col("g"), 1.5, -20).alias("contrasted"))


@query(f"WITH {PX}, {GT} SELECT image_id, label, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx, count(*) AS size FROM gt GROUP BY image_id, label")
def bbox_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box, centroid and size of each label."""
    b = R.boxes(maps.truth(spark, sf_dir), ["image_id", "label"])
    return b.withColumns({"cy": F.round("cy", 6), "cx": F.round("cx", 6)})


@query(f"WITH {PX}, {GT} SELECT image_id, greatest(min(y) - 2, 0) AS y0, least(max(y) + 2, 7) AS y1, greatest(min(x) - 2, 0) AS x0, least(max(x) + 2, 7) AS x1 FROM gt GROUP BY image_id")
def bbox_enlarged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: boxes grown within the image."""
    return R.enlarged(R.boxes(maps.truth(spark, sf_dir), ["image_id"]), 2, SIDE, SIDE).select("image_id", "y0", "y1", "x0", "x1")


@query(
    f"""WITH RECURSIVE {PX}, {GT}, {COMP}, edge AS (SELECT DISTINCT image_id, c FROM comp WHERE y IN (0, 7) OR x IN (0, 7))
SELECT image_id, y, x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY c) AS INT) AS label FROM comp ANTI JOIN edge USING (image_id, c)"""
)
def border_objects_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: objects that touch the border go, the others are numbered anew."""
    kept = R.drop_border_objects(S.label_components(maps.truth(spark, sf_dir)), SIDE, SIDE)
    return kept.select(*XY, F.col("label").cast("int").alias("label"))


@query(f"WITH RECURSIVE {PX}, {GT}, {COMP}, big AS (SELECT image_id, c FROM comp GROUP BY image_id, c HAVING count(*) >= 3) SELECT image_id, y, x FROM comp JOIN big USING (image_id, c)")
def area_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small components go."""
    return R.open_area(S.label_components(maps.truth(spark, sf_dir)), 3).select(*XY)


@query(f"WITH {PX}, {IMAGES}, used AS (SELECT DISTINCT image_id, y // 2 * 2 AS ty, x // 2 * 2 AS tx FROM px WHERE v > 0.15) SELECT image_id, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx FROM images, (SELECT unnest(range(0, 8, 2)) AS ty), (SELECT unnest(range(0, 8, 2)) AS tx) WHERE (image_id, ty, tx) NOT IN (SELECT image_id, ty, tx FROM used)")
def free_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles without an object pixel."""
    return R.free_tiles(maps.image_list(spark, sf_dir), maps.truth(spark, sf_dir), SIDE, SIDE, 2, 2)


@query(
    f"""WITH {PX}, {GT}, o AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) t(dy, dx)),
dilated AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM gt, o WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7),
eroded AS (SELECT image_id, p.y, p.x FROM px p, o WHERE p.y + dy BETWEEN 0 AND 7 AND p.x + dx BETWEEN 0 AND 7
  GROUP BY image_id, p.y, p.x HAVING bool_and(EXISTS (SELECT 1 FROM gt WHERE gt.image_id = p.image_id AND gt.y = p.y + dy AND gt.x = p.x + dx)))
SELECT image_id, y, x, 'dilated' AS kind FROM dilated UNION ALL SELECT image_id, y, x, 'eroded' FROM eroded"""
)
def dilate_erode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dilation and erosion by a disc of radius 1."""
    gt, disc = maps.truth(spark, sf_dir), grids.disc(1)
    return R.dilate(gt, disc, SIDE, SIDE).withColumn("kind", F.lit("dilated")).unionByName(R.erode(gt, disc, SIDE, SIDE).withColumn("kind", F.lit("eroded")))


@query(f"WITH {PX} SELECT image_id, y, 7 - x AS x, g, 'flip' AS kind FROM px UNION ALL SELECT image_id, 7 - x, y, g, 'turn' FROM px UNION ALL SELECT image_id, y, x, g, 'back' FROM px")
def flip_rotate_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flip, a quarter turn, and a turn taken back."""
    px = maps.pixels(spark, sf_dir).select(*XY, "g")
    turned = R.rotate90(px, SIDE, SIDE, 1)
    parts = {"flip": R.flip(px, SIDE, SIDE, "horizontal"), "turn": turned, "back": R.rotate90(turned, SIDE, SIDE, 3)}
    out = [df.select(*XY, "g", F.lit(kind).alias("kind")) for kind, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"WITH {PX} SELECT image_id, y, x, coalesce(max(g) FILTER (k = 1), max(g) FILTER (k = 0)) AS g FROM (SELECT image_id, y, x, g, 0 AS k FROM px UNION ALL SELECT image_id, y + 2, x + 3, g, 1 FROM px WHERE v > 0.1 AND y < 6 AND x < 5) GROUP BY image_id, y, x")
def masked_paste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object moved by (2, 3) and pasted over its image."""
    px = maps.pixels(spark, sf_dir)
    moved = px.filter("v > 0.1").select("image_id", (F.col("y") + 2).alias("y"), (F.col("x") + 3).alias("x"), "g")
    return R.paste(px.select(*XY, "g"), moved, "g")


@query(f"WITH {PX}, m AS (SELECT image_id, y, x, 1 AS bits FROM px WHERE v > 0.1 UNION ALL SELECT image_id, y, x, 2 FROM px WHERE v > 0.2 UNION ALL SELECT image_id, y, x, 4 FROM px WHERE x = y) SELECT image_id, y, x, bit_or(bits) AS bits FROM m GROUP BY image_id, y, x")
def mask_union_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mask from several by bitwise or."""
    px = maps.pixels(spark, sf_dir)
    parts = [px.filter(c).select(*XY, F.lit(b).alias("bits")) for c, b in (("v > 0.1", 1), ("v > 0.2", 2), ("x = y", 4))]
    return R.union_masks(parts[0].unionByName(parts[1]).unionByName(parts[2]), "bits")


@query(f"WITH {PX}, r AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY image_id) SELECT image_id, y, x, CAST(floor((v - lo) / (hi - lo) * 255) AS INT) AS byte FROM px JOIN r USING (image_id)")
def rescale_8bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: each image's range to 8 bits."""
    return R.to_8bit(maps.pixels(spark, sf_dir), "v").select(*XY, "byte")


@query(f"WITH {PX} SELECT image_id, CASE WHEN y < 4 AND x < 4 THEN 'top_left' WHEN x < 4 THEN 'bottom_left' WHEN y >= 4 THEN 'bottom_right' ELSE 'top_right' END AS part, count(*) AS n, sum(g) AS total FROM px GROUP BY ALL")
def quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four parts of an image."""
    return maps.pixels(spark, sf_dir).groupBy("image_id", R.quadrant(SIDE, SIDE).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("g").alias("total"))


@query(
    f"""WITH {PX} SELECT p.image_id, p.y, p.x, CAST((SELECT sum(g) FROM px q WHERE q.image_id = p.image_id AND q.y <= p.y AND q.x <= p.x) AS BIGINT) AS integral,
CAST((SELECT sum(g) FROM px q WHERE q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1) AS BIGINT) AS box FROM px p"""
)
def box_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integral image and 3 x 3 sums, each by two running windows."""
    px = maps.pixels(spark, sf_dir).select(*XY, "g")
    return R.box_sums(R.integral(px, "g"), "g", 1, SIDE, SIDE).select(*XY, "integral", "box")


_HAAR = """q AS (SELECT image_id, y // 2 AS y, x // 2 AS x, sum(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN v ELSE 0 END) AS a, sum(CASE WHEN y % 2 = 0 AND x % 2 = 1 THEN v ELSE 0 END) AS b,
  sum(CASE WHEN y % 2 = 1 AND x % 2 = 0 THEN v ELSE 0 END) AS c, sum(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN v ELSE 0 END) AS d FROM px GROUP BY ALL)"""


@query(f"WITH {PX}, {_HAAR} SELECT image_id, y, x, round((a + b + c + d) / 2, 6) AS ll, round((a - b + c - d) / 2, 6) AS hl, round((a + b - c - d) / 2, 6) AS lh, round((a - b - c + d) / 2, 6) AS hh FROM q")
def haar_level1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wavelet level."""
    return R.haar(maps.pixels(spark, sf_dir), "v").select(*XY, *[F.round(c, 6).alias(c) for c in ("ll", "hl", "lh", "hh")])


@query(
    f"""WITH {PX}, {_HAAR}, e AS (SELECT image_id, sum(v * v) AS e, count(*) AS n FROM px GROUP BY image_id), l AS (SELECT image_id, sum((a + b + c + d) / 2 * ((a + b + c + d) / 2)) AS l FROM q GROUP BY image_id)
SELECT image_id, round(l / e, 6) AS low_share, round(sqrt(CASE WHEN l / e > 0.5 THEN 0.02 ELSE 0.01 END * n), 6) AS size FROM e JOIN l USING (image_id)"""
)
def adaptive_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment size from the energy of the low band."""
    return R.segment_size(maps.pixels(spark, sf_dir), "v", 1).select("image_id", F.round("low_share", 6).alias("low_share"), F.round("size", 6).alias("size"))


@query(
    f"""WITH {PX}, h AS (SELECT image_id, y // 4 AS block_y, x // 4 AS block_x, g AS bin, count(*) AS n FROM px GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY image_id, block_y, block_x) AS total FROM h), e AS (SELECT image_id, block_y, block_x, sum(-(n / total) * log2(n / total)) AS entropy FROM t GROUP BY ALL)
SELECT image_id, CAST(block_y AS INT) AS block_y, CAST(block_x AS INT) AS block_x, round(entropy, 6) AS entropy FROM e WHERE entropy >= 1.5"""
)
def block_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of enough entropy."""
    px = maps.pixels(spark, sf_dir).select("image_id", F.expr("y div 4").cast("int").alias("block_y"), F.expr("x div 4").cast("int").alias("block_x"), F.col("g").alias("bin"))
    return R.entropy(px, ["image_id", "block_y", "block_x"], "bin").filter("entropy >= 1.5").withColumn("entropy", F.round("entropy", 6))


@query(f"WITH {PX}, d AS (SELECT image_id, y, x FROM px WHERE least(255, g + CASE WHEN y BETWEEN 2 AND 4 AND v > 0 THEN 30 ELSE 0 END) <> g) SELECT image_id, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, count(*) AS size FROM d GROUP BY image_id")
def image_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two images differ, and the box around it."""
    px = maps.pixels(spark, sf_dir)
    other = px.withColumn("g", F.least(F.lit(255), F.col("g") + F.when(F.col("y").between(2, 4) & (F.col("v") > 0), 30).otherwise(0)))
    return R.boxes(R.difference(px, other, ["g"]), ["image_id"]).select("image_id", "y0", "y1", "x0", "x1", "size")


@query(f"WITH {PX}, c AS (SELECT image_id, y, x, g AS r, 255 - g AS gr, abs(g - 128) AS b FROM px) SELECT image_id, y, x, round((r + gr + b) / sqrt(3::DOUBLE), 6) AS lum, round((r - b) / sqrt(2::DOUBLE), 6) AS cu, round((r - 2 * gr + b) / sqrt(6::DOUBLE), 6) AS cv, round(0.299::DOUBLE * r + 0.587::DOUBLE * gr + 0.114::DOUBLE * b, 6) AS gray FROM c")
def colour_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orthonormal colour axes and luminance."""
    px = maps.pixels(spark, sf_dir).select(*XY, F.col("g").alias("r"), (255 - F.col("g")).alias("g"), F.abs(F.col("g") - 128).alias("b"))
    axes = px.select(*XY, *R.yuv(), R.gray_of().alias("gray"))
    return axes.select(*XY, *[F.round(c, 6).alias(c) for c in ("lum", "cu", "cv", "gray")])


@query(f"WITH {PX}, o AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) t(dy, dx)) SELECT p.image_id, p.y, p.x, CAST(quantile_cont(q.g, 0.5) AS DOUBLE) AS median FROM px p JOIN o ON TRUE JOIN px q ON q.image_id = p.image_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL")
def disc_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians over a disc."""
    return R.medians(maps.pixels(spark, sf_dir).select(*XY, "g"), "g", grids.disc(1))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = maps.pixels(spark, sf_dir)
    ordered = px.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "g"))), lambda s: s["g"].cast("double")).alias("values"))
    return ordered.select("image_id", F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), "values")


@query()
def blur_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blur only in the ring between an object's erosion and dilation."""

    def kernel(_, image):
        mask = image > 140
        ring = grids.dilate(mask, grids.box(1)) ^ grids.erode(mask, grids.box(1))
        import numpy as np

        return np.where(ring, np.floor(grids.blur(image, 1, gaussian=True)), image)

    return R.on_images(_packed(spark, sf_dir), kernel)


@query()
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rotation by 30 degrees and a scale, then half size."""

    def kernel(_, image):
        import numpy as np

        c, s, m = np.cos(np.pi / 6), np.sin(np.pi / 6), 3.5
        turn = np.array([[c, -s, m - c * m + s * m], [s, c, m - s * m - c * m]])
        return np.floor(grids.resize_linear(grids.warp_affine(image, turn), SIDE // 2, SIDE // 2))

    return R.on_images(_packed(spark, sf_dir), kernel)


@query()
def holes_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed masks with their holes filled."""

    def kernel(_, image):
        return grids.fill_holes(grids.MORPHOLOGY["CLOSE"](image > 135, grids.disc(1)))

    return R.on_images(_packed(spark, sf_dir), kernel)


@query(
    f"""WITH {PX}, {GT}, n AS (SELECT p.image_id, p.y, p.x, p.v > 0.15 AS on_, p.v > 0.05 AS any_,
  (SELECT count(*) FROM gt q WHERE q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1) AS support FROM px p)
SELECT image_id, y, x, CASE WHEN support >= 4 THEN 255 WHEN on_ THEN 170 WHEN any_ THEN 85 ELSE 0 END AS value FROM n"""
)
def truth_postprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full support gives 255; else marked pixels fall to 170 and changed ones to 85."""
    px = maps.pixels(spark, sf_dir).withColumn("on", (F.col("v") > 0.15).cast("int"))
    support = R.box_sums(px, "on", 1, SIDE, SIDE)
    value = F.when(F.col("box") >= 4, 255).when(F.col("on") == 1, 170).when(F.col("v") > 0.05, 85).otherwise(0)
    return support.select(*XY, value.alias("value"))


@query(f"WITH {PX}, {DET} SELECT DISTINCT image_id, label FROM det WHERE label <> 0")
def distinct_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of each map."""
    return R.labels_of(maps.detection(spark, sf_dir))


@query(f"WITH {PX} SELECT p.image_id, p.y, p.x FROM px p WHERE p.g >= 110 AND NOT EXISTS (SELECT 1 FROM px q WHERE q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 AND q.g < 110)")
def subimage_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is opaque, worn off by a square."""
    return R.subimage(maps.pixels(spark, sf_dir), "g", 110, SIDE, SIDE, 1).select("image_id", "y", "x")


@query("SELECT p_partkey, least((p_partkey * 37 - p_size * 53) % 360 + CASE WHEN (p_partkey * 37 - p_size * 53) % 360 < 0 THEN 360 ELSE 0 END, 360 - ((p_partkey * 37 - p_size * 53) % 360 + CASE WHEN (p_partkey * 37 - p_size * 53) % 360 < 0 THEN 360 ELSE 0 END)) AS apart, round((p_size + 2) / (ln((p_size + 2)::DOUBLE) - ln(2.0::DOUBLE) / 2), 6) AS factor FROM part")
def angles_and_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles between directions, and the log-polar factor of a width."""
    p = table(spark, sf_dir, "part").withColumns({"a": F.col("p_partkey") * 37, "b": F.col("p_size") * 53})
    return p.select("p_partkey", angular_difference("a", "b").alias("apart"), F.round(log_polar_factor((F.col("p_size") + 2).cast("double")), 6).alias("factor"))
