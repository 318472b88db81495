"""Queries of robust transforms and of the verification of keypoint matches, on boards of 64 x 64 with a match a vector."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import estimators, grids
from palimpsest.operators import features as B
from palimpsest.operators import homographies as H
from palimpsest.operators import matching as M
from palimpsest.operators import verify as V
from palimpsest.operators.images import XY
from palimpsest.plans import maps
from palimpsest.plans.catalog import query
from palimpsest.plans.maps import BOARD
from palimpsest.session import durable, prepare, table

#: A match a vector: 9 down and 12 right, each sixth 5 further, each ninth turned; some are given from copy to source.
_MATCHES = """ma AS (
  SELECT vec_id // 64 AS image_id, vec_id AS id, CASE WHEN vec_id % 4 = 1 THEN ty ELSE y END AS y, CASE WHEN vec_id % 4 = 1 THEN tx ELSE x END AS x,
    CASE WHEN vec_id % 4 = 1 THEN y ELSE ty END AS my, CASE WHEN vec_id % 4 = 1 THEN x ELSE tx END AS mx, 0.8 + vec_id % 4 * 0.15 AS scale, 0.8 + vec_id % 5 * 0.15 AS mscale,
    radians(vec_id * 37 % 360) AS theta, radians(vec_id * 37 % 360 + CASE WHEN vec_id % 9 = 0 THEN 90 ELSE vec_id % 3 END) AS mtheta
  FROM (SELECT *, y + 9 + CASE WHEN vec_id % 6 = 0 THEN 5 ELSE 0 END AS ty, x + 12 AS tx FROM (
    SELECT vec_id, CAST(8 + floor(abs(CAST(embedding[1] AS DOUBLE)) * 150) % 32 AS INT) AS y, CAST(8 + floor(abs(CAST(embedding[2] AS DOUBLE)) * 150) % 32 AS INT) AS x FROM embeddings)))"""


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = lambda k: F.expr(f"cast(8 + floor(abs(cast(embedding[{k}] AS double)) * 150) % 32 AS int)")
    e = table(spark, sf_dir, "embeddings").select("vec_id", place(0).alias("y"), place(1).alias("x"))
    e = e.withColumns({"ty": F.expr("y + 9 + CASE WHEN vec_id % 6 = 0 THEN 5 ELSE 0 END"), "tx": F.expr("x + 12")})
    back = F.expr("vec_id % 4 = 1")
    ends = [F.when(back, F.col(q)).otherwise(F.col(p)).alias(n) for n, p, q in (("y", "y", "ty"), ("x", "x", "tx"), ("my", "ty", "y"), ("mx", "tx", "x"))]
    scales = [F.expr(f"cast(0.8 AS double) + vec_id % {k} * cast(0.15 AS double)").alias(n) for n, k in (("scale", 4), ("mscale", 5))]
    turns = [F.expr(f"radians(vec_id * 37 % 360 {more})").alias(n) for n, more in (("theta", ""), ("mtheta", "+ CASE WHEN vec_id % 9 = 0 THEN 90 ELSE vec_id % 3 END"))]
    return e.select(F.expr("vec_id div 64").alias("image_id"), F.col("vec_id").alias("id"), *ends, *scales, *turns)


_SIZES = "sz AS (SELECT image_id, max(y) + 1 AS height, max(x) + 1 AS width FROM bd GROUP BY image_id)"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.settings(maps.boards(spark, sf_dir).groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")))


_BY = lambda t, s, m, b: f"CASE WHEN tiny THEN {t} WHEN small THEN {s} WHEN big THEN {b} ELSE {m} END"


@query(
    f"""WITH i AS (SELECT p_partkey AS image_id, CAST(100 + p_partkey * 7 % 1900 AS INT) AS height, CAST(100 + p_partkey * 13 % 1900 AS INT) AS width FROM part),
s AS (SELECT *, height * width / 1e6::DOUBLE AS area, width < 600 AND height < 600 AS tiny, width < 840 AND height < 840 AS small, width >= 1400 AND height >= 1400 AS big FROM i),
t AS (SELECT *, {_BY(2000, 250, "least(500, 400 + CAST(round_even(30 * area, 0) AS INT))", "least(500, 400 + CAST(round_even(30 * area, 0) AS INT))")} AS size FROM s)
SELECT image_id, height, width, {_BY(1, 1, 1, 8)} AS allowed, NOT big AS check_scale, NOT small AS check_distance, NOT small AS check_edges, {_BY(0, 0, 25, 130)} AS least_distance, {_BY(1, 1, 1, 2)} AS directions,
  {_BY(5, 4, 5, 6)} AS least_inliers, {_BY(6, 4, 20, 30)} AS enough_inliers, CASE WHEN small THEN greatest(40.0::DOUBLE, 25 * sqrt(area)) ELSE 25 * sqrt(area) END AS clone_distance,
  CASE WHEN big THEN CAST(round_even(size * 1.3::DOUBLE, 0) AS INT) ELSE size END AS least_size, {_BY(5, 5, 4, 30)} AS scale_weight, CASE WHEN big THEN 0.05::DOUBLE ELSE 0.2::DOUBLE END AS match_share,
  {_BY(20, 20, 20, 48)} AS largest_radius, {_BY(16, 16, 16, 20)} AS least_radius, {_BY(300, 300, 300, 1500)} AS largest_hole, {_BY("0.65::DOUBLE", "0.74::DOUBLE", "0.52::DOUBLE", "0.6::DOUBLE")} AS match_ratio,
  CASE WHEN big THEN least(2, CAST(round_even(3 * sqrt(area), 0) AS INT)) WHEN small THEN least(3, CAST(round_even(3 * area, 0) AS INT)) ELSE least(3, CAST(round_even(3 * sqrt(area), 0) AS INT)) END AS least_neighbours,
  CASE WHEN big THEN 16000 ELSE 7000 END AS octave_keypoints FROM t"""
)
def clone_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's settings by image size, for sizes made from the parts."""
    side = lambda k: F.expr(f"cast(100 + p_partkey * {k} % 1900 AS int)")
    return H.settings(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), side(7).alias("height"), side(13).alias("width")))


@query(
    f"""WITH {BOARD}, {_MATCHES}, {_SIZES}, n AS (SELECT ma.* FROM ma JOIN sz USING (image_id) WHERE y < height AND x < width AND my < height AND mx < width),
k AS (SELECT * FROM n WHERE image_id IN (SELECT image_id FROM n GROUP BY image_id HAVING count(*) >= 5)), s AS (SELECT image_id, id AS seed, y AS sy, x AS sx FROM k WHERE id % 5 = 0)
SELECT s.image_id, seed, id FROM s JOIN k ON s.image_id = k.image_id AND (sqrt((y - sy) * (y - sy) + (x - sx) * (x - sx)) <= 18 OR sqrt((my - sy) * (my - sy) + (mx - sx) * (mx - sx)) <= 18)"""
)
def seed_neighbourhoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches with an end near a seed's first end, by cells as wide as the reach."""
    sizes = _sizes(spark, sf_dir)
    m = H.inside(_matches(spark, sf_dir), sizes)
    picked = m.filter("id % 5 = 0").select("image_id", F.col("id").alias("seed"), F.col("y").alias("sy"), F.col("x").alias("sx"))
    return H.around(m, picked, sizes.withColumn("clone_distance", F.lit(-74.0))).select("image_id", "seed", "id")


@query(
    f"""WITH {BOARD}, {_MATCHES}, {_SIZES},
d AS (SELECT image_id, y, x, g, lag(g) OVER (PARTITION BY image_id, x ORDER BY y) AS up, lead(g) OVER (PARTITION BY image_id, x ORDER BY y) AS down, lag(g) OVER (PARTITION BY image_id, y ORDER BY x) AS l, lead(g) OVER (PARTITION BY image_id, y ORDER BY x) AS r FROM bd),
s AS (SELECT image_id, y, x, sqrt(power(CASE WHEN up IS NULL THEN down - g WHEN down IS NULL THEN g - up ELSE (down - up) / 2.0::DOUBLE END, 2) + power(CASE WHEN l IS NULL THEN r - g WHEN r IS NULL THEN g - l ELSE (r - l) / 2.0::DOUBLE END, 2)) AS s FROM d),
k AS (SELECT ma.* FROM ma JOIN sz USING (image_id) WHERE y BETWEEN 16 AND height - 16 AND x BETWEEN 16 AND width - 16 AND my BETWEEN 16 AND height - 16 AND mx BETWEEN 16 AND width - 16),
e AS (SELECT k.image_id, id, sum(s) FILTER (s.y BETWEEN k.y - 16 AND k.y + 15 AND s.x BETWEEN k.x - 16 AND k.x + 15) AS p, sum(s) FILTER (s.y BETWEEN my - 16 AND my + 15 AND s.x BETWEEN mx - 16 AND mx + 15) AS q FROM k JOIN s ON s.image_id = k.image_id GROUP BY k.image_id, id)
SELECT image_id, id, round(greatest(p, q) / greatest(1, least(p, q)), 6) AS ratio FROM e"""
)
def noise_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much steeper the square around one end of a match is than around the other."""
    found = H.noise_ratios(_matches(spark, sf_dir), maps.boards(spark, sf_dir), _sizes(spark, sf_dir))
    return found.select("image_id", "id", F.round("ratio", 6).alias("ratio"))


#: Two models an image: the shift that most matches follow, and one that is a little in perspective.
_MODELS = """mo AS (SELECT image_id, seed, CASE seed WHEN 0 THEN [1.0, 0.0, 12.0, 0.0, 1.0, 9.0, 0.0, 0.0, 1.0] ELSE [1.02, 0.01, 11.5, -0.01, 0.99, 9.25, 0.0002, -0.0001, 1.0] END::DOUBLE[] AS h,
  CASE seed WHEN 0 THEN 0.0 ELSE 359.4 END::DOUBLE AS turn, 4.0 + 2 * seed::DOUBLE AS allowed FROM (SELECT DISTINCT image_id FROM bd), (SELECT unnest([0, 1]) AS seed))"""


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = maps.boards(spark, sf_dir).select("image_id").distinct()
    array = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    second = F.col("seed") == 1
    h = F.when(second, array(1.02, 0.01, 11.5, -0.01, 0.99, 9.25, 0.0002, -0.0001, 1)).otherwise(array(1, 0, 12, 0, 1, 9, 0, 0, 1))
    rows = images.withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1))))
    return rows.select("*", h.alias("h"), F.lit(1.0).alias("s0"), F.lit(1.0).alias("s1"), F.when(second, 359.4).otherwise(0.0).alias("turn"), (4.0 + 2 * F.col("seed")).alias("allowed"), F.lit(5).alias("least_inliers"), F.lit(15.0).alias("distance"))


_ERROR = lambda y, x, my, mx: f"power((h[1] * {x} + h[2] * {y} + h[3]) / (h[7] * {x} + h[8] * {y} + h[9]) - {mx}, 2) + power((h[4] * {x} + h[5] * {y} + h[6]) / (h[7] * {x} + h[8] * {y} + h[9]) - {my}, 2) < allowed"
_DEGREES = lambda c: f"round((degrees({c}) % 360 + 360) % 360, 1)"
_INLIERS = f"""ev AS (SELECT mo.*, ma.* EXCLUDE (image_id), {_ERROR("y", "x", "my", "mx")} AS fw, {_ERROR("my", "mx", "y", "x")} AS bw FROM ma JOIN mo ON ma.image_id = mo.image_id),
tu AS (SELECT *, NOT fw AS reversed, (({_DEGREES("CASE WHEN fw THEN mtheta ELSE theta END")} - {_DEGREES("CASE WHEN fw THEN theta ELSE mtheta END")}) % 360 + 360) % 360 AS off FROM ev WHERE fw OR bw),
inl AS (SELECT image_id, seed, id, CASE WHEN fw THEN y ELSE my END AS y, CASE WHEN fw THEN x ELSE mx END AS x, CASE WHEN fw THEN my ELSE y END AS my, CASE WHEN fw THEN mx ELSE x END AS mx,
  CASE WHEN fw THEN scale ELSE mscale END AS scale, reversed FROM tu WHERE abs(off - turn) < 20 OR abs(360 - off - turn) < 20)"""


@query(
    f"""WITH {BOARD}, {_MATCHES}, {_MODELS}, {_INLIERS}, cn AS (SELECT image_id, count(*) AS n FROM ma GROUP BY image_id),
ct AS (SELECT image_id, seed, count(*) AS c, least(var_pop(y), var_pop(x), var_pop(my), var_pop(mx)) AS v, greatest(var_pop(abs(y - my)), var_pop(abs(x - mx))) AS d FROM inl GROUP BY ALL)
SELECT inl.image_id, seed, id, y, x, my, mx, reversed FROM inl JOIN ct USING (image_id, seed) JOIN cn USING (image_id) WHERE NOT (c < greatest(5, floor(n * 0.2::DOUBLE)) AND c < 6) AND NOT (c < 7 AND seed = 0 AND v < 25 AND d < 1)"""
)
def homography_inliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of an image that a homography explains either way round, with its turn, of models with enough of them that follow no edge."""
    matches, models = _matches(spark, sf_dir), _models(spark, sf_dir)
    inliers = H.model_inliers(matches, models)
    counted = matches.join(matches.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")), "image_id")
    sizes = _sizes(spark, sf_dir).withColumns({"check_edges": F.lit(True), "allowed": F.lit(4)})
    good = H.accepted_models(inliers, models, counted, sizes)
    return inliers.join(good.select(*H.MODEL), H.MODEL, "left_semi").select(*H.MODEL, "id", "y", "x", "my", "mx", "reversed")


@query(
    f"""WITH {BOARD}, {_MATCHES}, {_MODELS}, {_SIZES}, {_INLIERS},
ce AS (SELECT DISTINCT image_id, seed, y AS cy, x AS cx, CASE WHEN scale * 16 > 20 THEN 20 WHEN scale * 16 < 16 THEN 16 ELSE CAST(floor(scale * 16) AS INT) END AS r FROM inl),
di AS (SELECT DISTINCT ce.image_id, ce.seed, bd.y, bd.x FROM ce JOIN bd ON bd.image_id = ce.image_id AND (bd.y - cy) * (bd.y - cy) + (bd.x - cx) * (bd.x - cx) <= r * r),
ta AS (SELECT di.image_id, y, x, round_even((h[1] * x + h[2] * y + h[3]) / (h[7] * x + h[8] * y + h[9]), 0) AS tx, round_even((h[4] * x + h[5] * y + h[6]) / (h[7] * x + h[8] * y + h[9]), 0) AS ty FROM di JOIN mo ON mo.image_id = di.image_id AND mo.seed = di.seed),
so AS (SELECT a.image_id, a.y, a.x, avg(b.g) AS g FROM bd a JOIN bd b ON a.image_id = b.image_id AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL),
bo AS (SELECT DISTINCT ta.image_id, ta.y, ta.x, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx FROM ta JOIN so p ON p.image_id = ta.image_id AND p.y = ta.y AND p.x = ta.x JOIN so q ON q.image_id = ta.image_id AND q.y = ty AND q.x = tx WHERE abs(p.g - q.g) < 16)
SELECT image_id, y, x, 1 AS side FROM bo UNION SELECT image_id, ty, tx, 2 FROM bo"""
)
def homography_discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discs of 16 times the scale around the inliers, where the colours of both ends agree."""
    models = _models(spark, sf_dir)
    return H.grown_discs(maps.boards(spark, sf_dir), H.model_inliers(_matches(spark, sf_dir), models), models, _sizes(spark, sf_dir))


@query()
def cloned_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copied areas of boards in which a square was moved by 9 and 12, from seeds and local homographies to closed areas."""
    board = maps.boards(spark, sf_dir)
    moved = board.filter("y BETWEEN 4 AND 47 AND x BETWEEN 4 AND 47").select("image_id", (F.col("y") + 9).alias("y"), (F.col("x") + 12).alias("x"), F.col("g").alias("new"))
    forged = board.join(moved, XY, "left").select(*XY, F.coalesce("new", "g").alias("g"))
    sizes = _sizes(spark, sf_dir).withColumn("least_size", F.lit(400))  # for images of 64 x 64
    return H.verified(_matches(spark, sf_dir), forged, sizes)[1]


def _moved_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, height, width, values, known (null where all are): sheets at four times their size, softened by means of 3 x 3 twice, in which a square of 56 stands a second time, 66 down and 65 to the right."""
    prepare(spark)
    rows = maps.sheets(spark, sf_dir).select(*XY, "g")
    kind = dict(rows.dtypes)["image_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known, g = np.zeros((32, 32), dtype=bool), np.zeros((32, 32))
        at = (pdf["y"].to_numpy(), pdf["x"].to_numpy())
        known[at], g[at] = True, pdf["g"].to_numpy(dtype=float)
        known, g = (v.repeat(4, axis=0).repeat(4, axis=1) for v in (known, g))
        for _ in range(2):
            (g,) = H.means(known, g)
        source = np.zeros_like(known)
        source[4:60, 4:60] = known[4:60, 4:60]
        g = np.where(grids.shifted(source, 66, 65, False) & known, grids.shifted(g, 66, 65), g)
        h, w = (int(v.max()) + 1 for v in np.nonzero(known))
        known, g = known[:h, :w], g[:h, :w]
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[:1], "height": h, "width": w, "values": [g.ravel().tolist()], "known": [None if known.all() else known.ravel().tolist()]})

    return rows.groupBy("image_id").applyInPandas(run, f"image_id {kind}, height int, width int, values array<double>, known array<boolean>")


def _whole(sheets: DataFrame) -> DataFrame:
    return sheets.filter("known IS NULL").drop("known")  # the last sheet may be no rectangle


@query()
def keypoint_scale_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keypoints of sheets, with descriptors of 128 values."""
    return B.keypoints(_whole(_moved_sheets(spark, sf_dir)), 0.01)


@query()
def keypoint_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copied areas of sheets from the pixels alone: keypoints, pairs by their angles, local homographies, discs."""
    sheets = durable(_moved_sheets(spark, sf_dir), "sheets")
    whole = _whole(sheets)
    points = durable(B.keypoints(whole.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "image_id"), 0.01), "keypoints")
    pairs = M.bucketed_matches(points, "gray", 0.65, 40.0, "octave")
    # only whole sheets have keypoints
    images = whole.select("image_id", "width", F.posexplode("values").alias("pos", "g")).select("image_id", F.expr("cast(pos div width AS int)").alias("y"), F.expr("cast(pos % width AS int)").alias("x"), "g")
    sizes = H.settings(whole).withColumn("least_size", F.lit(500))
    return H.verified(H.matched(points, pairs), images, sizes)[1]


@query(
    f"""WITH {BOARD}, {_MATCHES}, me(method) AS (VALUES ('ownransac'), ('ransac'), ('lmeds'), ('pure'), ('goldstandard')),
t AS (SELECT ma.image_id, method, id, id % 6 <> 0 AS good FROM ma, me WHERE id % 4 <> 1 AND (method IN ('ownransac', 'ransac', 'lmeds') OR id % 6 <> 0)),
c AS (SELECT image_id, method, count(*) FILTER (good) AS inliers, count(*) AS matches FROM t GROUP BY ALL)
SELECT image_id, method, inliers, matches, [1.0, 0.0, 12.0, 0.0, 1.0, 9.0, 0.0, 0.0, 1.0]::DOUBLE[] AS transform FROM c"""
)
def robust_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of an image's matches by each method of five; the two that are not robust get no outliers."""
    m = _matches(spark, sf_dir).filter("id % 4 <> 1")
    kind = [V.estimate_transforms(m if method in ("ownransac", "ransac", "lmeds") else m.filter("id % 6 <> 0"), ["image_id"], method, 1.0) for method in estimators.METHODS]
    every = kind[0]
    for one in kind[1:]:
        every = every.unionByName(one)
    return every.withColumn("transform", F.transform("transform", lambda v: F.round(v, 5) + 0.0))
