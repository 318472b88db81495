"""Queries over block features, matching, verification, and the streaming report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import fields, grids
from palimpsest.functions.arrays import normalise, quantise
from palimpsest.functions.log_polar import samples
from palimpsest.operators import features as B
from palimpsest.operators import index as I
from palimpsest.operators import matching as M
from palimpsest.operators import search as S
from palimpsest.operators import verify as V
from palimpsest.operators.images import XY
from palimpsest.plans import maps
from palimpsest.plans.catalog import query
from palimpsest.plans.maps import GT, PX, SIDE
from palimpsest.plans.raster import _packed
from palimpsest.session import shared_folder, table

KEY = B.KEY
#: Blocks of 4 x 4 at step 2: bl(image_id, block_y, block_x, y, x, g).
BL = """bl AS (SELECT image_id, block_y, block_x, px.y - block_y AS y, px.x - block_x AS x, g FROM px JOIN (SELECT CAST(unnest(range(0, 5, 2)) AS INT) AS block_y) ON px.y BETWEEN block_y AND block_y + 3
  JOIN (SELECT CAST(unnest(range(0, 5, 2)) AS INT) AS block_x) ON px.x BETWEEN block_x AND block_x + 3)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.blocks(maps.pixels(spark, sf_dir), SIDE, SIDE, 4, 2)


def _rounded(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c not in keys])


_SHARE = lambda c: f"round(CASE WHEN sum(g) = 0 THEN 0.0 ELSE sum(CASE WHEN {c} THEN g ELSE 0 END)::DOUBLE / sum(g) END, 9)"


@query(f"WITH {PX}, {BL} SELECT image_id, block_y, block_x, round(avg(g), 9) AS f0, {_SHARE('y < 2')} AS f1, {_SHARE('x < 2')} AS f2, {_SHARE('x >= y')} AS f3, {_SHARE('x < 4 - y')} AS f4 FROM bl GROUP BY image_id, block_y, block_x")
def feat_luo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and half-block shares."""
    return _rounded(B.luo(_blocks(spark, sf_dir), 4), KEY, 9)


@query(
    f"""WITH {PX}, {BL}, q AS (SELECT image_id, block_y, block_x, avg(g) AS m, avg(g) FILTER (WHERE y < 2 AND x < 2) AS a, avg(g) FILTER (WHERE y < 2 AND x >= 2) AS b, avg(g) FILTER (WHERE y >= 2 AND x < 2) AS c, avg(g) FILTER (WHERE y >= 2 AND x >= 2) AS d FROM bl GROUP BY ALL),
r AS (SELECT *, least(a, b, c, d) - m AS lo, greatest(a, b, c, d) - m AS hi, a + b + c + d AS t FROM q)
SELECT image_id, block_y, block_x, floor(m) AS f0, {", ".join(f"CASE WHEN t = 0 THEN 0.0 ELSE floor({v} / t * 255) END AS f{i + 1}" for i, v in enumerate("abcd"))},
{", ".join(f"CASE WHEN hi = lo THEN 0.0 ELSE floor(({v} - m - lo) * 255 / (hi - lo)) END AS f{i + 5}" for i, v in enumerate("abcd"))} FROM r"""
)
def feat_lin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole mean, quarter shares and rescaled differences."""
    return B.lin(_blocks(spark, sf_dir), 4)


_R2 = "(y - 1.5) * (y - 1.5) + (x - 1.5) * (x - 1.5)"


@query(f"WITH {PX}, {BL} SELECT image_id, block_y, block_x, round(avg(g) FILTER (WHERE {_R2} <= 1), 6) AS f0, round(avg(g) FILTER (WHERE {_R2} <= 4), 6) AS f1 FROM bl GROUP BY image_id, block_y, block_x")
def feat_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disc means."""
    return _rounded(B.circle(_blocks(spark, sf_dir), 4), KEY)


@query(
    f"""WITH {PX}, {BL}, h AS (SELECT image_id, block_y, block_x, g // 8 AS bin, count(*) AS n FROM bl GROUP BY ALL), e AS (SELECT image_id, block_y, block_x, sum(-(n / 16.0::DOUBLE) * log2(n / 16.0::DOUBLE)) AS f1 FROM h GROUP BY ALL),
m AS (SELECT image_id, block_y, block_x, avg(g) AS f0 FROM bl WHERE {_R2} <= 4 GROUP BY ALL) SELECT image_id, block_y, block_x, round(f0, 6) AS f0, round(f1, 6) AS f1 FROM m JOIN e USING (image_id, block_y, block_x)"""
)
def feat_bravo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disc mean and entropy."""
    return _rounded(B.bravo(_blocks(spark, sf_dir), 4), KEY)


@query(
    f"""WITH {PX}, {BL}, s AS (SELECT image_id, block_y, block_x, sum(g)::DOUBLE AS m, sum(g * x)::DOUBLE AS mx, sum(g * y)::DOUBLE AS my, sum(g * x * x)::DOUBLE AS xx, sum(g * y * y)::DOUBLE AS yy, sum(g * x * y)::DOUBLE AS xy FROM bl GROUP BY ALL),
n AS (SELECT *, (xx - mx / m * mx) / (m * m) AS a, (yy - my / m * my) / (m * m) AS b, (xy - mx / m * my) / (m * m) AS c FROM s)
SELECT image_id, block_y, block_x, round((a + b) * 1000, 6) AS f0, round(((a - b) * (a - b) + 4 * c * c) * 1000, 6) AS f1 FROM n"""
)
def feat_hu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two invariant moments, in thousandths."""
    return _rounded(B.hu(_blocks(spark, sf_dir), 2).select(*KEY, (F.col("f0") * 1000).alias("f0"), (F.col("f1") * 1000).alias("f1")), KEY)


_ZB = ", ".join(f"({y}, {x}, {n}, {m}, {re!r}::DOUBLE, {im!r}::DOUBLE)" for y, x, n, m, re, im in B.zernike_basis(4, 3))


@query(
    f"""WITH {PX}, {BL}, zb(y, x, n, m, re, im) AS (VALUES {_ZB}), s AS (SELECT image_id, block_y, block_x, n, m, sum(g * re) AS re, sum(g * im) AS im FROM bl JOIN zb USING (y, x) GROUP BY ALL)
SELECT image_id, block_y, block_x, n, m, round(sqrt(re * re + im * im), 6) AS magnitude FROM s"""
)
def feat_zernike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moment magnitudes by a basis table."""
    return _rounded(B.zernike(_blocks(spark, sf_dir), 4, 3), [*KEY, "n", "m"])


_DB = ", ".join(f"({y}, {x}, {u}, {v}, {w!r}::DOUBLE)" for y, x, u, v, w in B.dct_basis(4))


@query(f"WITH {PX}, {BL}, db(y, x, u, v, w) AS (VALUES {_DB}), s AS (SELECT image_id, block_y, block_x, u, v, sum(g * w) AS c FROM bl JOIN db USING (y, x) GROUP BY ALL) SELECT image_id, block_y, block_x, u, v, CAST(floor(c / (17.3 * (1 + u + v)) + 0.5) AS BIGINT) AS q FROM s")
def feat_dct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised cosine coefficients."""
    return B.dct(_blocks(spark, sf_dir), 4, 17.3)


@query()
def feat_svd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singular values."""
    return B.block_vectors(_packed(spark, sf_dir), "SVD", 4, 2)


@query()
def feat_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: blur-invariant moments."""
    return B.block_vectors(_packed(spark, sf_dir), "BLUR", 4, 2)


@query()
def feat_fmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-polar spectrum sums."""
    return B.block_vectors(_packed(spark, sf_dir), "FMT", 8, 1)


@query()
def feat_dwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wavelet bands, coarse first."""
    return B.block_vectors(_packed(spark, sf_dir), "DWTFEAT", 4, 2)


@query()
def feat_dsift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense gradient-orientation histograms."""
    return B.block_vectors(_packed(spark, sf_dir), "DSIFT", 4, 2)


@query()
def feat_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal axes of raw blocks, as many as keep 99 % of the variance."""
    return B.reduce_by_pca(B.block_vectors(_packed(spark, sf_dir), "NO", 4, 2), 16)


@query()
def feat_kpca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel principal components on 144 training blocks."""
    return B.reduce_by_kernel_pca(B.block_vectors(_packed(spark, sf_dir), "NO", 4, 4), KEY, 144, 8, 200.0)


@query(
    """WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM n)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / l * x / l)), 6) AS unit, CAST(list_sum(list_transform(v[1:8], lambda x: floor(abs(x) / 0.05))) AS BIGINT) AS steps FROM s"""
)
def feature_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised and quantised vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    q = F.slice(quantise("v", 0, 8, 0.05, absolute=True, after=True), 1, 8)
    return e.select("vec_id", F.round(total(F.transform(normalise("v"), lambda x: x * x)), 6).alias("unit"), total(q).cast("long").alias("steps"))


@query(
    f"""WITH {PX}, {BL}, f AS (SELECT image_id, block_y AS y, block_x AS x, block_y * 8 + block_x AS id, CAST(floor(avg(g)) AS INT) AS f0, sum(CASE WHEN y < 2 THEN g ELSE 0 END) AS f1 FROM bl GROUP BY image_id, block_y, block_x),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY f0, f1, id) AS n FROM f)
SELECT a.image_id, a.id AS a, b.id AS b FROM r a JOIN r b ON a.image_id = b.image_id AND b.n - a.n BETWEEN 1 AND 2 WHERE (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) >= 9 AND abs(a.f0 - b.f0) <= 6"""
)
def lexi_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours in the order of the features that are far apart in the image."""
    half = F.sum(F.when(F.col("y") < 2, F.col("g")).otherwise(0)).alias("f1")
    f = _blocks(spark, sf_dir).groupBy(*KEY).agg(F.floor(F.avg("g")).alias("f0"), half).select("image_id", F.col("block_y").alias("y"), F.col("block_x").alias("x"), (F.col("block_y") * 8 + F.col("block_x")).alias("id"), "f0", "f1")
    pairs = M.accepted(M.lexicographic(f, ["f0", "f1"], 2), [M.far_enough(3.0)], [F.abs(F.col("a.f0") - F.col("b.f0")) <= 6])
    return pairs.select("image_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def _neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return M.nearest(vectors, k, across_images=True)


_KNN = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT p.id, q.id AS other, round(list_distance(p.v, q.v), 9) AS distance FROM v p JOIN v q ON p.id <> q.id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM d),
k AS (SELECT *, lead(distance) OVER (PARTITION BY id ORDER BY rank) AS next FROM n WHERE rank <= 5)"""


@query(f"WITH {_KNN} SELECT id, other, round(distance, 6) AS distance, rank FROM k")
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each, exact, in blocks."""
    return _neighbours(spark, sf_dir, 5).select("id", "other", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query()
def knn_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the five nearest vectors of each, by a forest."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return I.approximate_nearest(vectors, 5, trees=12)


@query(f"WITH {_KNN}, t AS (SELECT *, coalesce(distance <= 0.98 * next, FALSE) AS ok FROM k), r AS (SELECT *, bool_and(ok) OVER (PARTITION BY id ORDER BY rank) AS run FROM t) SELECT id, other, rank FROM r WHERE run")
def knn_ratio_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours before the first small step in distance."""
    return M.ratio_matches(_neighbours(spark, sf_dir, 5), 0.98).select("id", "other", F.col("rank").cast("long").alias("rank"))


@query()
def knn_tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio limit moves until there are enough matches."""
    limit, found = M.tuned_ratio(_neighbours(spark, sf_dir, 5), 0.8, top=0.94)
    return found.withColumn("limit", F.lit(limit))


def _block_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = B.block_vectors(_packed(spark, sf_dir), "NO", 4, 4).select("image_id", F.struct((F.col("block_y") * 8 + F.col("block_x")).alias("id"), F.col("block_y").alias("y"), F.col("block_x").alias("x"), "vec").alias("p"))
    return raw.select("image_id", F.col("p").alias("a")).join(raw.select("image_id", F.col("p").alias("b")), "image_id").filter("a.id < b.id")


@query(f"WITH {PX}, b AS (SELECT image_id, y // 4 * 32 + x // 4 * 4 AS id, array_agg(g ORDER BY y, x) AS v FROM px GROUP BY ALL) SELECT p.image_id, p.id AS a, q.id AS b FROM b p JOIN b q ON p.image_id = q.image_id AND p.id < q.id WHERE list_distance(list_transform(p.v, lambda t: CAST(t AS DOUBLE)), list_transform(q.v, lambda t: CAST(t AS DOUBLE))) <= 75")
def euclidean_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block pairs by distance."""
    return _block_pairs(spark, sf_dir).filter(M.within(75.0)).select("image_id", F.col("a.id").cast("long").alias("a"), F.col("b.id").cast("long").alias("b"))


_LP = samples(4, 4, 8, True)
_LW = ", ".join(f"({p // 4}, {p % 4}, {r}, {int((_LP[:, r] == p).sum())})" for r in range(8) for p in range(16) if (_LP[:, r] == p).any())
_WAVE = lambda f: f"sum(v * {f}(2 * pi() * r * k / 8))"


@query(
    f"""WITH {PX}, lw(y, x, r, n) AS (VALUES {_LW}), b AS (SELECT image_id, y // 4 * 32 + x // 4 * 4 AS id, y % 4 AS y, x % 4 AS x, g FROM px),
p AS (SELECT image_id, id, r, CAST(sum(g * n) AS DOUBLE) AS v FROM b JOIN lw USING (y, x) GROUP BY ALL),
f AS (SELECT image_id, id, k, sqrt({_WAVE("cos")} * {_WAVE("cos")} + {_WAVE("sin")} * {_WAVE("sin")}) AS m FROM p, (SELECT unnest(range(5)) AS k) GROUP BY image_id, id, k),
c AS (SELECT p.image_id, p.id AS a, q.id AS b, sum(p.m * q.m) / sqrt(sum(p.m * p.m) * sum(q.m * q.m)) AS value FROM f p JOIN f q ON p.image_id = q.image_id AND p.k = q.k AND p.id < q.id GROUP BY ALL)
SELECT image_id, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, round(value, 6) AS value FROM c WHERE value >= 0.5"""
)
def profile_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of blocks by the spectra of their log-polar profiles."""
    found = M.block_criterion(_block_pairs(spark, sf_dir), "CORREL", 0.5, 4)
    return found.select("image_id", F.col("a.id").cast("long").alias("a"), F.col("b.id").cast("long").alias("b"), F.round("value", 6).alias("value"))


@query()
def block_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component limits, phase peaks and correlation of log-polar profiles' spectra of block pairs."""
    pairs = _block_pairs(spark, sf_dir).filter(M.componentwise([120.0] * 16))
    phase = M.block_criterion(pairs, "CPS", 0.35, 4).withColumn("criterion", F.lit("phase"))
    spectrum = M.block_criterion(pairs, "CORREL", 0.9, 4).withColumn("criterion", F.lit("spectrum"))
    return phase.unionByName(spectrum).select("image_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"), "criterion", F.round("value", 6).alias("value"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten points in each of 50 images: vectors by label, places by their values."""
    e = table(spark, sf_dir, "embeddings")
    return e.select((F.col("vec_id") % 50).alias("image_id"), F.col("vec_id").alias("id"), F.floor(F.abs(F.col("embedding")[0]) * 400).cast("int").alias("y"), F.floor(F.abs(F.col("embedding")[1]) * 400).cast("int").alias("x"), (F.floor(F.abs(F.col("embedding")[2]) * 400) % 256).cast("int").alias("gray"), F.transform("embedding", lambda v: v.cast("double")).alias("vec"), F.col("label").alias("segment"))


_POINTS = """pts AS (SELECT vec_id % 50 AS image_id, vec_id AS id, CAST(floor(abs(embedding[1]) * 400) AS INT) AS y, CAST(floor(abs(embedding[2]) * 400) AS INT) AS x, list_transform(embedding, lambda t: CAST(t AS DOUBLE)) AS v FROM embeddings)"""


@query(
    f"""WITH {_POINTS}, d AS (SELECT p.image_id, p.id AS a, q.id AS b, acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, list_dot_product(p.v, q.v)))) AS angle, (p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x) AS gap FROM pts p JOIN pts q ON p.image_id = q.image_id AND p.id <> q.id),
r AS (SELECT *, row_number() OVER w AS n, lead(angle) OVER w AS next FROM d WINDOW w AS (PARTITION BY image_id, a ORDER BY angle, b))
SELECT DISTINCT image_id, least(a, b) AS a, greatest(a, b) AS b FROM r WHERE n = 1 AND angle < 0.98 * next AND gap >= 4"""
)
def keypoint_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs by an angle ratio; images of this size have one octave and no neighbours to find, and so few points one gray bucket."""
    return M.bucketed_matches(_points(spark, sf_dir), "gray", 0.98, 2.0)


@query()
def segment_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment pairs with enough matches."""
    return M.segment_matches(_points(spark, sf_dir), 0.97)


@query()
def patchmatch_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense field of the squares of each image in itself, filtered: by the residual that the published detector allows a pixel (300 for a disc of radius 6), and by a displacement beyond the field's own least."""
    field = M.dense_field(_packed(spark, sf_dir), 3, 2)
    residual = 300.0 * len(grids.disc(1)) / len(grids.disc(6))
    return V.least_displacement(V.affine_residual(field, 1, residual), 9.0)


_ZF = ", ".join(f"({i}, {y - 2}, {x - 2}, {v.real!r}::DOUBLE, {v.imag!r}::DOUBLE)" for i, f in enumerate(fields.zernike_filters(2, 5).tolist()) for y, line in enumerate(f) for x, v in enumerate(line))


@query(
    f"""WITH {PX}, zf(n, dy, dx, re, im) AS (VALUES {_ZF}), s AS (SELECT c.image_id, c.y, c.x, n, sum(p.g * re) AS re, sum(p.g * im) AS im FROM px c, zf JOIN px p ON p.image_id = c.image_id AND p.y = c.y + dy AND p.x = c.x + dx GROUP BY ALL)
SELECT image_id, y, x, n, CAST(floor(sqrt(re * re + im * im) * 100 + 0.5) AS BIGINT) AS hundredths FROM s"""
)
def dense_zernike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve Zernike magnitudes of the disc around every pixel, by a filter bank."""
    rows = M.dense_vectors(_packed(spark, sf_dir), 2, 5).select(*XY, F.posexplode("vec").alias("n", "v"))
    return rows.select(*XY, "n", F.floor(F.col("v") * 100 + 0.5).alias("hundredths"))


@query()
def dense_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copied areas of boards in which a square was moved by 20 and 23: Zernike field, median displacements, affine residual, least displacement, least size, both sides, dilated."""
    board = maps.boards(spark, sf_dir)
    moved = board.filter("y BETWEEN 4 AND 33 AND x BETWEEN 4 AND 33").select("image_id", (F.col("y") + 20).alias("y"), (F.col("x") + 23).alias("x"), F.col("g").alias("new"))
    forged = board.join(moved, XY, "left").select(*XY, F.coalesce("new", "g").alias("g"))
    packed = forged.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "g"))), lambda s: s["g"].cast("double")).alias("values"))
    packed = packed.select("image_id", F.lit(64).alias("height"), F.lit(64).alias("width"), "values")
    return V.dense_areas(M.dense_field(packed, 5, 12.0, descriptor="ZERNIKE"), 64, 64, least_size=60, residual=30.0, displacement=12.0, reach=2)


_DISC = ", ".join(f"({oy}, {ox})" for oy, ox in grids.disc(2))


@query(
    f"""WITH {PX}, f AS (SELECT image_id, y, x, CASE WHEN g > 150 THEN 3 ELSE 2 END AS a, CAST(3 + (image_id % 3) * (y // 4) AS INT) AS b FROM px WHERE (y * 8 + x) % 7 <> 0),
o(p, q) AS (VALUES {_DISC}),
s AS (SELECT c.image_id, c.y, c.x, c.a AS oa, c.b AS ob, CAST(count(*) AS DOUBLE) AS n, CAST(sum(p) AS DOUBLE) AS p, CAST(sum(q) AS DOUBLE) AS q, CAST(sum(f.a) AS DOUBLE) AS a, CAST(sum(f.b) AS DOUBLE) AS b,
  CAST(sum(p * p) AS DOUBLE) AS pp, CAST(sum(q * q) AS DOUBLE) AS qq, CAST(sum(p * q) AS DOUBLE) AS pq, CAST(sum(p * f.a) AS DOUBLE) AS pa, CAST(sum(q * f.a) AS DOUBLE) AS qa, CAST(sum(p * f.b) AS DOUBLE) AS pb, CAST(sum(q * f.b) AS DOUBLE) AS qb,
  CAST(sum(f.a * f.a) AS DOUBLE) AS aa, CAST(sum(f.b * f.b) AS DOUBLE) AS bb
  FROM f c, o, f WHERE f.image_id = c.image_id AND f.y = c.y + p AND f.x = c.x + q GROUP BY ALL),
m AS (SELECT *, n * pp - p * p AS spp, n * qq - q * q AS sqq, n * pq - p * q AS spq, n * pa - p * a AS spa, n * qa - q * a AS sqa, n * pb - p * b AS spb, n * qb - q * b AS sqb, n * aa - a * a AS saa, n * bb - b * b AS sbb FROM s),
e AS (SELECT *, CASE WHEN spp * sqq - spq * spq > 0 THEN greatest((saa - (spa * spa * sqq - 2 * spa * sqa * spq + sqa * sqa * spp) / (spp * sqq - spq * spq)) / n, 0)
    + greatest((sbb - (spb * spb * sqq - 2 * spb * sqb * spq + sqb * sqb * spp) / (spp * sqq - spq * spq)) / n, 0) END AS error FROM m)
SELECT image_id, y, x, y + oa AS my, x + ob AS mx, CAST(floor(error * 1000 + 0.5) AS BIGINT) AS thousandths FROM e WHERE error < 1.25"""
)
def affine_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a field with holes whose neighbours' displacements follow one affine map."""
    px = maps.pixels(spark, sf_dir).filter("(y * 8 + x) % 7 <> 0")
    field = px.select(*XY, F.expr("y + CASE WHEN g > 150 THEN 3 ELSE 2 END").alias("my"), F.expr("cast(x + 3 + (image_id % 3) * (y div 4) AS int)").alias("mx"))
    return V.affine_residual(field, 2, 1.25).select(*XY, "my", "mx", F.floor(F.col("error") * 1000 + 0.5).alias("thousandths"))


@query(
    f"""WITH {PX}, s AS (SELECT image_id AS id, y - 2 AS y, x - 3 AS x, g FROM px WHERE y BETWEEN 2 AND 4 AND x BETWEEN 3 AND 5),
c AS (SELECT s.id AS snippet_id, p.image_id, p.y - s.y AS oy, p.x - s.x AS ox, sum(abs(p.g - s.g)) AS score, count(*) AS n FROM s JOIN px p ON p.image_id = s.id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY snippet_id ORDER BY score, oy, ox) AS rank FROM c WHERE n = 9)
SELECT snippet_id, image_id, oy, ox, CAST(score AS BIGINT) AS score, rank FROM r WHERE rank <= 6"""
)
def snippet_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best places of a snippet in its image."""
    px = maps.pixels(spark, sf_dir).select(*XY, "g")
    cut = px.filter("y BETWEEN 2 AND 4 AND x BETWEEN 3 AND 5").select(F.col("image_id").alias("snippet_id"), "image_id", (F.col("y") - 2).alias("y"), (F.col("x") - 3).alias("x"), "g")
    return S.search(px, cut, kind="absolute").withColumns({"score": F.col("score").cast("long"), "rank": F.col("rank").cast("long")})


_TEXT = """w AS (SELECT 'item ' || item_id AS image_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark UNION ALL SELECT 'turn ' || conv_id || ' ' || turn, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') FROM conversations),
b AS (SELECT image_id, CAST(unnest(range(1, len(w))) AS INT) AS position, w FROM w WHERE len(w) >= 2),
blocks AS (SELECT image_id, position, w[position] || ' ' || w[position + 1] AS block FROM b),
m AS (SELECT p.image_id, p.position AS x, q.position AS mx FROM blocks p JOIN blocks q ON p.image_id = q.image_id AND p.block = q.block AND p.position < q.position)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items and all turns, each source with image ids of its own."""
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("image_id"), "text")
    return items.unionByName(table(spark, sf_dir, "conversations").select(F.concat_ws(" ", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("image_id"), "text"))


def _text_matches(t: DataFrame) -> DataFrame:
    """Equal word pairs of one text, at two places: matches in a one-dimensional image."""
    b = M.blocks_of_text(t, "image_id", "text", 2)
    pairs = b.select("image_id", F.col("position").alias("x"), "block").join(b.select("image_id", F.col("position").alias("mx"), "block"), ["image_id", "block"]).filter("x < mx")
    return pairs.select("image_id", F.lit(0).alias("y"), "x", F.lit(0).alias("my"), "mx")


@query(f"WITH {_TEXT}, v AS (SELECT image_id, mx - x AS dx, count(*) AS votes FROM m GROUP BY ALL) SELECT image_id, x, mx, dx, votes FROM m JOIN v USING (image_id) WHERE dx = mx - x AND votes >= 2")
def shift_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of all items and turns whose shift others share."""
    return V.vote(_text_matches(_texts(spark, sf_dir)), 2).select("image_id", "x", "mx", "dx", "votes")


@query(f"WITH {_TEXT}, v AS (SELECT image_id, mx - x AS dx, count(*) AS votes FROM m GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY votes DESC) AS r FROM v), k AS (SELECT image_id, x, mx FROM m JOIN r USING (image_id) WHERE dx = mx - x AND r = 1) SELECT DISTINCT image_id, x + 1 AS x FROM (SELECT image_id, x FROM k UNION ALL SELECT image_id, mx FROM k)")
def shift_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y2: both ends of the matches of the most frequent shifts, of all items and turns."""
    return V.mark_endpoints(V.vote(_text_matches(_texts(spark, sf_dir)), most_counts=1), 1).select("image_id", "x")


@query(
    f"""WITH RECURSIVE {_TEXT}, p AS (SELECT DISTINCT image_id, x FROM (SELECT image_id, x FROM m UNION ALL SELECT image_id, mx FROM m)),
runs AS (SELECT image_id, x, min(x) OVER (PARTITION BY image_id, x - n) AS c FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x) AS n FROM p)),
e AS (SELECT DISTINCT m.image_id, s.c AS a, t.c AS b FROM m JOIN runs s ON s.image_id = m.image_id AND s.x = m.x JOIN runs t ON t.image_id = m.image_id AND t.x = m.mx WHERE s.c <> t.c),
step AS (SELECT image_id, a, b FROM e UNION SELECT image_id, b, a FROM e),
reach AS (SELECT image_id, a, b FROM step UNION SELECT r.image_id, r.a, s.b FROM reach r JOIN step s ON s.image_id = r.image_id AND s.a = r.b),
least AS (SELECT image_id, a AS c, least(a, min(b)) AS component FROM reach GROUP BY image_id, a)
SELECT image_id, 0 AS y, x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY component) AS INT) AS label FROM runs JOIN least USING (image_id, c)"""
)
def copy_regions_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas that matches join share a label."""
    matches = _text_matches(_texts(spark, sf_dir))
    return V.shared_labels(V.symmetric(matches), matches)


@query(
    """WITH RECURSIVE p AS (SELECT vec_id % 50 AS image_id, vec_id AS id, CAST(floor(abs(embedding[1]) * 400) AS INT) AS y, CAST(floor(abs(embedding[2]) * 400) AS INT) AS x FROM embeddings),
e AS (SELECT a.image_id, a.id AS a, b.id AS b FROM p a JOIN p b ON a.image_id = b.image_id AND a.id <> b.id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 400),
r AS (SELECT image_id, id AS a, id AS b FROM p UNION SELECT r.image_id, r.a, e.b FROM r JOIN e ON e.image_id = r.image_id AND e.a = r.b)
SELECT image_id, a AS id, min(b) AS cluster FROM r GROUP BY image_id, a"""
)
def cluster_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single linkage as components of near points."""
    return V.single_linkage(_points(spark, sf_dir), 20.0)


@query()
def cluster_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward linkage, and the matches that link clusters."""
    return V.ward_linkage(_points(spark, sf_dir), 25.0)


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    noise = F.when(F.col("id") % 5 == 0, 37).otherwise(0)
    return p.select("image_id", "id", "y", "x", (F.col("y") + 7 + noise).alias("my"), (F.col("x") + 3 - noise).alias("mx"))


@query()
def ransac_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transform that most matches of an image follow, of a plausible scale."""
    return V.fit_transforms(_moved(spark, sf_dir), ["image_id"]).filter(V.plausible())


@query()
def fastsats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms grown from close pairs."""
    return V.grow_transforms(_moved(spark, sf_dir), ["image_id"], 60.0)


@query()
def merged_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms that agree."""
    grown = V.grow_transforms(_moved(spark, sf_dir), ["image_id"], 60.0)
    return V.merge_transforms(grown.select("image_id", F.col("number").alias("id"), "transform"))


@query(
    f"""WITH {PX}, o AS (SELECT * FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)), m AS (SELECT image_id, y, x, y + 2 AS my, x + 3 AS mx FROM px WHERE y < 6 AND x < 5 AND v > 0.1),
c AS (SELECT m.image_id, m.y, m.x, p.g AS p, q.g AS q FROM m, o JOIN px p ON p.image_id = m.image_id AND p.y = m.y + dy AND p.x = m.x + dx JOIN px q ON q.image_id = m.image_id AND q.y = m.my + dy AND q.x = m.mx + dx),
s AS (SELECT image_id, y, x, covar_pop(p, q) AS c, var_pop(p) AS vp, var_pop(q) AS vq FROM c GROUP BY ALL)
SELECT image_id, y, x, round(CASE WHEN vp > 1e-9 AND vq > 1e-9 THEN c / sqrt(vp * vq) ELSE 0.0 END, 6) AS ncc FROM s"""
)
def correlation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-mean correlation around both ends of a match."""
    px = maps.pixels(spark, sf_dir)
    m = px.filter("y < 6 AND x < 5 AND v > 0.1").select(*XY, (F.col("y") + 2).alias("my"), (F.col("x") + 3).alias("mx"))
    return V.correlation_map(px, m, 1).select(*XY, F.round("ncc", 6).alias("ncc"))


@query(
    f"""WITH RECURSIVE {PX}, {GT}, step AS (SELECT a.image_id, a.y * 1048576 + a.x AS p, b.y * 1048576 + b.x AS q FROM gt a JOIN gt b ON a.image_id = b.image_id AND greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1),
reach AS (SELECT image_id, y * 1048576 + x AS p, y * 1048576 + x AS q FROM gt UNION SELECT r.image_id, r.p, s.q FROM reach r JOIN step s ON s.image_id = r.image_id AND s.p = r.q),
comp AS (SELECT image_id, CAST(p // 1048576 AS INT) AS y, CAST(p % 1048576 AS INT) AS x, CAST(min(q) AS BIGINT) AS component FROM reach GROUP BY image_id, p),
big AS (SELECT image_id, component FROM comp GROUP BY ALL HAVING count(*) >= 2),
held AS (SELECT DISTINCT p.image_id, p.component FROM comp p JOIN comp q ON q.image_id = p.image_id AND (q.y = p.y + 2 AND q.x = p.x + 3 OR q.y = p.y - 2 AND q.x = p.x - 3))
SELECT image_id, y, x, component FROM comp JOIN big USING (image_id, component) JOIN held USING (image_id, component)"""
)
def area_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas that are large, matched, and matched to a marked place."""
    gt = maps.truth(spark, sf_dir).select(*XY)
    m = gt.select(*XY, (F.col("y") + 2).alias("my"), (F.col("x") + 3).alias("mx"))
    return V.area_rules(gt, m, 2).select(*XY, "component")


@query(
    f"""WITH RECURSIVE {PX}, gt AS MATERIALIZED (SELECT image_id, y, x FROM px WHERE v > 0.12), step AS MATERIALIZED (SELECT a.image_id, a.y * 1048576 + a.x AS p, b.y * 1048576 + b.x AS q FROM gt a JOIN gt b ON a.image_id = b.image_id AND greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1),
reach AS (SELECT image_id, y * 1048576 + x AS p, y * 1048576 + x AS q FROM gt UNION SELECT r.image_id, r.p, s.q FROM reach r JOIN step s ON s.image_id = r.image_id AND s.p = r.q),
comp AS MATERIALIZED (SELECT image_id, CAST(p // 1048576 AS INT) AS y, CAST(p % 1048576 AS INT) AS x, CAST(min(q) AS BIGINT) AS component FROM reach GROUP BY image_id, p),
an AS (SELECT a.image_id, a.component, a.y, a.x, atan2(b.y - a.y, b.x - a.x) AS t FROM comp a JOIN comp b ON a.image_id = b.image_id AND a.component = b.component AND (a.y, a.x) <> (b.y, b.x)),
ga AS (SELECT *, coalesce(lead(t) OVER w, first_value(t) OVER w + 2 * pi()) - t AS gap FROM an WINDOW w AS (PARTITION BY image_id, component, y, x ORDER BY t)),
ve AS (SELECT image_id, component, y, x FROM ga GROUP BY ALL HAVING max(gap) > pi() + 1e-9)
SELECT * FROM ve UNION ALL SELECT image_id, any_value(component), any_value(y), any_value(x) FROM comp GROUP BY image_id, component HAVING count(*) = 1"""
)
def area_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the convex hull of each marked area."""
    marked = maps.pixels(spark, sf_dir).filter("v > 0.12")
    return V.outlines(marked).filter("kind = 'hull'").select("image_id", "component", "y", "x")


@query()
def area_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer borders of each marked area, in order."""
    return V.outlines(maps.pixels(spark, sf_dir).filter("v > 0.12")).filter("kind = 'contour'")


@query(f"WITH {PX}, {GT}, m AS (SELECT image_id, y, x, y + 2 AS my, x + 1 AS mx FROM px WHERE v > 0.05) SELECT m.image_id, count(*) AS pairs, count(*) FILTER (WHERE a.y IS NOT NULL AND b.y IS NOT NULL) AS both FROM m LEFT JOIN gt a ON a.image_id = m.image_id AND a.y = m.y AND a.x = m.x LEFT JOIN gt b ON b.image_id = m.image_id AND b.y = m.my AND b.x = m.mx GROUP BY m.image_id")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches, and those with both ends in the ground truth."""
    m = maps.pixels(spark, sf_dir).filter("v > 0.05").select(*XY, (F.col("y") + 2).alias("my"), (F.col("x") + 1).alias("mx"))
    return V.pair_counts(m, maps.truth(spark, sf_dir))


@query(f"WITH {PX}, m AS (SELECT image_id, y, x, y + x % 3 AS my, x + y % 4 AS mx FROM px WHERE v > 0.1), k AS (SELECT * FROM m WHERE (my - y) * (my - y) + (mx - x) * (mx - x) >= 4) SELECT DISTINCT image_id, y, x FROM (SELECT image_id, y, x FROM k UNION ALL SELECT image_id, my, mx FROM k)")
def field_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least displacement, and symmetry."""
    m = maps.pixels(spark, sf_dir).filter("v > 0.1").select(*XY, (F.col("y") + F.col("x") % 3).alias("my"), (F.col("x") + F.col("y") % 4).alias("mx"))
    return V.symmetric(V.least_displacement(m, 4.0))


@query(
    f"""WITH {_POINTS}, m AS (SELECT image_id, id, y, x, CASE WHEN id % 5 = 0 THEN 37 ELSE 0 END AS noise, CAST(id * 37 % 360 AS DOUBLE) AS theta_a, 30 + CASE WHEN id % 5 = 0 THEN 90 ELSE id % 3 END AS turn FROM pts),
a AS (SELECT image_id, degrees(atan2(avg(sin(radians(turn))), avg(cos(radians(turn))))) AS mean FROM m GROUP BY image_id),
o AS (SELECT m.*, ((turn - mean) % 360 + 360) % 360 AS off FROM m JOIN a USING (image_id))
SELECT image_id, id, y, x, y + 7 + noise AS my, x + 3 - noise AS mx, theta_a, theta_a + turn AS theta_b, 0.01::DOUBLE AS contrast, 25 AS clone FROM o WHERE least(off, 360 - off) <= 15"""
)
def keypoint_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a common turn, with settings by image size."""
    m = _moved(spark, sf_dir).withColumns({"theta_a": F.pmod(F.col("id") * 37, F.lit(360)).cast("double")})
    m = m.withColumn("theta_b", F.col("theta_a") + 30 + F.when(F.col("id") % 5 == 0, 90).otherwise(F.col("id") % 3))
    return V.orientation_consistent(m, 15.0).select("*", *V.detector_settings(F.lit(500), F.lit(900)))


@query(
    f"""WITH {PX}, t AS (SELECT image_id, y // 2 AS ty, x // 2 AS tx, avg(g) AS mean FROM px GROUP BY ALL), s AS (SELECT * FROM t WHERE mean > 135)
SELECT image_id, CAST(ty * 4 + tx AS INT) AS segment FROM s UNION SELECT b.image_id, CAST(b.ty * 4 + b.tx AS INT) FROM s a JOIN t b ON a.image_id = b.image_id AND greatest(abs(a.ty - b.ty), abs(a.tx - b.tx)) = 1 AND abs(a.mean - b.mean) <= 15"""
)
def grown_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched segments with their near-coloured neighbours; tiles stand for segments."""
    px = maps.pixels(spark, sf_dir).withColumn("segment", F.expr("cast(y div 2 * 4 + x div 2 AS int)"))
    means = px.groupBy("image_id", "segment").agg(F.avg("g").alias("mean"))
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in grids.EIGHT]))
    at = means.select("image_id", F.col("segment").alias("a"), steps.alias("s")).withColumns({"ty": F.expr("a div 4 + s.dy"), "tx": F.expr("a % 4 + s.dx")})
    near = at.filter("ty BETWEEN 0 AND 3 AND tx BETWEEN 0 AND 3").select("image_id", "a", F.expr("cast(ty * 4 + tx AS int)").alias("b"))
    return V.grow_segments(means, near, means.filter("mean > 135").select("image_id", "segment"))


@query(
    """WITH RECURSIVE p AS (SELECT vec_id % 50 AS image_id, vec_id AS id, CAST(floor(abs(embedding[1]) * 400) AS INT) AS y, CAST(floor(abs(embedding[2]) * 400) AS INT) AS x FROM embeddings),
e AS (SELECT a.image_id, a.id AS a, b.id AS b FROM p a JOIN p b ON a.image_id = b.image_id AND a.id <> b.id AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 400),
r AS (SELECT image_id, id AS a, id AS b FROM p UNION SELECT r.image_id, r.a, e.b FROM r JOIN e ON e.image_id = r.image_id AND e.a = r.b),
c AS (SELECT image_id, a AS id, min(b) AS cluster FROM r GROUP BY image_id, a),
l AS (SELECT s.image_id, s.id AS a, t.id AS b, s.cluster AS ca, t.cluster AS cb FROM c s JOIN c t ON t.image_id = s.image_id AND t.id IN (s.id + 50, s.id + 100))
SELECT image_id, a, b, ca, cb FROM (SELECT *, count(*) OVER (PARTITION BY image_id, ca, cb) AS n FROM l) WHERE n >= 2"""
)
def cluster_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of clusters that enough matches link."""
    p = _points(spark, sf_dir)
    both = p.select("image_id", F.col("id").alias("a"), F.explode(F.array(F.col("id") + 50, F.col("id") + 100)).alias("b"))
    return V.cluster_links(both, V.single_linkage(p, 20.0), 2).select("image_id", "a", "b", "ca", "cb")


@query("SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extra: counts by hour and type from a stream of files."""
    import uuid

    from palimpsest.streaming.reports import run_to_files, stream_table, windowed_means

    schema = table(spark, sf_dir, "events").schema
    events = stream_table(spark, sf_dir, schema, "events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    report = windowed_means(events, "ts", "event_type", "value")
    name = f"stream_{uuid.uuid4().hex[:8]}"
    out = run_to_files(report, ["window", "event_type"], f"{shared_folder(spark)}/palimpsest/{name}")
    return out.select(F.col("window.start").alias("start"), "event_type", "n")


@query(
    """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1) * 127.5) AS INT)) AS v FROM embeddings),
d AS (SELECT p.id, q.id AS other, CAST(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: bit_count(xor(p.v[i], q.v[i])))) AS DOUBLE) AS distance FROM v p JOIN v q ON p.id <> q.id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM d) SELECT * FROM n WHERE rank <= 3"""
)
def knn_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of bytes by the bits that differ."""
    bytes_ = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 127.5).cast("int"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("vec_id").alias("id"), bytes_.alias("vec"))
    return M.nearest(vectors, 3, across_images=True, hamming=True).select("id", "other", "distance", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {PX}, m AS (SELECT p.image_id, p.y, p.x, q.y AS my, q.x AS mx, abs(p.g - q.g) AS distance FROM px p JOIN px q ON q.image_id = p.image_id AND q.y = p.y AND abs(q.x - p.x) >= 2), r AS (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY distance, my, mx) - 1 AS plane FROM m) SELECT image_id, y, x, my, mx, distance, plane FROM r WHERE plane < 2")
def match_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first matches of each pixel, one a plane."""
    px = maps.pixels(spark, sf_dir).select(*XY, "g")
    q = px.select("image_id", "y", F.col("x").alias("mx"), F.col("g").alias("h"))
    m = px.join(q, ["image_id", "y"]).filter(F.abs(F.col("mx") - F.col("x")) >= 2).select(*XY, F.col("y").alias("my"), "mx", F.abs(F.col("g") - F.col("h")).alias("distance"))
    return M.planes(m, 2).select(*XY, "my", "mx", "distance", F.col("plane").cast("long").alias("plane"))


@query(
    f"""WITH {PX}, {BL}, h AS (SELECT image_id, block_y, block_x, g // 8 AS bin, count(*) AS n FROM bl GROUP BY ALL), e AS (SELECT image_id, block_y, block_x, round(sum(-(n / 16.0::DOUBLE) * log2(n / 16.0::DOUBLE)), 6) AS f1 FROM h GROUP BY ALL),
m AS (SELECT image_id, block_y, block_x, round(avg(g), 6) AS f0 FROM bl WHERE {_R2} <= 4 GROUP BY ALL), f AS (SELECT image_id, block_y * 8 + block_x AS id, f0, f1 FROM m JOIN e USING (image_id, block_y, block_x))
SELECT p.image_id, p.id AS a, q.id AS b FROM f p JOIN f q ON p.image_id = q.image_id AND p.id < q.id WHERE abs(p.f0 - q.f0) <= 4.3 AND abs(p.f1 - q.f1) <= 0.31"""
)
def colour_entropy_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: block pairs near in colour and entropy."""
    f = _rounded(B.bravo(_blocks(spark, sf_dir), 4), KEY).select("image_id", F.struct((F.col("block_y") * 8 + F.col("block_x")).alias("id"), F.array("f0").alias("colours"), F.col("f1").alias("entropy")).alias("p"))
    pairs = f.select("image_id", F.col("p").alias("a")).join(f.select("image_id", F.col("p").alias("b")), "image_id").filter("a.id < b.id")
    return pairs.filter(M.colour_entropy(4.3, 0.31)).select("image_id", F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@query(f"WITH {PX}, b AS (SELECT image_id, y // 4 * 32 + x // 4 * 4 AS id, array_agg(g ORDER BY y, x) AS v FROM px GROUP BY ALL) SELECT p.image_id, p.id AS a, q.id AS b FROM b p JOIN b q ON p.image_id = q.image_id AND p.id < q.id WHERE list_max(list_transform(range(1, 17), lambda i: abs(p.v[i] - q.v[i]))) <= 60")
def componentwise_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block pairs whose components are all near."""
    return _block_pairs(spark, sf_dir).filter(M.componentwise([60.0] * 16)).select("image_id", F.col("a.id").cast("long").alias("a"), F.col("b.id").cast("long").alias("b"))


@query(
    f"""WITH {PX}, o AS (SELECT * FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)), f AS (SELECT image_id, y, x, y + 2 AS my, x + 3 AS mx FROM px WHERE y < 6 AND x < 5 AND v > 0.1),
m AS (SELECT * FROM f UNION SELECT image_id, my, mx, y, x FROM f),
c AS (SELECT m.*, p.g AS p, q.g AS q FROM m, o JOIN px p ON p.image_id = m.image_id AND p.y = m.y + dy AND p.x = m.x + dx JOIN px q ON q.image_id = m.image_id AND q.y = m.my + dy AND q.x = m.mx + dx),
s AS (SELECT image_id, y, x, my, mx, covar_pop(p, q) AS c, var_pop(p) AS vp, var_pop(q) AS vq FROM c GROUP BY ALL)
SELECT DISTINCT image_id, y, x FROM s WHERE vp > 1e-9 AND vq > 1e-9 AND c / sqrt(vp * vq) >= 0.413"""
)
def correlated_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of matches that correlate, from either side."""
    px = maps.pixels(spark, sf_dir)
    m = px.filter("y < 6 AND x < 5 AND v > 0.1").select(*XY, (F.col("y") + 2).alias("my"), (F.col("x") + 3).alias("mx"))
    return V.correlated(px, m, 0.413, 1)
