"""Steps of the verification of keypoint matches by tiles: what they send, and that their results stay."""

import math

import numpy as np

from palimpsest.functions import estimators as E
from palimpsest.operators import homographies as H
from palimpsest.operators import matching
from palimpsest.plans import detection

SMALL = "/root/testdata/sf0.001"


def raster(spark, image):
    return spark.createDataFrame([(0, y, x, int(v)) for (y, x), v in np.ndenumerate(image)], "image_id long, y int, x int, g int")


def test_squares_of_places_are_summed_without_a_window_over_all_pixels(spark, monkeypatch):
    monkeypatch.setattr(H, "SMOOTH_TILE", 32)
    image = np.random.default_rng(3).integers(0, 256, (50, 70))
    steep = np.hypot(*np.gradient(image.astype(float)))
    at = [(16, 16), (31, 40), (32, 33), (0, 0), (49, 69), (20, 69), (49, 69 + 5)]
    sums = H.gradient_sums(spark.createDataFrame([(0, *p) for p in at], "image_id long, y int, x int"), raster(spark, image))
    got = {(r["y"], r["x"]): r["energy"] for r in sums.collect()}
    assert got.keys() == set(at[:-1])
    assert all(math.isclose(e, steep[max(0, y - 16) : y + 16, max(0, x - 16) : x + 16].sum(), rel_tol=1e-12) for (y, x), e in got.items())
    assert "Window" not in sums._jdf.queryExecution().optimizedPlan().toString()


def test_discs_meet_their_copies_in_the_same_and_in_other_tiles(spark, monkeypatch):
    monkeypatch.setattr(H, "SMOOTH_TILE", 32)
    image = np.random.default_rng(4).integers(90, 150, (80, 75))
    h = np.array([[0.98, -0.1, 14.0], [0.12, 1.01, 6.5], [2e-4, -1e-4, 1.0]])
    ends = [(1, 20, 25, 40, 38), (2, 3, 60, 20, 70), (3, 33, 31, 60, 50)]
    inliers = spark.createDataFrame([(0, 7, *e, 1.0, 1.0) for e in ends], "image_id long, seed long, id long, y int, x int, my int, mx int, scale double, mscale double")
    models = spark.createDataFrame([(0, 7, h.ravel().tolist(), 1.0, 1.0)], "image_id long, seed long, h array<double>, s0 double, s1 double")
    sizes = H.settings(spark.sql("SELECT 0L AS image_id, 80 AS height, 75 AS width"))
    soft = np.array([[image[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].mean() for x in range(75)] for y in range(80)])
    want = set()
    for y, x in np.ndindex(80, 75):
        if any((y - cy) ** 2 + (x - cx) ** 2 <= 256 for _, cy, cx, _, _ in ends):
            tx, ty = np.rint(E.projected(h, np.array([[x, y]], float))[0]).astype(int)
            if 0 <= ty < 80 and 0 <= tx < 75 and abs(soft[y, x] - soft[ty, tx]) < H.COLOUR:
                want |= {(y, x, 1), (ty, tx, 2)}
    for tile in (32, 1024):
        monkeypatch.setattr(H, "SMOOTH_TILE", tile)
        rows = [(r["y"], r["x"], r["side"]) for r in H.grown_discs(raster(spark, image), inliers, models, sizes).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_seeds_are_dealt_to_all_partitions(spark):
    random, rows = np.random.default_rng(5), []
    for image, seed in np.ndindex(4, 6):
        for i, (y, x) in enumerate(random.uniform(0, 90, (12, 2)).tolist()):
            rows.append((image, seed, i, y, x, y + 9, x + 12, 1.0, 1.0, 1.0, 1.0, None))
    local = spark.createDataFrame(rows, "image_id long, seed long, id long, y double, x double, my double, mx double, scale double, mscale double, theta double, mtheta double, ratio double")
    sizes = H.settings(spark.sql("SELECT id AS image_id, 128 AS height, 128 AS width FROM range(4)"))
    models = H.local_models(local, sizes)
    assert models.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = models.collect()
    assert len(found) == 24 and all(np.allclose(np.array(m["h"]).reshape(3, 3), [[1, 0, 12], [0, 1, 9], [0, 0, 1]], atol=1e-6) for m in found)


def test_both_filters_of_the_field_drop_pixels(spark):
    packed = detection._packed(spark, SMALL)
    field = {(r["image_id"], r["y"], r["x"]): (r["my"], r["mx"]) for r in matching.dense_field(packed, 3, 2).collect()}
    limit, calm = 300.0 * 5 / 113, {}
    for (i, y, x), (my, mx) in field.items():
        near = [(p, q, field[i, y + p, x + q]) for p, q in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) if (i, y + p, x + q) in field]
        a = np.array([[1.0, p, q] for p, q, _ in near])
        b = np.array([[m[0] - y - p, m[1] - x - q] for p, q, m in near], dtype=float)
        error = ((b - a @ np.linalg.lstsq(a, b, rcond=None)[0]) ** 2).sum()
        assert error < 200 and abs(error - limit) > 1e-9  # the limit before, that nothing reached
        if error < limit:
            calm[i, y, x] = (my, mx)
    want = {(*k, *m) for k, m in calm.items() if (m[0] - k[1]) ** 2 + (m[1] - k[2]) ** 2 >= 9}
    got = {(r["image_id"], r["y"], r["x"], r["my"], r["mx"]) for r in detection.patchmatch_field(spark, SMALL).collect()}
    assert got == want and 0 < len(want) < len(calm) < len(field)
