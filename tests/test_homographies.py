"""Robust estimators against all samples, and the verification of keypoint matches against plain loops."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import estimators as E
from palimpsest.operators import homographies as H

MATCHES = "image_id long, id long, y double, x double, my double, mx double, scale double, mscale double, theta double, mtheta double"
TRUE = np.array([[0.9, -0.3, 20.0], [0.25, 1.1, -5.0], [1e-3, -5e-4, 1.0]])


def pairs(seed, n, outliers, noise=0.0, h=TRUE):
    r = np.random.default_rng(seed)
    a = r.random((n, 2)) * 100
    b = E.projected(h, a) + r.normal(0, noise, (n, 2)) if noise else E.projected(h, a)
    b[:outliers] = r.random((outliers, 2)) * 100
    return a, b


def test_direct_linear_and_what_leaves_it_open():
    a, b = pairs(1, 12, 0)
    assert np.allclose(E.direct_linear(a, b), TRUE) and np.allclose(E.direct_linear(a[:4], b[:4]), TRUE)
    assert E.direct_linear(a[:3], b[:3]) is None
    line = np.column_stack((np.arange(9.0), 2 * np.arange(9.0)))
    assert E.direct_linear(line, line + 1) is None and E.affine_total(line, line + 1) is None
    assert np.allclose(E.projected(np.array([[1, 0, 0], [0, 1, 0], [1.0, 0, -1]]), np.array([[1.0, 2.0], [2.0, 2.0]])), [[np.inf, np.inf], [2, 2]])


@pytest.mark.parametrize("method", E.METHODS)
def test_methods_find_the_map(method):
    affine = np.array([[0.9, -0.2, 5], [0.3, 1.1, -7], [0, 0, 1.0]])
    robust = method in ("ownransac", "ransac", "lmeds")
    h = affine if method in ("ownransac", "goldstandard") else TRUE
    a, b = pairs(2, 60, 20 if robust else 0, h=h)
    found, near = E.estimate(method, a, b, 0.5)
    assert np.allclose(found / found[2, 2], h, atol=1e-5) and near[20:].all() and near.sum() <= (42 if robust else 60)
    again, _ = E.estimate(method, a, b, 0.5)
    assert (again == found).all()
    none, near = E.estimate(method, a[:2], b[:2], 0.5)
    assert none is None and not near.any()
    same = np.ones((8, 2))
    assert E.estimate(method, same, same, 0.5)[0] is None


def test_unknown_method():
    with pytest.raises(ValueError):
        E.estimate("guess", np.zeros((5, 2)), np.zeros((5, 2)))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("affine", [False, True])
def test_consensus_is_that_of_all_samples(seed, affine):
    a, b = pairs(seed + 10, 11, 5, 0.05, np.vstack((TRUE[:2], (0, 0, 1))) if affine else TRUE)
    h, near = E.consensus(a, b, 1.0, affine, 4000, confidence=1 - 1e-12, enough=1.1)
    best = 0
    for pick in combinations(range(11), 3 if affine else 4):
        m = E._minimal(a[None, list(pick)], b[None, list(pick)], affine)[0]
        best = max(best, int((E.squared_errors(m, a, b) <= 1).sum()))
    assert near.sum() >= best >= 6 and (E.squared_errors(h, a, b)[near] <= 1).all()


@pytest.mark.parametrize("seed", range(4))
def test_least_median_is_near_that_of_all_samples(seed):
    a, b = pairs(seed + 20, 10, 3, 0.05)
    h, near = E.least_median(a, b, 4000)
    medians = [np.median(E.squared_errors(E._minimal(a[None, list(p)], b[None, list(p)], False)[0], a, b)) for p in combinations(range(10), 4) if not E._collinear(a[None, list(p)])[0]]
    assert np.median(E.squared_errors(h, a, b)) < 20 * min(medians) + 1e-6 and near[3:].sum() >= 6


def test_refined_has_the_least_reprojection_error():
    r = np.random.default_rng(3)
    a, b = pairs(4, 40, 0, 0.6)
    start = E.direct_linear(a, b)
    h = E.refined(start, a, b, 30)
    cost = E.squared_errors(h, a, b).sum()
    assert cost <= E.squared_errors(start, a, b).sum()
    for _ in range(200):
        step = r.normal(0, 1, (3, 3)) * np.array([[1e-4, 1e-4, 1e-2], [1e-4, 1e-4, 1e-2], [1e-7, 1e-7, 0]])
        assert cost <= E.squared_errors(h + step, a, b).sum() + 1e-9


# verification


def scene(seed=5, side=200, angle=20.0, scale=1.0):
    """A smooth image in which a turned square was copied, and matches of both squares with a third of wrong ones."""
    r = np.random.default_rng(seed)
    y, x = np.indices((side, side))
    image = 128 + 60 * np.sin(y / 5 + x / 11) + 50 * np.cos(x / 4 - y / 13)
    t = np.radians(angle)
    turn = scale * np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
    centre, goal = np.array([60.0, 60.0]), np.array([140.0, 135.0])  # (x, y)
    h = np.vstack((np.column_stack((turn, goal - turn @ centre)), (0, 0, 1)))
    back = E.projected(np.linalg.inv(h), np.column_stack((x.ravel(), y.ravel()))).reshape(side, side, 2)
    inside = (np.abs(back - centre) <= 28).all(axis=2)
    by, bx = np.clip(np.rint(back[..., 1]).astype(int), 0, side - 1), np.clip(np.rint(back[..., 0]).astype(int), 0, side - 1)
    forged = np.where(inside, image[by, bx], image).astype(int)
    a = centre + r.uniform(-26, 26, (45, 2))
    b = E.projected(h, a)
    rows = [(0, i, *map(float, (p[1], p[0], q[1], q[0], 1.0, scale, o, o + t))) for i, (p, q, o) in enumerate(zip(a, b, r.uniform(0, 6, 45), strict=True))]
    rows += [(0, 100 + i, *map(float, r.uniform(5, side - 6, 4)), 1.0, 1.0, *map(float, r.uniform(0, 6, 2))) for i in range(20)]
    rows = [row if i % 3 else (0, row[1], row[4], row[5], row[2], row[3], row[7], row[6], row[9], row[8]) for i, row in enumerate(rows)]
    source = (np.abs(y - centre[1]) <= 28) & (np.abs(x - centre[0]) <= 28)
    return forged, rows, inside | source, h


def frames(spark, image, rows, **change):
    pixels = spark.createDataFrame([(0, y, x, int(v)) for (y, x), v in np.ndenumerate(image)], "image_id long, y int, x int, g int")
    sizes = H.settings(spark.createDataFrame([(0, *image.shape)], "image_id long, height int, width int"))
    return pixels, spark.createDataFrame(rows, MATCHES), sizes.withColumns({k: F.lit(v) for k, v in change.items()})


@pytest.mark.parametrize("angle,scale", [(0.0, 1.0), (25.0, 1.0), (10.0, 1.3)])
def test_copied_areas_of_a_scene(spark, angle, scale):
    forged, rows, truth, h = scene(angle=angle, scale=scale)
    pixels, matches, sizes = frames(spark, forged, rows)
    models, areas = H.verified(matches, pixels, sizes)
    found = models.collect()
    grid = np.array([[x, y] for x in (40.0, 60, 80) for y in (40.0, 60, 80)])
    there = E.projected(h, grid)
    near = lambda m, p, q: np.sqrt(E.squared_errors(np.array(m).reshape(3, 3), p, q)).max() < 3
    assert found and all(near(m["h"], grid, there) or near(m["h"], there, grid) for m in found)
    mask = np.zeros(forged.shape, bool)
    for r in areas.collect():
        mask[r["y"], r["x"]] = True
    # discs reach 20 pixels beyond the squares, where only chance makes colours agree
    assert (mask & truth).sum() >= 0.9 * truth.sum() and (mask & truth).sum() >= 0.45 * mask.sum()


def test_matches_at_random_have_no_areas(spark):
    forged, rows, _, _ = scene()
    pixels, matches, sizes = frames(spark, forged, [r for r in rows if r[1] >= 100])
    models, areas = H.verified(matches, pixels, sizes)
    assert models.count() == 0 and areas.count() == 0
    empty = H.verified(matches.limit(0), pixels, sizes)
    assert empty[1].count() == 0


def alike(turn, tolerance, theta, mtheta):
    degrees = lambda v: round(float(np.degrees(v)) % 360, 1)
    off = (degrees(mtheta) - degrees(theta)) % 360
    return abs(off - turn) < tolerance or abs(360 - off - turn) < tolerance


def test_inliers_and_rules_one_by_one(spark):
    forged, rows, _, h = scene()
    g = np.linalg.inv(h) / np.linalg.inv(h)[2, 2] + np.array([[0, 0, 1.0], [0, 0, -1], [1e-4, 0, 0]])
    pixels, matches, sizes = frames(spark, forged, rows, match_share=0.3, check_distance=True, least_distance=90, check_edges=True)
    given = [(0, 1, h.ravel().tolist(), 1.0, 1.0, 20.0, 3.0, 5, 100.0), (0, 2, g.ravel().tolist(), 1.0, 1.0, 340.0, 25.0, 5, 50.0), (0, 3, np.eye(3).ravel().tolist(), 1.0, 1.0, 0.0, 9.0, 5, 0.0)]
    models = spark.createDataFrame(given, "image_id long, seed long, h array<double>, s0 double, s1 double, turn double, allowed double, least_inliers int, distance double")
    want = set()
    for _, seed, m, _, _, turn, allowed, _, _ in given:
        m = np.array(m).reshape(3, 3)
        for _, i, y, x, my, mx, s, ms, o, mo in rows:
            p, q = np.array([[x, y]]), np.array([[mx, my]])
            if E.squared_errors(m, p, q)[0] < allowed:
                one = (seed, i, y, x, my, mx, s, False, o, mo)
            elif E.squared_errors(m, q, p)[0] < allowed:
                one = (seed, i, my, mx, y, x, ms, True, mo, o)
            else:
                continue
            if alike(turn, 20, one[8], one[9]):
                want.add(one[:8])
    inliers = H.model_inliers(matches, models)
    got = {(r["seed"], r["id"], r["y"], r["x"], r["my"], r["mx"], r["scale"], r["reversed"]) for r in inliers.collect()}
    assert got == want and len({w[0] for w in want}) >= 2 and any(w[7] for w in want)
    counts = {s: sum(w[0] == s for w in want) for s in (1, 2, 3)}
    n = len(rows)
    keep = {s for s in counts if not (counts[s] < max(5, n * 0.3 // 1) and counts[s] < 6) and not (counts[s] < 17 and dict((x[1], x[8]) for x in given)[s] < 90) and counts[s]}
    every = matches.withColumn("n", F.lit(n))
    assert {r["seed"] for r in H.accepted_models(inliers, models, every, sizes).collect()} == keep


@pytest.mark.parametrize("directions", [1, 2])
def test_discs_pixel_by_pixel(spark, directions):
    forged, rows, _, h = scene(side=90, angle=8.0)
    h = np.array([[0.98, -0.1, 14.0], [0.12, 1.01, 6.5], [2e-4, -1e-4, 1.0]])
    pixels, matches, sizes = frames(spark, forged, rows[:0] or [(0, 1, 20.0, 25.0, 0.0, 0.0, 0.5, 0.5, 0.0, 0.0)], directions=directions)
    given = [(0, 7, i, y, x, my, mx, s, ms) for i, y, x, my, mx, s, ms in [(1, 20.0, 25.0, 40.0, 38.0, 0.5, 1.1), (2, 3.0, 60.0, 20.0, 70.0, 1.2, 2.0), (3, 50.0, 40.0, 70.0, 60.0, 5.0, 1.0)]]
    inliers = spark.createDataFrame(given, "image_id long, seed long, id long, y double, x double, my double, mx double, scale double, mscale double")
    models = spark.createDataFrame([(0, 7, h.ravel().tolist(), 1.2, 0.95)], "image_id long, seed long, h array<double>, s0 double, s1 double")
    side = forged.shape[0]
    soft = np.array([[forged[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].mean() for x in range(side)] for y in range(side)])
    want = set()
    for way in range(1, directions + 1):
        m = h if way == 1 else np.linalg.inv(h)
        for _, _, _, y, x, my, mx, s, ms in given:
            cy, cx, scale = (y, x, s) if way == 1 else (my, mx, ms)
            radius = scale * 16
            radius = 20 + 12 if radius > 20 else 16 if radius < 16 else int(radius)
            for py, px in np.ndindex(side, side):
                if (py - int(cy)) ** 2 + (px - int(cx)) ** 2 <= radius**2:
                    tx, ty = np.rint(E.projected(m, np.array([[px, py]], float))[0]).astype(int)
                    if 0 <= ty < side and 0 <= tx < side and abs(soft[py, px] - soft[ty, tx]) < 16:
                        want |= {(py, px, way), (ty, tx, 3 - way)}
    got = {(r["y"], r["x"], r["side"]) for r in H.grown_discs(pixels, inliers, models, sizes).collect()}
    assert got == want


def test_inverse_of_a_column(spark):
    df = spark.createDataFrame([(TRUE.ravel().tolist(),)], "h array<double>")
    got = np.array(df.select(H.inverse().alias("v")).first()[0]).reshape(3, 3)
    assert np.allclose(got @ TRUE / np.linalg.det(TRUE), np.eye(3))


def test_turns_and_elements():
    assert [H.turn_of(np.cos(t), np.sin(t)) for t in np.radians([0, 30, 90, 180, 200, 330])] == [0.0, 30.0, 90.0, 180.0, 200.0, 330.0]
    assert [len(H.octagon(k)) for k in (4, 6, 14)] == [(2 * k + 1) ** 2 - 4 * c for k, c in ((4, 3), (6, 3), (14, 36))]
