"""Contours and hulls of random areas against their definitions."""

import numpy as np
import pytest

from palimpsest.functions import grids, outlines
from palimpsest.operators import verify


def areas(seed, shape=(12, 14), share=0.55):
    mask = np.random.default_rng(seed).random(shape) < share
    labels = grids.label_regions(mask, grids.EIGHT)
    return [np.argwhere(labels == k) for k in range(1, labels.max() + 1)]


@pytest.mark.parametrize("seed", range(6))
def test_contours_are_outer_borders(seed):
    for points in areas(seed):
        got = outlines.contour(points)
        y0, x0 = points.min(axis=0) - 1
        mask = np.zeros(points.max(axis=0) - (y0, x0) + 2, bool)
        mask[tuple((points - (y0, x0)).T)] = True
        outside = grids.label_regions(~mask)
        outer = outside == outside[0, 0]
        border = {(y, x) for y, x in points.tolist() if any(outer[y - y0 + dy, x - x0 + dx] for dy, dx in grids.FOUR)}
        assert set(map(tuple, got.tolist())) == border and tuple(got[0]) == min(map(tuple, points.tolist()))
        steps = np.abs(np.diff(np.vstack((got, got[:1])), axis=0)).max(axis=1)
        assert (steps == 1).all() or len(got) == 1  # each pixel touches the next, and the last the first


def test_contour_of_small_areas():
    assert outlines.contour(np.array([[3, 4]])).tolist() == [[3, 4]]
    assert outlines.contour(np.array([[0, 0], [0, 1], [0, 2]])).tolist() == [[0, 0], [0, 1], [0, 2], [0, 1]]
    square = np.argwhere(np.ones((3, 3)))
    assert outlines.contour(square).tolist() == [[0, 0], [0, 1], [0, 2], [1, 2], [2, 2], [2, 1], [2, 0], [1, 0]]


@pytest.mark.parametrize("seed", range(6))
def test_hulls_hold_everything_by_corners_alone(seed):
    for points in areas(seed, (9, 9)):
        corners = outlines.hull(points)
        n = len(corners)
        if n < 3:
            assert len({tuple(p) for p in corners.tolist()}) == n
            continue
        cross = lambda a, b, p: (b[1] - a[1]) * (p[0] - a[0]) - (b[0] - a[0]) * (p[1] - a[1])
        sign = np.sign(cross(corners[0], corners[1], corners[2]))
        for i in range(n):
            a, b = corners[i], corners[(i + 1) % n]
            assert all(sign * cross(a, b, p) >= 0 for p in points) and sign * cross(a, b, corners[(i + 2) % n]) > 0
        assert {tuple(c) for c in corners.tolist()} <= {tuple(p) for p in points.tolist()}


def test_outlines_of_a_table(spark):
    rows = [(i, int(y), int(x)) for i in range(2) for points in areas(i) for y, x in points]
    df = spark.createDataFrame(rows + rows[:5], "image_id long, y int, x int")
    got = {}
    for r in verify.outlines(df).collect():
        got.setdefault((r["image_id"], r["component"], r["kind"]), []).append((r["n"], r["y"], r["x"]))
    want = {}
    for i in range(2):
        for points in areas(i):
            name = min(y * (1 << 20) + x for y, x in points.tolist())
            for kind, made in (("contour", outlines.contour(points)), ("hull", outlines.hull(points))):
                want[i, name, kind] = [(n, *p) for n, p in enumerate(made.tolist())]
    assert {k: sorted(v) for k, v in got.items()} == want
    assert verify.outlines(df.limit(0)).count() == 0


def test_logs_compose_invert_and_replay(spark):
    from palimpsest.operators import scenes

    r = np.random.default_rng(7)
    steps = [(0, 2, 0.0, 1.4, 3.0, 5.0), (0, 1, 35.0, 1.0, 6.0, 4.5), (0, 3, -90.0, 0.8, 5.5, 5.5), (1, 1, 0.0, 0.0, 1.0, 1.0)]
    log = spark.createDataFrame(steps, "image_id long, step int, degrees double, factor double, cy double, cx double")

    def matrix(degrees, factor, cy, cx):
        c, s = factor * np.cos(np.radians(degrees)), factor * np.sin(np.radians(degrees))
        move = lambda y, x: np.array([[1, 0, x], [0, 1, y], [0, 0, 1.0]])
        return move(cy, cx) @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) @ move(-cy, -cx)

    whole = np.eye(3)
    for _, _, *one in sorted(steps[:3], key=lambda s: s[1]):
        whole = matrix(*one) @ whole
    found = {x["image_id"]: x for x in scenes.composed(log).collect()}
    assert np.allclose(np.array(found[0]["matrix"]).reshape(2, 3), whole[:2]) and np.allclose(np.array(found[0]["back"]).reshape(2, 3), np.linalg.inv(whole)[:2])
    assert found[1]["back"] is None  # a scaling to nothing has no way back

    image = r.integers(1, 256, (12, 11))
    px = spark.createDataFrame([(i, y, x, int(image[y, x])) for i in range(2) for y, x in np.ndindex(12, 11)], "image_id long, y int, x int, g int")
    got = {(p["y"], p["x"]): p["g"] for p in scenes.replayed(px, scenes.composed(log), 12, 11).collect()}
    back, want = np.linalg.inv(whole), {}
    for y, x in np.ndindex(12, 11):
        sx, sy, _ = np.rint(np.round(back @ (x, y, 1), 6)).astype(int)
        if 0 <= sy < 12 and 0 <= sx < 11:
            want[y, x] = image[sy, sx]
    assert got == want and 40 < len(want) < 132

    # there and back by the same log: what stayed in the frame is found again, but for what nearest samples lose
    target = log.filter("image_id = 0")
    mask = px.filter("image_id = 0").select("image_id", "y", "x")
    same = {(p["y"], p["x"]) for p in scenes.carried(mask, target, target, 12, 11).collect()}
    assert same <= set(want) and len(same) >= 0.9 * len(want)
    assert scenes.carried(mask.limit(0), target, target, 12, 11).count() == 0
