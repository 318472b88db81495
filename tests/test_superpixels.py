"""Superpixels and their growth against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from palimpsest.functions import grids
from palimpsest.operators import superpixels

PX = "image_id long, y int, x int, g int, h int"


def pixels(spark, *images):
    return spark.createDataFrame([(i, y, x, *map(int, a[y, x])) for i, a in enumerate(images) for y, x in np.ndindex(a.shape[:2])], PX)


def dense(df, shape, image=0):
    out = np.zeros(shape, int)
    for r in df.collect():
        if r["image_id"] == image:
            out[r["y"], r["x"]] = r["segment"]
    return out


def plain_slic(image, n, compactness, rounds):
    h, w = image.shape[:2]
    side = max(1.0, np.sqrt(h * w / n))
    rows, columns = max(1, int(h / side)), max(1, int(w / side))
    centres = {}
    for i in range(rows):
        for j in range(columns):
            y, x = min(h - 1, int((i + 0.5) * side)), min(w - 1, int((j + 0.5) * side))
            centres[i * columns + j + 1] = np.array([y, x, *image[y, x]], float)
    for turn in range(rounds + 1):
        labels = np.zeros((h, w), int)
        for y, x in np.ndindex(h, w):
            d = [(round(((image[y, x] - c[2:]) ** 2).sum() + (compactness / side) ** 2 * ((y - c[0]) ** 2 + (x - c[1]) ** 2), 7), k) for k, c in centres.items() if abs(y - c[0]) <= 2 * side and abs(x - c[1]) <= 2 * side]
            labels[y, x] = min(d)[1]
        if turn < rounds:
            ys, xs = np.indices((h, w))
            centres = {k: np.array([ys[labels == k].mean(), xs[labels == k].mean(), *image[labels == k].mean(axis=0)]) for k in np.unique(labels)}
    return labels


def test_slic_pixel_by_pixel(spark):
    r = np.random.default_rng(1)
    one, two = r.integers(0, 256, (26, 31, 2)), np.full((9, 20, 2), 7)
    counts = spark.createDataFrame([(0, 12), (1, 3)], "image_id long, segments int")
    for rounds in (0, 3):
        got = superpixels.slic(pixels(spark, one, two), counts, 20.0, rounds, ("g", "h"))
        assert (dense(got, (26, 31)) == plain_slic(one, 12, 20.0, rounds)).all()
        assert (dense(got, (9, 20), 1) == plain_slic(two, 3, 20.0, rounds)).all()
    tiny = superpixels.slic(pixels(spark, one[:1, :1]), counts, bands=("g", "h"))
    assert [tuple(x) for x in tiny.collect()] == [(0, 0, 0, 1)]
    assert superpixels.slic(pixels(spark, one).limit(0), counts, bands=("g", "h")).count() == 0


def test_fragments_join_the_longest_edge(spark):
    a = np.array([[1, 1, 1, 2, 2], [1, 3, 1, 2, 2], [1, 1, 1, 2, 4], [1, 1, 1, 2, 2], [5, 5, 1, 2, 1]])
    rows = spark.createDataFrame([(0, y, x, int(v)) for (y, x), v in np.ndenumerate(a)], "image_id long, y int, x int, segment int")
    got = dense(superpixels.without_fragments(rows, 4), a.shape)
    big, right = got[0, 0], got[0, 3]
    assert (got == np.array([[big] * 3 + [right] * 2] * 5)).all() and big == 0 and right == 3
    assert dense(superpixels.without_fragments(rows, 1), a.shape)[2, 4] == 2 * (1 << 20) + 4
    lonely = superpixels.without_fragments(rows.filter("segment = 5"), 9)  # no large piece to join
    assert lonely.count() == 2


def plain_grown(labels, image, matches, limit, reach):
    segments = np.unique(labels)
    ys, xs = np.indices(labels.shape)
    centre = {s: (ys[labels == s].mean(), xs[labels == s].mean()) for s in segments}
    mean = {s: image[labels == s].mean() for s in segments}
    towards = {}
    for s in segments:
        near = grids.dilate(labels == s, grids.box(reach))
        for d in range(8):
            for t in sorted(set(np.unique(labels[near])) - {s}):
                angle = np.degrees(np.arctan2(centre[t][0] - centre[s][0], centre[t][1] - centre[s][1]))
                off = abs(angle - (d * 45 - 180))
                if min(off, 360 - off) <= 22:
                    towards[s, d] = t
                    break
    out = set()
    for y, x, my, mx in matches:
        s, t = labels[y, x], labels[my, mx]
        out |= {s, t}
        for d in range(8):
            p, q = towards.get((s, d)), towards.get((t, d))
            if p is not None and q is not None and abs(mean[p] - mean[s]) <= limit and abs(mean[q] - mean[t]) <= limit:
                out |= {p, q}
    return out


def test_growth_by_directions(spark):
    r = np.random.default_rng(2)
    image = r.integers(0, 256, (40, 44, 2))
    image[:, :22] = image[:, :22] // 4
    px = pixels(spark, image)
    counts = spark.createDataFrame([(0, 30)], "image_id long, segments int")
    segments = superpixels.slic(px, counts, 60.0, 2, ("g", "h"))
    labels = dense(segments, (40, 44))
    matches = [tuple(map(int, m)) for m in np.column_stack((r.integers(0, 40, (4, 2)), r.integers(0, 40, (4, 2))))[:, [0, 1, 2, 3]]]
    df = spark.createDataFrame([(0, *m) for m in matches], "image_id long, y int, x int, my int, mx int")
    for limit in (0.5, 15.0):
        got = {x["segment"] for x in superpixels.grown(segments, superpixels.described(px, segments), df, limit).collect()}
        assert got == plain_grown(labels, image[..., 0], matches, limit, 3)
    chosen = segments.filter(F.col("segment") % 2 == 0).select("image_id", "segment").distinct()
    mask = np.zeros((40, 44), bool)
    for p in superpixels.closed_areas(segments, chosen, 2, 40, 44).collect():
        mask[p["y"], p["x"]] = True
    assert (mask == grids.MORPHOLOGY["CLOSE"](labels % 2 == 0, grids.disc(2))).all()
    sizes = spark.createDataFrame([(0, 1500, 20), (1, 1499, 90)], "image_id long, height int, width int")
    assert {x[0]: x[1] for x in superpixels.counts_by_size(sizes).collect()} == {0: 500, 1: 100}
