"""Keypoints: blobs of known place and scale, turned and doubled images, descriptors by plain sums, copies found end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import keypoints as K
from palimpsest.operators import features, homographies, matching


def texture(seed, h, w, blur=1.6):
    image = K.gaussian(np.random.default_rng(seed).integers(0, 256, (h, w)).astype(float), blur)
    return (image - image.min()) / (image.max() - image.min()) * 255


def blob(h, w, y, x, sigma):
    ys, xs = np.indices((h, w))
    return 220 * np.exp(-((ys - y) ** 2 + (xs - x) ** 2) / (2 * sigma**2))


@pytest.mark.parametrize("y,x,sigma", [(40.0, 52.0, 3.0), (40.3, 51.6, 4.0), (60.0, 61.0, 7.0)])
def test_a_blob_is_one_place_at_its_scale(y, x, sigma):
    found = K.keypoints(blob(120, 130, y, x, sigma))
    assert found
    best = max(found, key=lambda k: -np.hypot(k.y - y, k.x - x))
    assert np.hypot(best.y - y, best.x - x) < 0.5 and all(np.hypot(k.y - y, k.x - x) < 1.5 for k in found)
    # differences of Gaussians answer most at about the blob's own width
    assert 0.75 * sigma < best.scale < 1.35 * sigma


def test_flat_and_edge_images_have_none():
    assert K.keypoints(np.full((50, 60), 128.0)) == [] and K.keypoints(np.zeros((5, 5))) == []
    edge = np.repeat(np.where(np.arange(80) < 40, 20.0, 220.0)[None], 70, axis=0)
    assert K.keypoints(edge) == []


def paired(a, b, where):
    """Share of keypoints of a whose nearest descriptor in b lies where it should."""
    v, p = np.array([k.vec for k in b]), np.array([(k.y, k.x) for k in b])
    hits = 0
    for k in a:
        j = ((v - k.vec) ** 2).sum(axis=1).argmin()
        hits += np.hypot(*(p[j] - where(k.y, k.x))) < 1.5
    return hits / len(a)


def test_keypoints_turn_and_grow_with_the_image():
    image = texture(1, 90, 100)
    found = K.keypoints(image)
    assert len(found) > 40 and all(np.isclose(np.linalg.norm(k.vec), 1) and k.vec.shape == (128,) and 0 <= k.theta < 2 * np.pi for k in found)
    assert paired(found, K.keypoints(np.rot90(image)), lambda y, x: (99 - x, y)) > 0.95
    ys, xs = np.meshgrid(np.clip((np.arange(180) + 0.5) / 2 - 0.5, 0, 89), np.clip((np.arange(200) + 0.5) / 2 - 0.5, 0, 99), indexing="ij")
    from palimpsest.functions import grids

    large = K.keypoints(grids.sample_linear(image, ys, xs))
    assert paired(found, large, lambda y, x: (2 * y + 0.5, 2 * x + 0.5)) > 0.7


def test_extrema_one_by_one():
    dog = np.random.default_rng(2).normal(size=(5, 12, 14))
    want = []
    for s, y, x in np.ndindex(dog.shape):
        if 0 < s < 4 and 0 < y < 11 and 0 < x < 13:
            cube = dog[s - 1 : s + 2, y - 1 : y + 2, x - 1 : x + 2].ravel()
            rest = np.delete(cube, 13)
            if abs(cube[13]) >= 0.5 and (cube[13] >= rest.max() or cube[13] <= rest.min()):
                want.append((s, y, x))
    assert [tuple(map(int, r)) for r in K.extrema(dog, 0.5)] == want and want


def test_descriptor_by_plain_sums():
    level = texture(3, 60, 60)
    y, x, sigma, theta = 29.3, 30.8, 1.9, 0.7
    side, out = 3.0 * sigma, np.zeros((4, 4, 8))
    for py in range(1, 59):
        for px in range(1, 59):
            dy, dx = py - y, px - x
            u, v = (np.cos(theta) * dx + np.sin(theta) * dy) / side, (-np.sin(theta) * dx + np.cos(theta) * dy) / side
            gy, gx = (level[py + 1, px] - level[py - 1, px]) / 2, (level[py, px + 1] - level[py, px - 1]) / 2
            weight = np.hypot(gy, gx) * np.exp(-(u * u + v * v) / 8)
            bin_ = (np.arctan2(gy, gx) - theta) % (2 * np.pi) * 8 / (2 * np.pi)
            for i in range(4):
                for j in range(4):
                    for k in range(8):
                        off = abs(bin_ - k)
                        share = max(0, 1 - abs(v + 1.5 - i)) * max(0, 1 - abs(u + 1.5 - j)) * max(0, 1 - min(off, 8 - off))
                        out[i, j, k] += weight * share
    want = out.ravel() / np.linalg.norm(out)
    want = np.minimum(want, 0.2)
    assert np.allclose(K.descriptor(level, y, x, sigma, theta), want / np.linalg.norm(want), atol=1e-9)


def test_copies_from_pixels_alone(spark):
    image = texture(4, 130, 140)
    image[70:118, 80:128] = image[8:56, 10:58]
    rows = [(0, 130, 140, image.ravel().tolist()), (1, 60, 60, [7.0] * 3600), (2, 80, 90, texture(6, 80, 90).ravel().tolist())]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, values array<double>")
    points = features.keypoints(df)
    assert points.filter("image_id = 1").count() == 0
    pixels = df.select("image_id", "width", F.posexplode("values").alias("p", "g")).select("image_id", F.expr("cast(p div width as int)").alias("y"), F.expr("cast(p % width as int)").alias("x"), "g")
    sizes = homographies.settings(df.select("image_id", "height", "width")).withColumn("least_size", F.lit(500))
    pairs = matching.bucketed_matches(points, "gray", 0.65, 40.0, "octave")
    models, areas = homographies.verified(homographies.matched(points, pairs), pixels, sizes)
    assert {m["image_id"] for m in models.collect()} == {0}
    mask, truth = np.zeros((130, 140), bool), np.zeros((130, 140), bool)
    truth[70:118, 80:128] = truth[8:56, 10:58] = True
    for a in areas.collect():
        assert a["image_id"] == 0
        mask[a["y"], a["x"]] = True
    assert (mask & truth).sum() > 0.9 * truth.sum() and (mask & truth).sum() > 0.6 * mask.sum()
    assert features.keypoints(df.limit(0)).count() == 0
