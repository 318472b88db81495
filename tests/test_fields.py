"""Dense descriptors and their fields against plain sums and exact neighbours."""

import numpy as np
import pytest

from palimpsest.functions import fields, grids
from palimpsest.operators import matching, raster, verify


def test_filters_are_the_moments_of_a_disc():
    assert fields.moments(5) == [(0, 0), (1, 1), (2, 0), (2, 2), (3, 1), (3, 3), (4, 0), (4, 2), (4, 4), (5, 1), (5, 3), (5, 5)]
    bank = fields.zernike_filters(8, 5)
    assert np.isclose(bank[0].sum(), 1, atol=5e-3) and np.allclose(bank[1:].sum(axis=(1, 2)), 0, atol=2e-2)  # a flat image is its own mean
    y, x = np.indices((17, 17)) - 8
    # the function x = Re(z) has the first moment 1/2, and no other
    ramp = np.abs((bank * (x / 8)).sum(axis=(1, 2)))
    assert np.isclose(ramp[1], 0.5, atol=5e-3) and np.allclose(np.delete(ramp, 1), 0, atol=2e-2)


def test_vectors_are_sums_over_discs_and_turn_with_the_image():
    r = np.random.default_rng(1)
    image = r.integers(0, 256, (21, 17)).astype(float)
    got = fields.zernike_vectors(image, 4, 5)
    bank = fields.zernike_filters(4, 5)
    padded = np.pad(image, 4)
    for y, x in [(0, 0), (20, 16), (10, 8), (3, 15)]:
        want = np.abs((bank * padded[y : y + 9, x : x + 9]).sum(axis=(1, 2)))
        assert np.allclose(got[y, x], want)
    assert np.allclose(fields.zernike_vectors(np.rot90(image), 4, 5), np.rot90(got), atol=1e-6)


def exact(vectors, least):
    h, w, d = vectors.shape
    flat = vectors.reshape(-1, d)
    at = np.stack(np.indices((h, w)), axis=-1).reshape(-1, 2)
    cost = ((flat[:, None] - flat[None]) ** 2).sum(axis=2)
    cost[((at[:, None] - at[None]) ** 2).sum(axis=2) < least**2] = np.inf
    return cost.min(axis=1).reshape(h, w)


@pytest.mark.parametrize("turned", [False, True])
def test_field_finds_a_copy(turned):
    r = np.random.default_rng(2)
    image = r.integers(0, 256, (48, 52)).astype(float)
    part = image[4:22, 5:23].copy()
    image[26:44, 28:46] = np.rot90(part) if turned else part
    vectors = fields.zernike_vectors(image, 4)
    field, cost = fields.match_field(vectors, 10, seed=3)
    y, x = np.mgrid[8:18, 9:19]
    ty, tx = (26 + 17 - (x - 5), 28 + y - 4) if turned else (y + 22, x + 23)
    hits = (field[8:18, 9:19, 0] == ty) & (field[8:18, 9:19, 1] == tx)
    # a shift is carried on by displacements, a quarter turn by their change
    assert hits.mean() == 1 and np.allclose(cost[8:18, 9:19], 0, atol=1e-6)
    away = (field[..., 0] - np.arange(48)[:, None]) ** 2 + (field[..., 1] - np.arange(52)[None]) ** 2
    assert (away >= 100).all() and (cost >= 0).all()
    best = exact(vectors, 10)
    assert (cost >= best - 1e-9).all() and np.median(cost) <= 3 * np.median(best)
    again = fields.match_field(vectors, 10, seed=3)
    assert (again[0] == field).all()


def test_symmetry_offers_each_place_to_its_match():
    r = np.random.default_rng(4)
    field = fields.Field(r.random((9, 11, 3)), 2, 1)
    before = field.cost.copy()
    offers = {}
    for y, x in np.ndindex(9, 11):
        if np.isfinite(before[y, x]):
            offers.setdefault((int(field.my[y, x]), int(field.mx[y, x])), []).append(before[y, x])
    field.symmetrise()
    for y, x in np.ndindex(9, 11):
        assert field.cost[y, x] == min([before[y, x], *offers.get((y, x), [])])
        if np.isfinite(field.cost[y, x]):
            d = field.vectors[y, x] - field.vectors[field.my[y, x], field.mx[y, x]]
            assert np.isclose(d @ d, field.cost[y, x])


def test_rasters_without_a_far_place():
    field, cost = fields.match_field(fields.raw_vectors(np.arange(12.0).reshape(3, 4), 2), 50)
    assert np.isinf(cost).all() and field.shape == (2, 3, 2)


def packed(spark, *images):
    rows = [(i, *a.shape, [float(v) for v in a.ravel()]) for i, a in enumerate(images)]
    return spark.createDataFrame(rows, "image_id long, height int, width int, values array<double>")


def test_areas_of_a_dense_field(spark):
    r = np.random.default_rng(5)
    image = r.integers(0, 256, (64, 60)).astype(float)
    image[34:60, 32:56] = image[3:29, 4:28]
    df = packed(spark, image, r.integers(0, 256, (40, 40)))
    field = matching.dense_field(df, 4, 12.0, descriptor="ZERNIKE")
    areas = verify.dense_areas(field, 64, 60, least_size=60, residual=20.0, displacement=15.0, reach=6).collect()
    mask = np.zeros((64, 60), bool)
    for a in areas:
        if a["image_id"] == 0:
            mask[a["y"], a["x"]] = True
    truth = np.zeros((64, 60), bool)
    truth[34:60, 32:56] = truth[3:29, 4:28] = True
    assert (mask & truth).sum() / (mask | truth).sum() > 0.7 and not [a for a in areas if a["image_id"] == 1]
    with pytest.raises(ValueError):
        matching.dense_field(df, 4, 12.0, descriptor="OTHER")
    assert matching.dense_field(df.limit(0), 4, 12.0).count() == 0 and matching.dense_vectors(df, 3).count() == 64 * 60 + 1600


def test_neighbourhoods_of_large_discs_go_by_tiles(spark, monkeypatch):
    """Residuals by tiles are those by rows, over tile borders too, and a pixel is not sent once a neighbour."""
    r = np.random.default_rng(5)
    field = spark.createDataFrame([(1, y, x, int(y + 3 + r.integers(0, 2)), int(x + 5 - r.integers(0, 2))) for y in range(-3, 30) for x in range(118, 140) if r.random() < 0.8], "image_id long, y int, x int, my int, mx int")
    tiled = verify.affine_residual(field, 3, 9.0)
    assert "explode(array" not in tiled._jdf.queryExecution().optimizedPlan().toString()
    got = {tuple(v)[:5]: v["error"] for v in tiled.collect()}
    monkeypatch.setattr(raster, "NEAR", 1000)
    want = {tuple(v)[:5]: v["error"] for v in verify.affine_residual(field, 3, 9.0).collect()}
    assert 0 < len(want) < field.count() and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    calm = {(v["y"], v["x"]): (v["my"], v["mx"]) for v in raster.medians(field, ["my", "mx"], grids.disc(2)).collect()}
    at = {(v["y"], v["x"]): (v["my"], v["mx"]) for v in field.collect()}
    assert calm == {(y, x): tuple(np.median([at[y + dy, x + dx] for dy, dx in grids.disc(2) if (y + dy, x + dx) in at], axis=0).tolist()) for y, x in at}
