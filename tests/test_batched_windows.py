"""Keypoints' windows worked on together, and means by tiles."""

import numpy as np
from pyspark.sql import functions as F

from palimpsest.functions import keypoints as K
from palimpsest.operators import homographies


def test_windows_of_many_places_are_those_of_each():
    levels = np.random.default_rng(3).random((6, 40, 50))
    at, y, x = np.array([0, 5, 2, 2]), np.array([0.2, 20.6, 39.0, 11.5]), np.array([3.1, 25.0, 49.0, 40.5])
    sigma = np.array([1.6, 3.9, 2.0, 2.5])
    place, theta = K.all_orientations(K.gradients(levels), at, y, x, sigma)
    assert len(place) and all(theta[place == i].tolist() == K.orientations(levels[at[i]], y[i], x[i], sigma[i]) for i in range(4))
    some = K.all_descriptors(K.gradients(levels), at, y, x, sigma, np.array([0.1, 2.0, 4.0, 6.0]))
    assert all((some[i] == K.descriptor(levels[at[i]], y[i], x[i], sigma[i], t)).all() for i, t in enumerate((0.1, 2.0, 4.0, 6.0)))


def test_means_of_an_image_with_holes_by_tiles(spark):
    random = np.random.default_rng(4)
    cells = {(int(y), int(x)): int(random.integers(0, 256)) for y, x in random.integers(0, 9, (50, 2))} | {(1023, 1023): 3, (1024, 1024): 8, (1024, 1023): 10}
    pixels = spark.createDataFrame([(0, y, x, g) for (y, x), g in cells.items()], "image_id long, y int, x int, g int")
    got = {(r["y"], r["x"]): r["g"] for r in homographies.smoothed(pixels, ("g",)).collect()}
    assert got.keys() == cells.keys()
    # the sums of a line are taken at its own pixels, as the two windows did
    line = {(y, x): [cells[y, k] for k in (x - 1, x, x + 1) if (y, k) in cells] for y, x in cells}
    for (y, x), g in got.items():
        near = [v for k in (y - 1, y, y + 1) for v in line.get((k, x), [])]
        assert abs(g - np.mean(near)) < 1e-12
    names = homographies.smoothed(pixels, ("g",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in names and homographies.smoothed(pixels, ("g",)).agg(F.count("g")).first()[0] == len(cells)
