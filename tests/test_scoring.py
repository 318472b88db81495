"""Goldens and properties of the pixel scores."""

import numpy as np
import pytest

from palimpsest.functions import grids
from palimpsest.operators import scoring as S


def sparse(spark, maps):
    """Label maps by image as rows; at least one row is needed for a schema."""
    rows = [(i, y, x, int(v)) for i, m in maps.items() for (y, x), v in np.ndenumerate(np.array(m)) if v]
    return spark.createDataFrame(rows, "image_id long, y int, x int, label int")


def scored(spark, detected, truth, **more):
    images = spark.createDataFrame([(i,) for i in set(detected) | set(truth)], "image_id long")
    return {r["image_id"]: r for r in S.scores(sparse(spark, detected), sparse(spark, truth), images, **more).collect()}


TWO_PARTS = [[1, 1, 1, 0, 0, 0], [1, 1, 1, 0, 0, 0], [0, 0, 0, 0, 0, 0], [0, 0, 1, 1, 1, 1]]
BOTH_PARTS_AND_NOISE = [[5, 5, 5, 0, 0, 0], [5, 5, 5, 0, 7, 7], [0, 0, 0, 0, 0, 0], [7, 0, 5, 5, 5, 0]]
ONE_PART = [[5, 5, 5, 0, 0, 0], [5, 5, 0, 0, 0, 0], [0] * 6, [0] * 6]
THREE_PARTS = [[1, 0, 1, 0, 1]]


def test_worked_example(spark):
    """9 of the 10 marked pixels are found, and 3 that are not marked."""
    r = scored(spark, {0: BOTH_PARTS_AND_NOISE}, {0: TWO_PARTS})[0]
    assert r["f1"] == pytest.approx(9 / 11) and r["f1_check"] == pytest.approx(9 / 11) and r["precision_check"] == pytest.approx(9 / 12)


def test_one_side_scores_nothing_when_checked(spark):
    r = scored(spark, {0: ONE_PART}, {0: TWO_PARTS})[0]
    assert r["f1"] > 0 and r["f1_check"] == 0 and r["precision_check"] == 0


def test_empty_maps(spark):
    full = TWO_PARTS
    found = scored(spark, {0: full, 1: [[0]], 3: [[0]]}, {0: [[0]], 1: full, 2: full, 3: [[0]]})
    for i in range(4):
        assert [found[i][c] for c in ("f1", "f1_check", "precision", "precision_check")] == [0, 0, 0, 0]


def test_two_of_three_parts_are_consistent(spark):
    detected, truth = {0: [[2, 0, 2, 0, 0]]}, {0: THREE_PARTS}
    assert scored(spark, detected, truth)[0]["f1_check"] == pytest.approx(0.8)
    flags = S.consistency(sparse(spark, detected), sparse(spark, truth)).collect()[0]
    assert flags["any_pair"] and not flags["all_hit"]


def test_identity_scores_one(spark):
    r = scored(spark, {0: TWO_PARTS}, {0: TWO_PARTS})[0]
    assert (r["f1"], r["f1_check"], r["precision"], r["precision_check"]) == (1, 1, 1, 1)


def test_diagonal_neighbours(spark):
    diagonal = sparse(spark, {0: [[1, 0], [0, 1]]})
    assert S.label_components(diagonal).select("component").distinct().count() == 2
    assert S.label_components(diagonal, eight=True).select("component").distinct().count() == 1


def test_labelling_is_the_same_transposed():
    random = np.random.default_rng(0)
    for _ in range(20):
        mask = random.random((9, 7)) < 0.5
        assert grids.label_regions(mask).max() == grids.label_regions(mask.T).max()


def test_spiral_is_one_region():
    spiral = np.array([[1, 1, 1, 1, 1], [0, 0, 0, 0, 1], [1, 1, 1, 0, 1], [1, 0, 0, 0, 1], [1, 1, 1, 1, 1]])
    assert grids.label_regions(spiral).max() == 1


def test_unknown_measure_is_left_out(spark):
    measured = S.pixel_measures(spark.createDataFrame([(0, 1, 9), (0, 0, 3)], "image_id long, d int, t int"))
    rows = S.chosen_measures(measured, ["f1", "beauty"]).collect()
    assert [(r["measure"], r["value"]) for r in rows] == [("f1", 1.0)]
    assert S.chosen_measures(measured, ["beauty"]).count() == 0


def test_folders_of_maps_to_scores(spark, tmp_path):
    from palimpsest.sources import evaluation, readers

    truth, found = np.array(TWO_PARTS), np.array(BOTH_PARTS_AND_NOISE)
    for folder in ("truth", "labels", "network"):
        (tmp_path / folder).mkdir()
    write = lambda path, a: (tmp_path / path).write_bytes(readers.encode_png(a.astype(np.uint8)))
    for name in ("one", "none", "broken"):
        write(f"truth/{name}.png", truth)
    write("labels/one.png", found)
    write("labels/more.png", found)
    (tmp_path / "labels" / "broken.png").write_bytes(b"no image")
    write("network/one.png", np.stack([(found == 5) * 200, (found == 7) * 150, found * 30], axis=2))
    rows = {r["image_id"]: r for r in evaluation.score_folders(spark, str(tmp_path / "labels"), str(tmp_path / "truth"), "labels").collect()}
    assert {k: (r["found"], r["readable"]) for k, r in rows.items()} == {"one": (True, True), "none": (False, False), "broken": (True, False)}
    assert rows["one"]["f1"] == pytest.approx(9 / 11) and rows["one"]["f1_check"] == pytest.approx(9 / 11) and rows["none"]["f1"] == rows["broken"]["f1_check"] == 0
    net = {r["image_id"]: r["f1"] for r in evaluation.score_folders(spark, str(tmp_path / "network"), str(tmp_path / "truth"), "network", check=False).collect()}
    assert net["one"] == pytest.approx(9 / 11)
    with pytest.raises(ValueError):
        evaluation.label_maps(spark, str(tmp_path), "no such kind")
