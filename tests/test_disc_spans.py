"""Discs around many inliers: each pixel of a model once, and few rows on the way."""

from palimpsest.operators import homographies as H


def test_discs_that_overlap_are_united_before_they_become_pixels(spark):
    side = 60
    pixels = spark.range(side * side).selectExpr("0L as image_id", f"cast(id div {side} as int) as y", f"cast(id % {side} as int) as x", "100 as g")
    sizes = H.settings(spark.sql(f"SELECT 0L AS image_id, {side} AS height, {side} AS width"))
    at = [(20 + i % 5, 20 + i // 5) for i in range(25)] + [(50, 5)]
    inliers = spark.createDataFrame([(0, 7, n, y, x, y + 4, x + 3, 1.0, 1.0, False) for n, (y, x) in enumerate(at)], "image_id long, seed long, id long, y int, x int, my int, mx int, scale double, mscale double, reversed boolean")
    models = spark.createDataFrame([(0, 7, [1.0, 0.0, 3.0, 0.0, 1.0, 4.0, 0.0, 0.0, 1.0], 1.0, 1.0)], "image_id long, seed long, h array<double>, s0 double, s1 double")
    found = H.grown_discs(pixels, inliers, models, sizes)
    want = {(y, x) for y in range(side) for x in range(side) if any((y - cy) ** 2 + (x - cx) ** 2 <= 256 for cy, cx in at) and y + 4 < side and x + 3 < side}
    got = {(r["y"], r["x"], r["side"]) for r in found.collect()}
    assert got == {(y, x, 1) for y, x in want} | {(y + 4, x + 3, 2) for y, x in want}
    # stretches meet a window over lines before pixels are made of them
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [max(high" in plan
