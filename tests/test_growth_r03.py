"""Steps whose time, memory or shuffled rows grew too fast: what they send, and that their results stay."""

import math

import numpy as np

from palimpsest.functions import fields, grids
from palimpsest.operators import features, forge, matching, raster, scoring, superpixels, templates
from palimpsest.session import durable
from test_superpixels import dense, plain_grown, plain_slic


def test_panels_send_each_line_of_an_image_once(spark):
    random, boxes = np.random.default_rng(5), []
    for t in range(40):
        y0, x0 = (int(v) for v in random.integers(0, 9, 2))
        boxes.append((t, t % 3, x0, x0 + int(random.integers(1, 30)), y0, y0 + int(random.integers(1, 40)), int(random.integers(1, 25)), int(random.integers(1, 25))))
    panels = spark.createDataFrame(boxes, "template long, image_id long, x0 int, x1 int, y0 int, y1 int, ih int, iw int")
    sent = templates.source_lines(panels).collect()
    assert len(sent) == sum(min(b[5] - b[4], b[6]) for b in boxes)
    got = sorted((r["template"], fy, r["y"]) for r in sent for fy in range(r["first_fy"], r["last_fy"] + 1))
    assert got == sorted((b[0], fy, (fy - b[4]) * b[6] // (b[5] - b[4])) for b in boxes for fy in range(b[4], b[5]))
    pixels = {(i, y, x): int(random.integers(0, 256)) for i in range(3) for y in range(25) for x in range(25)}
    rows = templates.place(panels, spark.createDataFrame([(*k, g) for k, g in pixels.items()], "image_id long, y int, x int, g int")).collect()
    wanted = [(b[0], fy, fx, pixels[b[1], (fy - b[4]) * b[6] // (b[5] - b[4]), (fx - b[2]) * b[7] // (b[3] - b[2])]) for b in boxes for fy in range(b[4], b[5]) for fx in range(b[2], b[3])]
    assert sorted(tuple(r) for r in rows) == sorted(wanted)


def one_clone(target, source, mask, rounds=500):
    """The definition, one raster."""
    out, inner = target.astype(float).copy(), mask.astype(bool).copy()
    inner[0] = inner[-1] = inner[:, 0] = inner[:, -1] = False
    laplace = 4 * source - sum(grids.shifted(source.astype(float), dy, dx) for dy, dx in grids.FOUR)
    parity = np.add(*np.indices(target.shape)) % 2
    for _ in range(rounds):
        for colour in (0, 1):
            new = (laplace + sum(grids.shifted(out, dy, dx) for dy, dx in grids.FOUR)) / 4
            out = np.where(inner & (parity == colour), new, out)
    return out


def test_clones_of_many_rasters_are_those_of_each(spark):
    random = np.random.default_rng(6)
    for shape in ((30, 8, 8), (4, 1, 5), (5, 13, 6), (1, 2, 2)):
        target, source = random.integers(0, 256, (2, *shape)).astype(float)
        mask = random.random(shape) < 0.6
        for rounds in (0, 1, 7, 500):
            got = grids.poisson_clones(target, source, mask, rounds)
            assert np.allclose(got, [one_clone(*of, rounds) for of in zip(target, source, mask, strict=True)], rtol=0, atol=1e-9)
    images = {i: random.integers(0, 256, (8, 8) if i % 3 else (5, 11)).astype(float) for i in range(20)}
    packed = spark.createDataFrame([(i, *a.shape, a.ravel().tolist()) for i, a in images.items()], "image_id long, height int, width int, values array<double>")
    got = {r["image_id"]: np.array(r["values"]).reshape(r["height"], r["width"]) for r in forge.poisson_move(packed, 160.0, 2, 3).collect()}
    assert got.keys() == images.keys()
    assert all(np.allclose(got[i], one_clone(a, grids.shifted(a, 2, 3), grids.shifted(a > 160.0, 2, 3, False)), rtol=0, atol=1e-9) for i, a in images.items())


def one_blur_vector(block):
    """The definition, one block."""
    y, x = np.indices(block.shape).astype(float)
    m = block.sum() or 1.0
    u, v = x - (block * x).sum() / m, y - (block * y).sum() / m
    mu = lambda p, q: (block * u**p * v**q).sum()

    def invariant(p, q):
        if (p + q) % 2 == 0:
            return 0.0
        return mu(p, q) - sum(math.comb(p, n) * math.comb(q, k) * invariant(p - n, q - k) * mu(n, k) for n in range(p + 1) for k in range(q + 1) if 0 < n + k < p + q) / m

    return [invariant(p, o - p) for o in (3, 5, 7) for p in range(o + 1)]


def test_features_of_many_blocks_are_those_of_each(spark):
    random = np.random.default_rng(7)
    images = {i: random.integers(0, 256, (8, 8) if i % 3 else (3 + i // 3, 9)).astype(float) for i in range(8)} | {8: np.zeros((8, 8))}
    packed = spark.createDataFrame([(i, *a.shape, a.ravel().tolist()) for i, a in images.items()], "image_id long, height int, width int, values array<double>")
    places = sorted((i, y, x) for i, a in images.items() for y in range(0, a.shape[0] - 3, 2) for x in range(0, a.shape[1] - 3, 2))
    plain = {"BLUR": one_blur_vector, "NO": lambda b: b.ravel(), "SVD": lambda b: np.linalg.svd(b, compute_uv=False), "DSIFT": features.KERNELS["DSIFT"]}
    for kernel, make in plain.items():
        got = {(r["image_id"], r["block_y"], r["block_x"]): np.array(r["vec"]) for r in features.block_vectors(packed, kernel, 4, 2).collect()}
        assert sorted(got) == places
        for i, y, x in places:
            wanted = np.array(make(images[i][y : y + 4, x : x + 4]))
            assert np.allclose(got[i, y, x], wanted, rtol=1e-9, atol=1e-9 * max(1.0, np.abs(wanted).max())), (kernel, i, y, x)
    blocks = random.integers(0, 256, (50, 4, 4)).astype(float)
    assert (features.BATCHED["BLUR"](blocks) == np.array([features.BATCHED["BLUR"](b[None])[0] for b in blocks])).all()


def test_components_of_many_images_at_once(spark, monkeypatch):
    monkeypatch.setattr(scoring, "TOGETHER", 150)  # images go on from batch to batch
    random = np.random.default_rng(8)
    rows = []
    for i in range(60):
        h, w = (25, 40) if i == 7 else (int(random.integers(1, 12)), int(random.integers(1, 12)))
        label = random.integers(0, 3, (h, w))
        rows += [(None if i == 3 else i - 5, int(y) - 2, int(x) + i, int(label[y, x])) for y, x in zip(*np.nonzero(label), strict=True)]
    spiral = [(900, y, x, 1) for y in range(0, 21, 2) for x in range(21)] + [(900, y, 20 if y % 4 == 1 else 0, 1) for y in range(1, 20, 2)]
    rows += spiral
    df = spark.createDataFrame(rows, "image_id long, y int, x int, label int")
    for eight in (False, True):
        wanted = set()
        for image in {r[0] for r in rows}:
            for k in (1, 2):
                own = [r for r in rows if r[0] == image and r[3] == k]
                if own:
                    y0, x0 = min(r[1] for r in own), min(r[2] for r in own)
                    mask = np.zeros((60, 120), dtype=bool)
                    mask[[r[1] - y0 for r in own], [r[2] - x0 for r in own]] = True
                    number = grids.label_regions(mask, grids.EIGHT if eight else grids.FOUR)
                    name = {}
                    for r in own:
                        at = number[r[1] - y0, r[2] - x0]
                        name[at] = min(name.get(at, 1 << 60), r[1] * (1 << 20) + r[2])
                    wanted |= {(*r, name[number[r[1] - y0, r[2] - x0]]) for r in own}
        got = scoring.label_components(df, eight)
        assert {tuple(r) for r in got.collect()} == wanted and got.count() == len(rows)
        assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()  # no call an image
    assert scoring.label_components(df.limit(0)).count() == 0


def test_components_are_made_once(spark):
    rows = [(i, y, x, 1) for i in range(4) for y, x in ((0, 0), (0, 1), (4, 4), (7, 7))]
    px = spark.createDataFrame([(i, y, x, y * 8 + x) for i in range(4) for y in range(8) for x in range(8)], "image_id long, y int, x int, g int")
    mask = spark.createDataFrame(rows, "image_id long, y int, x int, label int")
    parts = scoring.label_components(mask)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(3)], "donor long, host long")
    made = [scoring.consistency(mask, mask), forge.isolated(parts, 1), *forge.random_copy_move(px, parts, 8, 8, 2, 2, 2), *forge.splice_to_tiles(px, parts, px, parts, pairs, 8, 8, 2, 2, 2)]
    assert all("MapInPandas" not in one._jdf.queryExecution().optimizedPlan().toString() for one in made)


def test_fields_of_many_rasters_are_those_of_each(spark):
    random = np.random.default_rng(9)
    images = {i: random.integers(0, 20, (8, 8) if i % 3 else (7, 12)).astype(float) for i in range(9)}
    packed = spark.createDataFrame([(i, *a.shape, a.ravel().tolist()) for i, a in images.items()], "image_id long, height int, width int, values array<double>")
    for descriptor in ("NO", "ZERNIKE"):
        wanted = set()
        for i, a in images.items():
            found, cost = fields.match_field(fields.raw_vectors(a, 3) if descriptor == "NO" else fields.zernike_vectors(a, 3), 2)
            wanted |= {(i, y, x, *map(int, found[y, x]), cost[y, x]) for y, x in np.argwhere(np.isfinite(cost)).tolist()}
        assert {tuple(r) for r in matching.dense_field(packed, 3, 2, descriptor=descriptor).collect()} == wanted
    stack = np.stack([fields.raw_vectors(random.random((8, 8)), 3) for _ in range(5)])
    assert (fields.match_fields(stack, 2)[1] == np.stack([fields.match_field(v, 2)[1] for v in stack])).all()


def test_superpixels_meet_centres_by_tiles(spark):
    random = np.random.default_rng(10)
    image = random.integers(0, 256, (70, 135, 1))
    px = spark.createDataFrame([(0, y, x, int(image[y, x, 0])) for y, x in np.ndindex(70, 135)], "image_id long, y int, x int, g int")
    for n, rounds in ((60, 2), (2, 1)):
        got = superpixels.slic(px, spark.createDataFrame([(0, n)], "image_id long, segments int"), 40.0, rounds)
        assert (dense(got, (70, 135)) == plain_slic(image, n, 40.0, rounds)).all()
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.splitlines() if "Aggregate [" in line and " y#" in line.split("]")[0]]  # no row for each pixel and centre, to be aggregated again


def test_growth_reads_the_segments_no_more_once_it_has_pairs(spark):
    random = np.random.default_rng(11)
    labels = np.add.outer(np.arange(140) // 9 * 15, np.arange(133) // 9)
    rows = [(0, y, x, int(labels[y, x]), int(random.integers(0, 30))) for y, x in np.ndindex(labels.shape)]
    px = durable(spark.createDataFrame(rows, "image_id long, y int, x int, segment long, g int"), "whole")
    segments = px.select("image_id", "y", "x", "segment")
    matches = [tuple(map(int, m)) for m in random.integers(0, 133, (12, 4))]
    got = superpixels.grown(segments, superpixels.described(px.select("image_id", "y", "x", "g"), segments), spark.createDataFrame([(0, *m) for m in matches], "image_id long, y int, x int, my int, mx int"), 2.0)
    assert not any("/whole-" in f for f in got.inputFiles())
    assert {r["segment"] for r in got.collect()} == plain_grown(labels, np.array([r[4] for r in rows]).reshape(labels.shape), matches, 2.0, 3)


def plain_meetings(labels, steps):
    out = {}
    for y, x in np.ndindex(labels.shape):
        for dy, dx in steps:
            if 0 <= y + dy < labels.shape[0] and 0 <= x + dx < labels.shape[1] and labels[y, x] != labels[y + dy, x + dx]:
                pair = int(labels[y, x]), int(labels[y + dy, x + dx])
                out[pair] = out.get(pair, 0) + 1
    return out


def test_segments_meet_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(superpixels, "PAIRED", 16)
    labels = np.random.default_rng(12).integers(5, 9, (37, 50)) * 3
    df = spark.createDataFrame([(4, y - 20, x + 3, int(labels[y, x])) for y, x in np.ndindex(labels.shape)], "image_id long, y int, x int, segment long")
    for steps in (grids.FOUR, tuple(grids.box(3))):
        got = {(r["segment"], r["to"]): r["n"] for r in superpixels.meetings(df, steps).collect()}
        assert got == plain_meetings(labels, steps)


def test_masks_are_closed_by_tiles(spark):
    random = np.random.default_rng(13)
    for radius, side in ((2, 16), (4, 128)):
        mask = random.random((45, 50)) < 0.1
        df = spark.createDataFrame([(0, int(y), int(x)) for y, x in np.argwhere(mask)] + [(1, -1, 3), (2, 44, 50)], "image_id long, y int, x int")
        element = grids.disc(radius)
        wanted = {(0, int(y), int(x)) for y, x in np.argwhere(grids.MORPHOLOGY["CLOSE"](mask, element))}
        got = {tuple(r) for r in raster.closed(df, element, 45, 50, side).collect()}
        assert {r for r in got if r[0] == 0} == wanted
        assert got == {tuple(r) for r in raster.erode(raster.dilate(df, element, 45, 50), element, 45, 50).collect()}


def plain_without_fragments(segments, least):
    pieces = np.zeros(segments.shape, int)
    for k in np.unique(segments):
        number = grids.label_regions(segments == k)
        for n in range(1, number.max() + 1):
            y, x = np.argwhere(number == n)[0]
            pieces[number == n] = y * (1 << 20) + x
    for _ in range(20):
        names, sizes = np.unique(pieces, return_counts=True)
        size, edges = dict(zip(names.tolist(), sizes.tolist(), strict=True)), plain_meetings(pieces, grids.FOUR)
        goal = {a: min((-n, q) for (p, q), n in edges.items() if p == a and size[q] >= least)[1] for a in {p for p, q in edges if size[p] < least <= size[q]}}
        if not goal:
            break
        pieces = np.vectorize(lambda p: goal.get(p, p))(pieces)  # noqa: B023
    return pieces


def test_fragments_join_by_sizes_and_edges(spark):
    random = np.random.default_rng(14)
    for least in (4, 9):
        a = np.where(random.random((40, 45)) < 0.4, random.integers(0, 9, (40, 45)), np.add.outer(np.arange(40) // 12 * 4, np.arange(45) // 12))
        df = spark.createDataFrame([(0, y, x, int(a[y, x])) for y, x in np.ndindex(a.shape)], "image_id long, y int, x int, segment int")
        assert (dense(superpixels.without_fragments(df, least), a.shape) == plain_without_fragments(a, least)).all()


def test_pixels_are_not_broadcast_for_their_small_files(spark):
    px = durable(spark.createDataFrame([(0, y, x, 0, y) for y, x in np.ndindex(8, 8)], "image_id long, y int, x int, segment long, g int"), "whole")
    about = superpixels.described(px.select("image_id", "y", "x", "g"), px.select("image_id", "y", "x", "segment"))
    assert "Broadcast" not in about._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in about.collect()] == [(0, 0, 3.5, 3.5, 3.5, 64)]
