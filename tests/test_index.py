"""Approximate neighbours: recall against all pairs, copies, ties and odd tables."""

import numpy as np
import pytest

from palimpsest.operators import index

ROWS = "id long, vec array<double>"


def frame(spark, vectors, ids=None):
    return spark.createDataFrame([(int(i if ids is None else ids[i]), [float(x) for x in v]) for i, v in enumerate(vectors)], ROWS)


def exact(vectors, ids, k):
    out = {}
    for i, v in enumerate(vectors):
        d = np.round(np.sqrt(((vectors - v) ** 2).sum(axis=1)), 9)
        near = sorted((x, j) for x, j in zip(d.tolist(), ids, strict=True) if j != ids[i])[:k]
        out[ids[i]] = [j for _, j in near]
    return out


def taken(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["id"], []).append((r["rank"], r["other"], r["distance"]))
    return {i: sorted(v) for i, v in out.items()}


def test_leaves_are_those_of_one_row_at_a_time():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 7))
    forest = index.grow(x, 3, 4, 5)
    got = forest.leaves(x)
    for i, v in enumerate(x):
        for t in range(3):
            node = 0
            for _ in range(4):
                node = 2 * node + 1 + int(v[forest.dimensions[t, node]] > forest.cuts[t, node])
            assert got[i, t] == node - 15 + 16 * t
    sizes = np.bincount(got[:, 0], minlength=16)[:16]
    assert sizes.min() >= 16 and sizes.sum() == 300  # medians halve the sample
    assert (index.grow(x[:0], 2, 0).leaves(x) == [[0, 1]] * 300).all()


@pytest.mark.parametrize("noise", [0.15, 0.4])
def test_recall(spark, noise):
    r = np.random.default_rng(2)
    centres = r.normal(size=(60, 24))
    vectors = centres[r.integers(0, 60, 3000)] + noise * r.normal(size=(3000, 24))
    ids = r.permutation(10_000)[:3000].tolist()
    got = taken(index.approximate_nearest(frame(spark, vectors, ids), 5, trees=8, leaf_rows=200))
    want = exact(vectors, ids, 5)
    recall = np.mean([len({o for _, o, _ in got.get(i, [])} & set(want[i])) / 5 for i in ids])
    assert recall >= 0.9
    where = {i: v for i, v in zip(ids, vectors, strict=True)}
    assert all(np.isclose(d, np.sqrt(((where[i] - where[o]) ** 2).sum()), atol=1e-8) for i in ids[:50] for _, o, d in got[i])


def test_copies_and_ties_go_by_id(spark):
    r = np.random.default_rng(3)
    vectors = r.integers(0, 3, (120, 3)).astype(float)
    vectors[:50] = 1.0
    ids = r.permutation(1000)[:120].tolist()
    got = taken(index.approximate_nearest(frame(spark, vectors, ids), 4, trees=2, leaf_rows=1000))
    want = exact(vectors, ids, 4)
    assert {i: [o for _, o, _ in v] for i, v in got.items()} == want  # one leaf is exact
    assert all([n for n, _, _ in v] == list(range(1, len(v) + 1)) for v in got.values())


def test_odd_tables(spark):
    assert index.approximate_nearest(frame(spark, []), 3).count() == 0
    assert index.approximate_nearest(frame(spark, [[1.0, 2.0]]), 3).count() == 0
    assert taken(index.approximate_nearest(frame(spark, [[1.0, 2.0]] * 3), 3)) == {i: [(n + 1, o, 0.0) for n, o in enumerate(x for x in range(3) if x != i)] for i in range(3)}


def test_nearest_of_equal_distances_are_those_of_least_ids_within_a_block(spark):
    """Many copies at one distance: the block keeps the least ids; a row's own id is left out."""
    import numpy as np

    from palimpsest.operators import matching

    r = np.random.default_rng(2)
    x = np.repeat(r.normal(size=(6, 64)), 50, axis=0)[r.permutation(300)]
    ids = r.permutation(300)
    order = np.argsort(ids)
    rows, other, distance = matching._best(x[:40], x[order], ids[:40], ids[order], 5, False)
    for i in range(40):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(axis=1)), 9)
        want = sorted((d[j], ids[j]) for j in range(300) if j != i)[:5]
        assert [(round(v, 9), o) for v, o in zip(distance[rows == i], ids[order][other[rows == i]], strict=True)] == want
    table = spark.createDataFrame([(0, int(i), [float(v) for v in row]) for i, row in zip(ids, x, strict=True)], "image_id int, id long, vec array<double>")
    got = {(v["id"], v["other"]) for v in matching.nearest(table, 5, across_images=True, block_rows=16).collect()}
    whole = matching._best(x, x[order], ids, ids[order], 5, False)
    assert got == set(zip(ids[whole[0]].tolist(), ids[order][whole[1]].tolist(), strict=True))
