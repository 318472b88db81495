"""Small fixtures for tabular, raster, forgery, matching and verification operators, sources and sinks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import estimators, grids, inpainting, paths
from palimpsest.operators import features, forge, images, matching, raster, scenes, tabular, templates, verify
from palimpsest.operators.graph import connected
from palimpsest.sources import readers, sinks

PX = "image_id long, y int, x int, g int"


def pixels(spark, array, image=0):
    return spark.createDataFrame([(image, y, x, int(v)) for (y, x), v in np.ndenumerate(array)], PX)


def dense(df, shape, value="g"):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r["y"], r["x"]] = r[value]
    return out


def test_quarter_turns_and_flips(spark):
    a = np.arange(6).reshape(2, 3)
    for turns in range(5):
        turned = raster.rotate90(pixels(spark, a), 2, 3, turns)
        want = np.rot90(a, turns)
        assert (dense(turned, want.shape) == want).all()
    twice = raster.flip(raster.flip(pixels(spark, a), 2, 3, "vertical"), 2, 3, "vertical")
    assert (dense(twice, a.shape) == a).all()


def test_morphology_agrees_with_the_packed_tier(spark):
    a = (np.random.default_rng(3).random((6, 7)) < 0.5).astype(int)
    mask = pixels(spark, a).filter("g = 1").select("image_id", "y", "x")
    for element in (grids.disc(1), [(0, 0), (0, 1)]):
        assert (dense(raster.dilate(mask, element, 6, 7).withColumn("g", F.lit(1)), a.shape) == grids.dilate(a, element)).all()
        assert (dense(raster.erode(mask, element, 6, 7).withColumn("g", F.lit(1)), a.shape) == grids.erode(a, element)).all()


def test_raw_labels_wrap(spark):
    packed = spark.createDataFrame([(5, [0.0, 1.0, 258.0, 0.0])], "image_id long, values array<double>")
    files = sinks.raw_label_files(packed).select(F.col("image_id").alias("path"), "content")
    rows = images.raw_labels(files, 2).collect()
    assert sorted((r["y"], r["x"], r["label"]) for r in rows) == [(0, 1, 1), (1, 0, 2)]


def test_png_round_trip(spark, tmp_path):
    random = np.random.default_rng(1)
    for image in (random.integers(0, 256, (5, 4, 3)).astype(np.uint8), random.integers(0, 65536, (3, 6, 1)).astype(np.uint16)):
        assert (readers.decode_png(readers.encode_png(image)) == image).all()
    (tmp_path / "a.png").write_bytes(readers.encode_png(np.full((2, 2), 7, np.uint8)))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = {os.path.basename(r["path"]): r for r in readers.read_images(spark, str(tmp_path)).collect()}
    assert rows["a.png"]["values"] == [7.0] * 4 and rows["b.png"]["values"] is None


def test_options_and_catalogue(spark, tmp_path):
    (tmp_path / "x.conf").write_text("# c\nbl.blockSize = 16\nft.featvec=SIFT # kind\nbl.blockSize = 8\n")
    found = {(r["group"], r["name"]): r["value"] for r in readers.with_overrides(readers.read_options(spark, str(tmp_path / "x.conf")), {"featvec": "HU"}).collect()}
    assert found == {("bl", "blockSize"): "8", ("ft", "featvec"): "HU"}
    entry = {"path": "p", "prefix": "q", "opaque": 1, "l2dist": 0, "insert_positions": "1,2, 3,4", "source_positions": "5,6,7,8"}
    rows = readers.splice_catalogue(spark, {"a": entry}).orderBy("snippet").collect()
    assert [(r["tx"], r["ty"], r["sx"], r["sy"]) for r in rows] == [(1, 2, 5, 6), (3, 4, 7, 8)]


def test_csv_sink_and_index_column(spark, tmp_path):
    (tmp_path / "s.csv").write_text(",F1,F1-Check,Precision,Precision-Check,Method,Detection-Map\n0,0.5,0.5,1,1,HFPM,a/b/c.png\n")
    scores = readers.read_csv(spark, str(tmp_path / "s.csv"), readers.SCORES, index=True)
    assert scores.columns[0] == "F1" and scores.first()["Method"] == "HFPM"
    path = sinks.write_csv(scores, str(tmp_path / "out"))
    assert readers.read_csv(spark, path, readers.SCORES).count() == 1


def test_paths(spark):
    row = spark.createDataFrame([("output/simple/a/b/7/map.v1.png",)], "p string").select(paths.modality(F.col("p")).alias("m"), paths.stem(F.col("p")).alias("s"), paths.parent(F.col("p")).alias("d"), paths.padded(F.lit(7), 5).alias("n"), paths.numbers(F.lit("1, x,3")).alias("i")).first()
    assert tuple(row) == ("simple/a/b", "map.v1", "output/simple/a/b/7", "00007", [1, 3])


def test_dense_numbers_have_no_gap(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    numbered = tabular.dense_numbers(rows, ["k"]).collect()
    assert all(r["k"] == r["number"] for r in numbered) and len(numbered) == 1000


def test_dense_numbers_of_many_wide_rows_and_a_frequent_value(spark):
    from pyspark.sql import functions as F

    rows = spark.range(500_000, numPartitions=7).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") * 7919 % 500_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    numbered = tabular.dense_numbers(rows, ["k"]).cache()
    assert tuple(numbered.agg(F.count(F.lit(1)), F.count_distinct("number"), F.min("number"), F.max("number")).first()) == (500_000, 500_000, 0, 499_999)
    ends = numbered.groupBy("k").agg(F.min("number").alias("low"), F.max("number").alias("high"), F.count(F.lit(1)).alias("n"))
    assert ends.filter("high - low + 1 <> n").count() == 0 and numbered.alias("a").join(numbered.alias("b"), F.expr("a.number + 1 = b.number")).filter("a.k > b.k").count() == 0
    assert tabular.dense_numbers(rows.limit(0), ["k"]).count() == 0
    numbered.unpersist()


def test_repaired_ranges(spark):
    cases = [("1", "3", "1"), ("1", "x", "1"), ("5", "3", "1"), ("2", "3", "0"), ("x", "3", "1"), ("0", "1", "0.25")]
    rows = spark.createDataFrame(cases, "a string, b string, c string").select(tabular.repaired_range(F.col("a"), F.col("b"), F.col("c")).alias("r")).collect()
    assert [r["r"] for r in rows] == [[1, 2, 3], [1], [5], [2], None, [0, 0.25, 0.5, 0.75, 1]]


def test_greedy_fill_is_in_order_and_all_or_nothing(spark):
    slots = spark.createDataFrame([(1, 1, "W", 2.0), (1, 2, "W", 2.0), (2, 1, "W", 9.0)], "template int, slot int, klass string, ratio double")
    pool = spark.createDataFrame([(t, i, "W", r) for t in (1, 2) for i, r in ((10, 5.0), (11, 2.5), (12, 2.0))], "template int, image int, klass string, ratio double")
    rows = tabular.greedy_fill(slots, pool, {"W": 1.0}, 1.0).orderBy("slot").collect()
    assert [tuple(r) for r in rows] == [(1, 1, 11), (1, 2, 12)]


def test_tolerance_join_against_brute_force(spark):
    random = np.random.default_rng(5)
    a = [(i, "W" if i % 2 else "M", float(v)) for i, v in enumerate(np.round(random.random(80) * 20, 2))]
    b = [(i, "W" if i % 3 else "M", float(v)) for i, v in enumerate(np.round(random.random(60) * 20, 2))]
    got = tabular.tolerance_join(spark.createDataFrame(a, "a int, k string, r double"), spark.createDataFrame(b, "b int, k string, r double"), "k", "r", {"W": 0.5}, 2.0)
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and abs(x[2] - y[2]) <= (0.5 if x[1] == "W" else 2.0))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == want


def test_partners_are_others(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(9)] + [(99, 50)], "k int, s int")
    got = tabular.partners(rows, "k", "s", 1).collect()
    assert len(got) == 9 and all(r["k"] != r["partner"] and r["k"] % 3 == r["partner"] % 3 for r in got)


def test_copy_move_truth(spark):
    a = np.zeros((6, 6), int)
    a[1:3, 1:3] = [[9, 8], [7, 6]]
    objects = pixels(spark, a).filter("g > 0")
    out, truth = forge.copy_move(pixels(spark, a), objects, F.lit(2), F.lit(3), 6, 6)
    want = a.copy()
    want[3:5, 4:6] = a[1:3, 1:3]
    assert (dense(out, a.shape) == want).all()
    assert truth.groupBy("part").count().rdd.collectAsMap() == {"source": 4, "copy": 4}


def test_inpainting_keeps_the_rest():
    image = np.tile(np.array([10.0, 20.0] * 5), (10, 1))
    hole = np.zeros((10, 10), bool)
    hole[2:4, 2:4] = True
    out = inpainting.inpaint(np.where(hole, 99, image), hole, 3)
    assert (out == image).all()


def test_shift_votes(spark):
    random = np.random.default_rng(2)
    rows = [(0, i // 10, i % 10, i // 10 + 7, i % 10 + 3) for i in range(60)] + [(0, int(a), int(b), int(c), int(d)) for a, b, c, d in random.integers(20, 90, (10, 4))]
    matches = spark.createDataFrame(rows, "image_id long, y int, x int, my int, mx int")
    kept = verify.vote(matches, 50)
    assert kept.count() == 60 and kept.select("dy", "dx").distinct().collect()[0][:] == (7, 3)


def test_affine_fits():
    random = np.random.default_rng(4)
    a = random.random((40, 2)) * 100
    m = np.array([[0.9, -0.2, 5], [0.3, 1.1, -7]])
    b = a @ m[:, :2].T + m[:, 2]
    b[:8] += 60
    fitted, near = estimators.estimate("ownransac", a, b, 1.0)
    assert np.allclose(fitted[:2], m) and near.sum() == 32


def test_connected_chain(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(30)] + [(1, 5, 9)], "g int, a int, b int")
    got = {(r["g"], r["id"]): r["component"] for r in connected(edges, ["g"]).collect()}
    assert all(got[0, i] == 0 for i in range(31)) and got[1, 9] == 5


def test_ratio_ties_are_broken_by_id(spark):
    rows = spark.createDataFrame([(0, i, [float(v)]) for i, v in enumerate((0, 1, -1, 5))], "image_id long, id int, vec array<double>")
    near = matching.nearest(rows, 2).filter("id = 0").orderBy("rank").collect()
    assert [r["other"] for r in near] == [1, 2]
    assert matching.ratio_matches(matching.nearest(rows, 2), 0.6).filter("id = 0").count() == 0


def test_nearest_in_blocks_equals_one_block(spark):
    v = np.random.default_rng(6).random((90, 4))
    rows = spark.createDataFrame([(0, i, r.tolist()) for i, r in enumerate(v)], "image_id long, id int, vec array<double>")
    one, many = (sorted(map(tuple, matching.nearest(rows, 3, block_rows=b).collect())) for b in (1000, 20))
    assert one == many


def test_last_criterion_decides(spark):
    pairs = spark.createDataFrame([((0, 0), (9, 9))], "a struct<y:int,x:int>, b struct<y:int,x:int>")
    assert matching.accepted(pairs, [matching.far_enough(5.0)], [F.lit(False), F.lit(True)]).count() == 1
    assert matching.accepted(pairs, [matching.far_enough(50.0)], [F.lit(True)]).count() == 0


def test_blocks_cover_each_window(spark):
    cells = features.blocks(pixels(spark, np.arange(35).reshape(5, 7)), 5, 7, 3, 2)
    assert cells.count() == 2 * 3 * 9 and cells.groupBy(*features.KEY).count().filter("count <> 9").count() == 0
    assert features.blocks(pixels(spark, np.zeros((5, 7), int)), 5, 7, 3, 2, regions=[(0, 0, 3, 3)]).count() == 9


def test_pca_keeps_distances(spark):
    v = np.random.default_rng(8).random((50, 3)) @ np.random.default_rng(9).random((3, 6))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id int, vec array<double>")
    got = np.array([r["vec"] for r in features.reduce_by_pca(rows, 6, 3).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(got[0] - got[1:], axis=1), np.linalg.norm(v[0] - v[1:], axis=1))


def test_templates(spark):
    doc = '{"orig_height":100,"orig_width":1,"aspect_rate":2.0,"001":{"bbox":{"x0":0.0,"x1":0.5,"y0":0.0,"y1":0.5},"class":"Microscopy"}}'
    rows = templates.parse_templates(spark.createDataFrame([(1, doc)], "k int, d string"), "k", "d").collect()
    assert [(r["width"], r["x1"], r["y1"], r["ratio"]) for r in rows] == [(200, 100, 50, 2.0)]


def test_area_rules_need_a_marked_counterpart(spark):
    mask = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 5, 5), (0, 5, 6), (0, 9, 9)], "image_id long, y int, x int")
    m = spark.createDataFrame([(0, 0, 0, 5, 5)], "image_id long, y int, x int, my int, mx int")
    assert sorted((r["y"], r["x"]) for r in verify.area_rules(mask, m, 2).collect()) == [(0, 0), (0, 1), (5, 5), (5, 6)]
    assert {r["label"] for r in verify.shared_labels(mask, m).collect()} == {1}


def test_ward_and_single_linkage(spark):
    points = spark.createDataFrame([(0, i, y, x) for i, (y, x) in enumerate([(0, 0), (0, 3), (0, 6), (50, 50)])], "image_id long, id int, y int, x int")
    assert sorted(r["cluster"] for r in verify.single_linkage(points, 3.0).collect()) == [0, 0, 0, 3]
    assert sorted(r["cluster"] for r in verify.ward_linkage(points, 20.0).collect()) == [0, 0, 0, 3]


@pytest.mark.parametrize("name", ["score_pivot", "ctp_scores", "ar_tolerance_join", "similarity_self_join", "shift_votes", "shift_marks", "copy_regions_text", "keypoint_matches", "grown_segments", "cluster_linked", "figure_assembly", "template_explode"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    from palimpsest.plans import registry

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{folder}/{t}')")
    df = registry.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    want = con.execute(registry.ORACLES[name])
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_every_template_is_assembled(spark, tmp_path):
    from palimpsest.plans import forgery, maps

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    want, px = {}, {}
    for r in maps.pixels(spark, folder).collect():
        px[r["image_id"], r["y"], r["x"]] = r["g"]
    for r in forgery.template_explode(spark, folder).collect():
        h, w, side = r["y1"] - r["y0"], r["x1"] - r["x0"], forgery.SIDE
        values = [px[r["template"] % 50, y * side // h, x * side // w] for y in range(h) for x in range(w) if (r["template"] % 50, y * side // h, x * side // w) in px]
        n, total = want.get(r["template"], (0, 0))
        want[r["template"]] = n + len(values), total + sum(values)
    got = {r["template"]: (r["pixels"], r["total"]) for r in forgery.figure_assembly(spark, folder).collect()}
    assert len(got) == 100 and got == want


def test_every_slot_is_tried(spark):
    from palimpsest.plans import tabular as plans

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    slots = {r["panel"]: (r["klass"], r["ratio"]) for r in plans.panels(spark, folder).collect()}
    templates = max(slots) // 6 + 1
    pools = [[] for _ in range(templates)]
    for r in spark.read.parquet(f"{folder}/part.parquet").orderBy("p_partkey").collect():
        pools[r["p_partkey"] % templates].append((r["p_partkey"], r["p_brand"], r["p_size"] / 10))
    want = []
    for t, pool in enumerate(pools):
        rows = []
        for s in sorted(s for s in slots if s // 6 == t):
            klass, ratio = slots[s]
            image = next((p for p in pool if p[1] == klass and abs(p[2] - ratio) <= (2.0 if klass == "Brand#11" else 2.5)), None)
            if image is None:
                rows = []
                break
            pool.remove(image)
            rows.append((t, s, image[0]))
        want += rows
    got = sorted(map(tuple, plans.greedy_fill(spark, folder).collect()))
    assert got == want and max(s for _, s, _ in got) > 40


def test_every_text_is_matched_under_its_own_id(spark, tmp_path):
    from palimpsest.plans import detection

    text = "one two three x one two three"
    spark.createDataFrame([(0, text), (1, text), (3, "no such words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, 1, text)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    ids = ["item 0", "item 1", "turn 0 1"]
    pairs = [(1, 5), (2, 6)]
    votes = detection.shift_votes(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, votes)) == [(i, x, mx, 4, 2) for i in ids for x, mx in pairs]
    marks = detection.shift_marks(spark, str(tmp_path)).collect()
    assert {r["image_id"] for r in marks} == set(ids) and len(marks) == 12
    regions = detection.copy_regions_text(spark, str(tmp_path)).collect()
    assert sorted((r["image_id"], r["x"], r["label"]) for r in regions) == [(i, x, 1) for i in ids for x in (1, 2, 5, 6)]


def test_keypoints_of_any_gray_level_match(spark):
    import math

    at = lambda t: [math.cos(t), math.sin(t)]
    rows = [(0, 0, 0, 0, 10, 0, at(0.0)), (0, 1, 0, 90, 200, 0, at(0.01)), (0, 2, 300, 300, 10, 0, at(0.8)), (0, 3, 0, 95, 200, 1, at(0.001))]
    rows += [(1, i, y, x, 10, 0, at(t)) for i, (y, x, t) in enumerate([(0, 0, 0.0), (0, 200, 0.01), (9, 0, 0.5), (9, 200, 0.51), (900, 900, 1.0), (900, 1200, 1.01)])]
    points = spark.createDataFrame(rows, "image_id int, id int, y int, x int, gray int, octave int, vec array<double>")
    found = lambda **more: sorted(map(tuple, matching.bucketed_matches(points, "gray", 0.5, 2.0, **more).collect()))
    assert found(octave="octave") == [(0, 0, 1), (1, 0, 1), (1, 2, 3), (1, 4, 5)]
    assert (0, 0, 3) in found()
    assert [r for r in found(octave="octave", neighbours=2) if r[0] == 1] == [(1, 0, 1), (1, 2, 3)]
    many = spark.range(10000).selectExpr("cast(id div 5000 as int) as image_id", "id", "0 as octave", "cast(id % 250 as int) as gray")
    cut = {(r["gray"], r["bucket"]) for r in matching.gray_buckets(many, "gray").select("gray", "bucket").distinct().collect()}
    assert cut == {(g, b) for g in range(250) for b in range(7) if max(0, b * 40 - 10) <= g <= b * 40 + 40}


def test_files_samples_and_matches(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "annotations.json").write_text("{}")
    (tmp_path / "a" / "x.txt").write_text("no")
    assert [os.path.basename(r["path"]) for r in readers.list_files(spark, str(tmp_path), "*.json").collect()] == ["annotations.json"]
    samples = spark.createDataFrame([("m", "op", 1, "{}")], "modality string, op string, index int, annotation string")
    sinks.write_samples(samples, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/samples")).count() == 1 and tuple(spark.read.json(str(tmp_path / "out/annotations")).select("modality", "op", "index", "annotation").first()) == ("m", "op", 1, "{}")
    assert sinks.write_csv(samples, str(tmp_path / "csv")) != sinks.write_csv(samples, str(tmp_path / "csv"))
    shown = sinks.thumbnails(spark.createDataFrame([(7, bytearray(b"abc"))], "image_id long, content binary")).first()
    assert tuple(shown) == (7, '<img src="data:image/png;base64,YWJj">')
    matches = spark.createDataFrame([(0, 0, 1, 1, 5, 5, 0.5), (0, 0, 1, 1, 6, 6, 0.1), (0, 0, 1, 1, 7, 7, 0.9)], readers.MATCHES)
    sinks.write_matches(matches, str(tmp_path / "matches"))
    stacked = matching.planes(readers.read_matches(spark, str(tmp_path / "matches")).drop("plane"), 2)
    assert sorted((r["plane"], r["my"]) for r in stacked.collect()) == [(0, 6), (1, 5)]


def test_missing_masks_are_zeros_and_rows_are_observed(spark):
    shown = spark.createDataFrame([(1, 1, 2, [3.0, 4.0]), (2, 1, 2, [5.0, 6.0])], "image_id long, height int, width int, values array<double>")
    got = {r["image_id"]: r["mask"] for r in readers.masks_or_zeros(shown, shown.filter("image_id = 1")).collect()}
    assert got == {1: [3.0, 4.0], 2: [0.0, 0.0]}
    rows, watch = sinks.observed(spark.range(5), "seen")
    rows.write.format("noop").mode("overwrite").save()
    assert watch.get["rows"] == 5


def test_contact_sheet_and_free_strip(spark):
    p = spark.createDataFrame([(1, "001", 100, 100, 0, 50, 10, 50, "W", 1.0), (1, "002", 100, 100, 50, 100, 5, 50, "W", 1.0)], "template int, panel string, height int, width int, x0 int, x1 int, y0 int, y1 int, class string, ratio double")
    sides = {r["panel"]: r["side"] for r in templates.free_strip(p, 8).collect()}
    assert sides == {"001": "top", "002": "bottom"}
    s = spark.createDataFrame([(1, i, 10, 10) for i in range(5)], "sheet int, panel int, h int, w int")
    assert [(r["y0"], r["x0"]) for r in templates.contact_sheet(s).orderBy("panel").collect()] == [(2, 2), (2, 16), (2, 30), (16, 2), (16, 16)]


@pytest.mark.parametrize(("turns", "mirrored", "up", "down"), [(0, False, 1, 1), (1, False, 1, 1), (2, True, 2, 1), (3, True, 3, 2), (1, True, 1, 2)])
def test_turned_copies_against_arrays(spark, turns, mirrored, up, down):
    image = np.arange(240).reshape(12, 20) % 251
    mask = np.zeros((12, 20), bool)
    mask[1:4, 2:7] = [[1, 1, 0, 1, 1], [1, 1, 1, 1, 0], [0, 1, 1, 1, 1]]
    objects = spark.createDataFrame([(0, int(y), int(x)) for y, x in np.argwhere(mask)], "image_id long, y int, x int")
    out, truth = forge.forge("copy_move_forgery", pixels(spark, image), objects, 12, 20, dy=3, dx=6, turns=turns, mirrored=mirrored, up=up, down=down)

    def shaped(a):
        a = np.rot90(a[:, ::-1] if mirrored else a, -turns)
        h, w = (max(1, n * up // down) for n in a.shape)
        return a[np.ix_(np.arange(h) * a.shape[0] // h, np.arange(w) * a.shape[1] // w)]

    want, copied, taken = image.copy(), np.zeros_like(mask), np.zeros_like(mask)
    at = shaped(np.arange(240).reshape(12, 20)[1:4, 2:7])
    for (r, c), hit in np.ndenumerate(shaped(mask[1:4, 2:7])):
        y, x = 4 + r, 8 + c
        if hit and y < 12 and x < 20 and not mask[y, x]:
            want[y, x], copied[y, x] = image.ravel()[at[r, c]], True
            taken.ravel()[at[r, c]] = True
    assert (dense(out, (12, 20)) == want).all()
    rows = truth.collect()
    for part, held in (("copy", copied), ("source", taken)):
        assert sorted((r["y"], r["x"]) for r in rows if r["part"] == part) == [tuple(p) for p in np.argwhere(held).tolist()]


@pytest.mark.parametrize(("degrees", "scale"), [(0, 1.0), (90, 1.0), (30, 1.5), (-137.5, 0.75), (200, 3.0)])
def test_rotated_copies_against_a_plain_loop(spark, degrees, scale):
    image = np.arange(240).reshape(12, 20) % 251
    mask = np.zeros((12, 20), bool)
    mask[1:4, 2:7] = [[1, 1, 0, 1, 1], [1, 1, 1, 1, 0], [0, 1, 1, 1, 1]]
    objects = spark.createDataFrame([(0, int(y), int(x)) for y, x in np.argwhere(mask)], "image_id long, y int, x int")
    out, truth = forge.forge("copy_move_forgery", pixels(spark, image), objects, 12, 20, types=("rotation",), dy=4, dx=7, degrees=degrees, scale=scale)
    a, b = forge.rotation_units(degrees, scale)
    want, copied, taken = image.copy(), np.zeros_like(mask), np.zeros_like(mask)
    for (y, x), _ in np.ndenumerate(image):
        u, v = 2 * (y - 4) - 4, 2 * (x - 7) - 8
        sy, sx = (4 * 65536 + u * a - v * b + 65536) >> 17, (8 * 65536 + v * a + u * b + 65536) >> 17
        if 0 <= sy < 12 and 0 <= sx < 20 and mask[sy, sx] and not mask[y, x]:
            want[y, x], copied[y, x], taken[sy, sx] = image[sy, sx], True, True
    assert copied.any()
    assert (dense(out, (12, 20)) == want).all()
    rows = truth.collect()
    for part, held in (("copy", copied), ("source", taken)):
        assert sorted((r["y"], r["x"]) for r in rows if r["part"] == part) == [tuple(p) for p in np.argwhere(held).tolist()]


@pytest.mark.parametrize("radius", [1, 2])
def test_affine_residuals_against_least_squares(spark, radius):
    random = np.random.default_rng(radius)
    at = {(y, x): (int(2 + y // 3 + random.integers(0, 2)), int(3 - x)) for y in range(9) for x in range(9) if random.random() < 0.6}
    at |= {(20, x): (x * x, 1) for x in range(20, 26)} | {(30, 30): (4, 4), (40, 40): (1, 2), (41, 41): (7, 1)}  # on a line, alone, on a slant
    field = spark.createDataFrame([(1, y, x, y + a, x + b) for (y, x), (a, b) in at.items()], "image_id long, y int, x int, my int, mx int")
    want = {}
    for y, x in at:
        near = [(1.0, p, q, *at[y + p, x + q]) for p, q in grids.disc(radius) if (y + p, x + q) in at]
        m = np.array(near, float)
        solved, *_ = np.linalg.lstsq(m[:, :3], m[:, 3:], rcond=None)
        want[y, x] = float(((m[:, :3] @ solved - m[:, 3:]) ** 2).sum())
    rows = verify.affine_residual(field, radius, 1e9).collect()
    assert {(r["y"], r["x"]): (r["my"] - r["y"], r["mx"] - r["x"]) for r in rows} == at
    assert max(abs(r["error"] - want[r["y"], r["x"]]) for r in rows) < 1e-6
    steps = np.unique(np.round(list(want.values()), 6))
    limit = float(steps[len(steps) // 2 - 1 : len(steps) // 2 + 1].mean())  # between two errors that occur
    few = {(r["y"], r["x"]) for r in verify.affine_residual(field, radius, limit).collect()}
    assert few == {k for k, e in want.items() if e < limit} and 0 < len(few) < len(at)
    assert verify.affine_residual(field.limit(0), radius, 1.0).count() == 0


def test_segment_matches_against_a_plain_loop(spark):
    random = np.random.default_rng(8)
    rows = [(image, i, int(random.integers(0, 5)), [float(v) for v in random.integers(0, 9, 3)]) for image in (0, 1) for i in range(40)]
    points = spark.createDataFrame(rows, "image_id long, id int, segment int, vec array<double>")
    want = {}
    for image in (0, 1):
        own = [r for r in rows if r[0] == image]
        counts = {}
        for _, _, s, a in own:
            for t in {r[2] for r in own if r[2] > s}:
                d = sorted(float(np.linalg.norm(np.subtract(a, r[3]))) for r in own if r[2] == t)
                if len(d) > 1 and d[0] < 0.8 * d[1]:
                    counts[s, t] = counts.get((s, t), 0) + 1
        n = sorted(counts.values())
        d1 = [0, *np.diff(n).tolist()]
        d2 = [*np.diff(d1).tolist(), 0]
        slope = [step for step, count in zip(d1, n, strict=True) if count > 1]
        knee = [count for count, bend in zip(n, d2, strict=True) if bend > (np.mean(slope) if slope else 0)]
        want |= {(image, *pair): count for pair, count in counts.items() if count >= min(knee, default=1)}
    found = matching.segment_matches(points, 0.8).collect()
    assert want and {(r["image_id"], r["s"], r["t"]): r["n"] for r in found} == want


def test_scenes_scaled_noisy_and_planned(spark):
    image = np.arange(600).reshape(20, 30) % 7 + 120
    big = scenes.scaled_nearest(pixels(spark, image), 3)
    assert (dense(big, (60, 90)) == np.kron(image, np.ones((3, 3), int))).all()
    noise = dense(scenes.noisy(pixels(spark, image), 5.0), image.shape) - image
    assert abs(noise.mean()) < 1 and 4.3 < noise.std() < 5.7
    assert (dense(scenes.noisy(pixels(spark, image), 5.0), image.shape) - image == noise).all()
    assert (dense(scenes.noisy(pixels(spark, image), 5.0, seed=1), image.shape) - image != noise).any()
    strong = dense(scenes.noisy(pixels(spark, image), 500.0), image.shape)
    assert strong.min() == 0 and strong.max() == 255
    plan = [tuple(r) for r in scenes.random_blocks(spark.range(50).withColumnRenamed("id", "image_id"), 16, 24, 4, 6).collect()]
    assert all(sy % 4 == sx % 4 == ty % 4 == tx % 4 == 0 and 0 <= min(sy, sx, ty, tx) and max(sy, ty) <= 12 and max(sx, tx) <= 20 and (sy, sx) != (ty, tx) for _, _, sy, sx, ty, tx in plan)
    assert len({(i, ty, tx) for i, _, _, _, ty, tx in plan}) == len(plan) and {n for _, n, *_ in plan} <= set(range(1, 7)) and len({i for i, *_ in plan}) > 40


def test_forgeries_by_name(spark):
    image = np.arange(64).reshape(8, 8)
    objects = spark.createDataFrame([(0, 0, 0, 5), (0, 0, 1, 5), (0, 4, 4, 6), (0, 6, 0, 7), (0, 6, 1, 7), (0, 6, 2, 7)], "image_id long, y int, x int, component int")
    px = pixels(spark, image)
    out, truth = forge.forge("random_copy_move", px, objects, 8, 8, tile_h=2, tile_w=2, n=3, seed=4)
    rows = truth.collect()
    made = dense(out, (8, 8))
    assert {r["index"] for r in rows} == {1, 2}  # the third is wider than a tile
    for index in (1, 2):
        ends = [sorted((r["y"], r["x"]) for r in rows if r["index"] == index and r["part"] == p) for p in ("source", "copy")]
        shift = np.subtract(ends[1][0], ends[0][0])
        assert [tuple(np.add(p, shift)) for p in ends[0]] == ends[1] and all(made[c] == image[s] for s, c in zip(*ends, strict=True))
    brighter, _ = forge.forge("retouching_brightness", px, objects, 8, 8, beta=10)
    assert dense(brighter, (8, 8))[4, 4] == image[4, 4] + 10
    hosts = pixels(spark, image * 0, 1)
    spliced, _ = forge.forge("splicing_forgery", px, objects, 8, 8, host=hosts, host_objects=objects.limit(0), pairs=spark.createDataFrame([(0, 1)], "donor long, host long"), tile_h=2, tile_w=2)
    assert dense(spliced, (8, 8)).sum() > 0
    for name, arguments in (("no_such", {}), ("retouching_brightness", {}), ("retouching_brightness", {"beta": 1, "gamma": 2})):
        with pytest.raises(ValueError):
            forge.forge(name, px, objects, 8, 8, **arguments)


def test_kernels_on_small_rasters():
    r = np.random.default_rng(3)
    image = r.random((9, 11)) * 200
    assert np.allclose(grids.blur(np.full((7, 8), 5.0), 2), 5) and np.allclose(grids.blur(image, 1)[3, 4], image[2:5, 3:6].mean())
    assert np.allclose(grids.blur(image, 1)[0, 0], image[np.ix_([1, 0, 1], [1, 0, 1])].mean())
    assert np.allclose(grids.resize_linear(image, 9, 11), image) and np.allclose(grids.resize_linear(image, 18, 22)[1::2, 1::2][:8, :10], (9 * image[:8, :10] + 3 * image[1:, :10] + 3 * image[:8, 1:] + image[1:, 1:]) / 16)
    assert np.allclose(grids.warp_affine(image, np.array([[1.0, 0, 2], [0, 1, 1]]))[1:, 2:], image[:-1, :-2])
    ring = np.zeros((7, 7), bool)
    ring[1:6, 1:6] = True
    ring[2:5, 2:5] = False
    assert grids.fill_holes(ring).sum() == 25 and grids.fill_holes(ring, 9).sum() == 16
    mask = np.zeros((9, 11), bool)
    mask[2:6, 3:8] = True
    assert np.allclose(grids.poisson_clone(image, image + 40, mask), image, atol=0.5)  # equal gradients: the target again


def test_total_least_squares_and_vectors(spark):
    from palimpsest.functions import arrays

    r = np.random.default_rng(5)
    a = r.random((30, 2)) * 50
    m = np.array([[0.9, -0.2, 4.0], [0.3, 1.1, -7.0]])
    assert np.allclose(grids.fit_affine_total(a, a @ m[:, :2].T + m[:, 2]), m)
    noisy = np.column_stack((a, a @ m[:, :2].T + m[:, 2])) + r.normal(0, 0.5, (30, 4))

    def apart(t):  # squared distances to the plane b = A a + t
        off = noisy[:, 2:] - noisy[:, :2] @ t[:, :2].T - t[:, 2]
        spread = np.eye(2) + t[:, :2] @ t[:, :2].T
        return float((off @ np.linalg.inv(spread) * off).sum())

    best = grids.fit_affine_total(noisy[:, :2], noisy[:, 2:])
    assert all(apart(best) <= apart(best + r.normal(0, 1e-3, (2, 3))) + 1e-9 for _ in range(50)) and apart(best) <= apart(grids.fit_affine(noisy[:, :2], noisy[:, 2:]))
    row = spark.createDataFrame([([2.0, 4.0, 2.0], [1.0, 0.0], [1.0, float("inf")])], "a array<double>, b array<double>, c array<double>")
    assert [r_ for r_ in row.select(*[arrays.homogeneous(c) for c in "abc"]).first()] == [[1.0, 2.0, 1.0], [1.0, 0.0], [1.0, float("inf")]]


def test_block_kernels():
    r = np.random.default_rng(6)
    block = r.random((8, 8))
    kernels = features.KERNELS
    assert np.allclose(kernels["SVD"](block) ** 2, np.sort(np.linalg.eigvalsh(block @ block.T))[::-1])
    assert np.isclose((kernels["DWTFEAT"](block) ** 2).sum(), (block**2).sum()) and np.isclose(kernels["DWTFEAT"](block)[0], block.sum() / 8)
    assert np.allclose(kernels["DSIFT"](block * 3 + 5), kernels["DSIFT"](block)) and np.isclose(np.linalg.norm(kernels["DSIFT"](block)), 1)
    inner = np.zeros((16, 16))
    inner[4:12, 4:12] = block
    known, soft = kernels["BLUR"](inner), kernels["BLUR"](grids.blur(inner, 1))
    assert np.allclose(known, soft, rtol=1e-6, atol=1e-6 * np.abs(known).max())


def test_areas_by_share_and_clusters_by_links(spark):
    mask = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 5, 5)], "image_id long, y int, x int")
    m = spark.createDataFrame([(0, 0, 0, 5, 5)], "image_id long, y int, x int, my int, mx int")
    assert sorted((r["y"], r["x"]) for r in verify.area_rules(mask, m, 0.02, 100).collect()) == [(0, 0), (0, 1)]


def test_scratch_tables_go(spark):
    from palimpsest import session

    with session.scratch():
        gone = session.durable(spark.range(3), "gone")
        kept = session.durable(spark.range(3), "kept", kept=True)
        assert gone.count() == kept.count() == 3
    assert not os.path.exists(gone._palimpsest_path.removeprefix("file://")) and os.path.exists(kept._palimpsest_path.removeprefix("file://"))
    session.discard(kept)


def test_letters_go_to_free_panels_alone(spark):
    panels = "template long, panel string, height int, width int, x0 int, x1 int, y0 int, y1 int, class string"
    rows = [(1, f"{i:03d}", 2000, 2000, 100 + 40 * (i % 6), 120 + 40 * (i % 6), 60 * (i // 6), 50 + 60 * (i // 6), "Microscopy" if i % 2 else "WesternBlot") for i in range(36)]
    rows += [(2, "001", 50, 50, 0, 20, 0, 20, "Microscopy"), (2, "002", 50, 50, 20, 50, 0, 20, "Microscopy"), (2, "003", 50, 50, 31, 50, 26, 50, "Graphs"), (2, "004", 50, 50, 11, 28, 30, 50, "Graphs")]
    # the squares of 005 and 006 would meet: the first takes the place
    rows += [(3, "005", 90, 90, 30, 60, 40, 45, "Graphs"), (3, "006", 90, 90, 32, 60, 46, 60, "Graphs"), (3, "007", 90, 90, 30, 60, 85, 90, "Graphs")]
    df = spark.createDataFrame(rows, panels)
    got = {(r["template"], r["panel"]): (r["y"], r["x"], r["caption"]) for r in templates.corner_captions(df, 10).collect()}
    first = [k for k in got if k[0] == 1]
    assert len(first) == 36 and got[1, "035"][2] == chr(64 + 36) and got[1, "000"] == (0, 90, "A") and got[1, "006"][2] == "G"
    assert {k[1]: v for k, v in got.items() if k[0] == 2} == {"004": (30, 1, "A")}
    assert {k[1]: v for k, v in got.items() if k[0] == 3} == {"005": (40, 20, "A")}
    letters = {(r["template"], r["panel"]): r["letter"] for r in templates.panel_letters(df).collect()}
    assert letters[1, "001"] == "a" and letters[1, "007"] == "b" and letters[2, "001"] == "a" and len(letters) == 20


def test_rounds_of_a_chain_leave_one_table(spark, tmp_path):
    from palimpsest import session

    before = session.shared_folder
    session.shared_folder = lambda s: f"file://{tmp_path}"
    try:
        found = connected(spark.createDataFrame([(0, i, i + 1) for i in range(200)], "g int, a int, b int"), ["g"])
        assert found.select("component").distinct().count() == 1
        left = os.listdir(tmp_path / "palimpsest")
    finally:
        session.shared_folder = before
    assert len([f for f in left if not f.startswith(".")]) == 1


def test_every_name_of_a_family_is_made(spark):
    r = np.random.default_rng(11)
    image = r.integers(0, 256, (24, 26))
    px = pixels(spark, image)
    mask = np.zeros(image.shape, int)
    mask[3:9, 4:12] = 1
    mask[14:18, 15:20] = 2
    objects = spark.createDataFrame([(0, y, x, int(mask[y, x])) for y, x in np.argwhere(mask).tolist()], "image_id long, y int, x int, component int")
    extra = {
        "copy_move_forgery": {"dy": 2, "dx": 1},
        "random_copy_move": {"tile_h": 9, "tile_w": 9},
        "splicing_forgery": {"host": px, "host_objects": objects.limit(0), "pairs": spark.createDataFrame([(0, 0)], "donor long, host long"), "tile_h": 9, "tile_w": 9},
        "overlap_forgery": {"first": (2, 3, 10, 12), "second": (6, 1, 15, 9)},
        "retouching_contrast": {"alpha": 1.2},
        "retouching_brightness": {"beta": 9},
        "retouching_brightness_contrast": {"alpha": 1.1, "beta": 2},
        "retouching_blurring": {"radius": 2, "level": 2},
        "cleaning_using_bf": {"tile_h": 9, "tile_w": 9},
        "cleaning_with_inpainting": {"patch": 3},
    }
    for name in [n for names in forge.MODALITIES.values() for n in names]:
        out, truth = forge.forge(name, px, objects, 24, 26, **extra.get(name, {}))
        assert out.count() > 0 and truth.count() > 0, name

    # blurring by plain loops
    want = image.astype(float)
    for k in (2, 1):  # the lesser object counts where boxes meet
        ys, xs = np.nonzero(mask == k)
        y0, y1, x0, x1 = ys.min(), ys.max() + 1, xs.min(), xs.max() + 1
        soft = image[y0:y1, x0:x1].astype(float)
        for _ in range(2):
            soft = np.array([[soft[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].mean() for x in range(soft.shape[1])] for y in range(soft.shape[0])])
        inside = grids.dilate(mask == k, grids.box(3))[y0:y1, x0:x1]
        want[y0:y1, x0:x1] = np.where(inside, np.floor(soft.round(6) + 0.5), want[y0:y1, x0:x1])
    blurred, truth = forge.forge("retouching_blurring", px, objects, 24, 26, radius=2, level=2)
    assert (dense(blurred, image.shape) == want).all() and truth.count() == (mask > 0).sum()

    filled, _ = forge.forge("cleaning_with_inpainting", px, objects.filter("component = 2"), 24, 26, patch=3)
    got = dense(filled, image.shape)
    assert (got[mask != 2] == image[mask != 2]).all() and (got == np.floor(inpainting.inpaint(image, mask == 2, 3) + 0.5)).all()

    crops, shared = forge.forge("overlap_forgery", px, objects, 24, 26, first=(2, 3, 10, 12), second=(6, 1, 15, 9))
    frames = {(c["crop"], c["y"], c["x"]): c["g"] for c in crops.collect()}
    assert len(frames) == 120 + 135 and frames[1, 0, 0] == image[2, 3] and frames[2, 14, 8] == image[20, 9]
    assert {(t["crop"], t["y"], t["x"]) for t in shared.collect()} == {(1, y - 2, x - 3) for y in range(6, 12) for x in range(3, 10)} | {(2, y - 6, x - 1) for y in range(6, 12) for x in range(3, 10)}
    assert forge.applied_type(("rotation", "flip")) == "flip" and forge.applied_type(("rotation", "translation")) == "translation"
    with pytest.raises(ValueError):
        forge.applied_type(("shear",))


def test_panels_meet_lines_of_images_not_pixels(spark):
    """Gaps in an image stay gaps, and the pixels of figures are made after the join."""
    from palimpsest.operators import templates

    panels = spark.createDataFrame([(1, 7, 2, 8, 1, 5, 2, 3), (2, 7, 0, 3, 0, 2, 2, 3), (3, 9, 0, 2, 0, 2, 2, 3)], "template long, image_id long, x0 int, x1 int, y0 int, y1 int, ih int, iw int")
    pixels = {(0, 0): 5, (0, 2): 6, (1, 1): 7}
    rows = spark.createDataFrame([(7, y, x, g) for (y, x), g in pixels.items()] + [(8, 0, 0, 1)], "image_id long, y int, x int, g int")
    made = templates.place(panels, rows)
    want = {(t, fy, fx, pixels[at]) for t, x0, x1, y0, y1 in ((1, 2, 8, 1, 5), (2, 0, 3, 0, 2)) for fy in range(y0, y1) for fx in range(x0, x1) if (at := ((fy - y0) * 2 // (y1 - y0), (fx - x0) * 3 // (x1 - x0))) in pixels}
    assert {tuple(r) for r in made.collect()} == want
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(sequence(x0") < plan.index("Join Inner")  # above it


def test_ward_clusters_of_many_points_with_ties():
    import time

    points = np.random.default_rng(3).integers(0, 30, (300, 2)).astype(float)
    start = time.time()
    label = grids.ward_clusters(points, 12.0)
    assert time.time() - start < 20  # looking at all pairs again at each merge took minutes
    few = points[:30]
    groups = {i: [i] for i in range(30)}

    def gap(p, q):
        a, b = groups[p], groups[q]
        d = few[a].mean(axis=0) - few[b].mean(axis=0)
        return float(np.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * (d[0] * d[0] + d[1] * d[1])))

    while len(groups) > 1:
        d, p, q = min((gap(p, q), p, q) for p in groups for q in groups if p < q)
        if d > 12:
            break
        groups[p] += groups.pop(q)
    got = grids.ward_clusters(few, 12.0)
    assert all(got[m] == p for p, members in groups.items() for m in members)
    assert set(label.tolist()) == {int(np.flatnonzero(label == k)[0]) for k in np.unique(label)}
