"""Verification and marking of matches: shift votes, clusters, transforms, areas and shared labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import estimators, grids
from palimpsest.functions import outlines as lines
from palimpsest.operators import raster
from palimpsest.operators.graph import connected
from palimpsest.operators.images import XY
from palimpsest.operators.scoring import label_components
from palimpsest.session import durable, prepare


def shifts(matches: DataFrame) -> DataFrame:
    """Matches (y, x, my, mx) with the absolute shift dy, dx."""
    return matches.withColumns({"dy": F.abs(F.col("my") - F.col("y")), "dx": F.abs(F.col("mx") - F.col("x"))})


def vote(matches: DataFrame, least: int = 50, most_counts: int = 0, spread: int = 0) -> DataFrame:
    """Matches whose shift is shared: by at least `least` matches (with `spread`, counted over shifts that near in both axes), or
    with `most_counts` by one of so many greatest counts."""
    moved = shifts(matches)
    counts = moved.groupBy("image_id", "dy", "dx").agg(F.count(F.lit(1)).alias("votes"))
    if spread:
        around = F.explode(F.sequence(F.lit(-spread), F.lit(spread)))
        near = counts.withColumn("oy", around).withColumn("ox", around).select("image_id", (F.col("dy") + F.col("oy")).alias("dy"), (F.col("dx") + F.col("ox")).alias("dx"), "votes")
        counts = counts.select("image_id", "dy", "dx").join(near, ["image_id", "dy", "dx"]).groupBy("image_id", "dy", "dx").agg(F.sum("votes").alias("votes"))
    if most_counts:
        kept = counts.withColumn("r", F.dense_rank().over(Window.partitionBy("image_id").orderBy(F.desc("votes")))).filter(F.col("r") <= most_counts).drop("r")
    else:
        kept = counts.filter(F.col("votes") >= least)
    return moved.join(kept, ["image_id", "dy", "dx"])


def mark_endpoints(matches: DataFrame, half: int) -> DataFrame:
    """The centres of both blocks of every match."""
    ends = matches.select(*XY).unionByName(matches.select("image_id", F.col("my").alias("y"), F.col("mx").alias("x")))
    return ends.select("image_id", (F.col("y") + half).alias("y"), (F.col("x") + half).alias("x")).distinct()


def single_linkage(points: DataFrame, cut: float) -> DataFrame:
    """image_id, id, cluster: components of the points at most `cut` apart (the same as merging while the least gap is at most cut).

    Points meet only those of their own and the neighbouring cells of a grid as wide as the cut.
    """
    cell = lambda c: F.floor(F.col(c) / cut)
    own = points.select("image_id", "id", "y", "x", cell("y").alias("cy"), cell("x").alias("cx"))
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    near = points.select("image_id", F.col("id").alias("o"), F.col("y").alias("oy"), F.col("x").alias("ox"), cell("y").alias("by"), cell("x").alias("bx")).withColumn("iy", around).withColumn("ix", around)
    near = near.select("image_id", "o", "oy", "ox", (F.col("by") + F.col("iy")).alias("cy"), (F.col("bx") + F.col("ix")).alias("cx"))
    gap = (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")) + (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox"))
    edges = own.join(near, ["image_id", "cy", "cx"]).filter((F.col("o") < F.col("id")) & (gap <= cut * cut)).select("image_id", F.col("id").alias("a"), F.col("o").alias("b"))
    found = connected(edges, ["image_id"])
    return points.select("image_id", "id").join(found, ["image_id", "id"], "left").select("image_id", "id", F.coalesce("component", "id").alias("cluster"))


def ward_linkage(points: DataFrame, cut: float) -> DataFrame:
    prepare(points.sparkSession)
    kinds = dict(points.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        label = grids.ward_clusters(pdf[["y", "x"]].to_numpy(dtype=float), cut)
        return pd.DataFrame({"image_id": pdf["image_id"], "id": pdf["id"], "cluster": pdf["id"].to_numpy()[label]})

    return points.select("image_id", "id", "y", "x").groupBy("image_id").applyInPandas(run, f"image_id {kinds['image_id']}, id {kinds['id']}, cluster {kinds['id']}")


def cluster_links(matches: DataFrame, clusters: DataFrame, least: int = 4) -> DataFrame:
    """Matches (a, b) with the clusters of both ends, of cluster pairs that enough matches link."""
    linked = matches.join(clusters.select("image_id", F.col("id").alias("a"), F.col("cluster").alias("ca")), ["image_id", "a"]).join(clusters.select("image_id", F.col("id").alias("b"), F.col("cluster").alias("cb")), ["image_id", "b"])
    enough = linked.groupBy("image_id", "ca", "cb").count().filter(F.col("count") >= least).drop("count")
    return linked.join(enough, ["image_id", "ca", "cb"], "left_semi")


def _fits(matches: DataFrame, groups: list[str], run, extra: str) -> DataFrame:
    prepare(matches.sparkSession)
    kinds = dict(matches.dtypes)
    return matches.select(*groups, "y", "x", "my", "mx").groupBy(*groups).applyInPandas(run, ", ".join(f"{g} {kinds[g]}" for g in groups) + f", {extra}")


def _ordered(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values(["y", "x", "my", "mx"])
    return pdf[["x", "y"]].to_numpy(dtype=float), pdf[["mx", "my"]].to_numpy(dtype=float)


def estimate_transforms(matches: DataFrame, groups: list[str], method: str = "ransac", tolerance: float = 3.0, rounds: int = 2000) -> DataFrame:
    """groups, method, transform (3 x 3, row-major, last entry 1; null where the pairs leave it open), inliers, matches: the map of each group by a method of estimators.METHODS, of a fixed seed.

    Points are normalised first; a group's matches are one task's.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _ordered(pdf)
        pa, ta = grids.normalise_points(a)
        pb, tb = grids.normalise_points(b)
        h, near = estimators.estimate(method, pa, pb, tolerance * tb[0, 0], rounds)
        whole = None
        if h is not None:
            whole = np.linalg.inv(tb) @ h @ ta
            whole = (whole / whole[2, 2]).ravel().tolist()
        return pd.DataFrame([(*pdf[groups].iloc[0], method, whole, int(near.sum()), len(pdf))], columns=[*groups, "method", "transform", "inliers", "matches"])

    return _fits(matches, groups, run, "method string, transform array<double>, inliers long, matches long")


def fit_transforms(matches: DataFrame, groups: list[str], tolerance: float = 3.0, rounds: int = 100) -> DataFrame:
    """groups, transform (2 x 3, row-major), inliers, matches: the affine map that most matches of a group follow."""
    found = estimate_transforms(matches, groups, "ownransac", tolerance, rounds)
    return found.select(*groups, F.slice("transform", 1, 6).alias("transform"), "inliers", "matches")


def grow_transforms(matches: DataFrame, groups: list[str], reach: float = 5.0, tolerance: float = 3.0, least: int = 4) -> DataFrame:
    """groups, number, transform, size: affine maps grown from close pairs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _ordered(pdf)
        out = [(*pdf[groups].iloc[0], i, m.ravel().tolist(), len(own)) for i, (m, own) in enumerate(grids.grow_affine(a, b, reach, tolerance, least))]
        return pd.DataFrame(out, columns=[*groups, "number", "transform", "size"])

    return _fits(matches, groups, run, "number int, transform array<double>, size long")


def plausible(transform: str = "transform", low: float = 0.4, high: float = 2.2) -> Column:
    """The scale, as the root of the determinant, is within bounds."""
    t = F.col(transform)
    scale = F.sqrt(F.abs(t[0] * t[4] - t[1] * t[3]))
    return scale.between(low, high)


def merge_transforms(transforms: DataFrame, linear: float = 0.03, full: float = 10.0, corner: float = 1.0) -> DataFrame:
    """image_id, id, merged: transforms that agree in their linear part and as a whole share the least id."""
    p, q = transforms.select("image_id", F.col("id").alias("a"), F.col("transform").alias("s")), transforms.select("image_id", F.col("id").alias("b"), F.col("transform").alias("t"))
    rms = lambda idx: F.sqrt(sum(((F.col("s")[i] - F.col("t")[i]) * (F.col("s")[i] - F.col("t")[i]) for i in idx), F.lit(0.0)) / len(idx))
    edges = p.join(q, "image_id").filter("b < a").filter((rms([0, 1, 3, 4]) < linear) & (rms(range(6)) < full * corner)).select("image_id", "a", "b")
    return transforms.select("image_id", "id").join(connected(edges, ["image_id"]), ["image_id", "id"], "left").select("image_id", "id", F.coalesce("component", "id").alias("merged"))


def correlated(pixels: DataFrame, matches: DataFrame, least: float, radius: int = 2, value: str = "g") -> DataFrame:
    """Pixels at either end of a match whose correlation, taken from that end, is at least `least`."""
    back = matches.select("image_id", F.col("my").alias("y"), F.col("mx").alias("x"), F.col("y").alias("my"), F.col("x").alias("mx"))
    ends = matches.select("image_id", "y", "x", "my", "mx").unionByName(back).distinct()
    return correlation_map(pixels, ends, radius, value).filter(F.col("ncc") >= least).select(*XY).distinct()


def area_rules(mask: DataFrame, matches: DataFrame, least: float, image_area: int = 0) -> DataFrame:
    """Pixels of 8-connected areas that are large enough, hold a match, and whose match ends in a marked pixel. least: pixels, below 1 a share of image_area."""
    least = least * image_area if least < 1 else least
    areas = label_components(mask.withColumn("label", F.lit(1)), eight=True).drop("label")
    large = areas.groupBy("image_id", "component").count().filter(F.col("count") >= least).drop("count")
    ends = matches.select("image_id", "y", "x", "my", "mx")
    both = ends.unionByName(ends.select("image_id", F.col("my").alias("y"), F.col("mx").alias("x"), F.col("y").alias("my"), F.col("x").alias("mx")))
    marked = both.join(areas, XY).join(areas.select("image_id", F.col("y").alias("my"), F.col("x").alias("mx"), F.col("component").alias("other")), ["image_id", "my", "mx"])
    held = marked.select("image_id", "component").distinct()
    return areas.join(large, ["image_id", "component"], "left_semi").join(held, ["image_id", "component"], "left_semi")


def shared_labels(mask: DataFrame, matches: DataFrame, eight: bool = True) -> DataFrame:
    """image_id, y, x, label: areas that matches join, however far, share a label from 1; others have none."""
    areas = label_components(mask.withColumn("label", F.lit(1)), eight).drop("label")
    ends = matches.join(areas.withColumnRenamed("component", "a"), XY).select("image_id", F.col("my").alias("y"), F.col("mx").alias("x"), "a").join(areas.withColumnRenamed("component", "b"), XY)
    joined = connected(ends.filter("a <> b").select("image_id", "a", "b"), ["image_id"])
    number = F.dense_rank().over(Window.partitionBy("image_id").orderBy("component"))
    return areas.withColumnRenamed("component", "id").join(joined, ["image_id", "id"]).select(*XY, "component").withColumn("label", number).drop("component")


def least_displacement(field: DataFrame, squared: float) -> DataFrame:
    dy, dx = F.col("my") - F.col("y"), F.col("mx") - F.col("x")
    return field.filter(dy * dy + dx * dx >= squared)


def symmetric(field: DataFrame) -> DataFrame:
    """Every marked pixel and its target."""
    return field.select(*XY).unionByName(field.select("image_id", F.col("my").alias("y"), F.col("mx").alias("x"))).distinct()


def affine_residual(field: DataFrame, radius: int, limit: float) -> DataFrame:
    """Pixels of a field whose neighbourhood's displacements follow one affine map: the summed squared residual is under the limit.

    A field has one target a pixel. The least squares of the disc around each are whole-number sums and a closed form; discs of up to raster.NEAR pixels are joined by sending each displacement to the
    pixels around it, added up before the shuffle, and larger ones are summed in tiles. Neighbours on one line or in one place fit by what they determine.
    """
    disc = grids.disc(radius)
    moved = {"a": F.col("my").cast("long") - F.col("y"), "b": F.col("mx").cast("long") - F.col("x")}
    products = [x + y for i, x in enumerate("pqab") for y in "pqab"[i:] if x + y != "ab"]
    if len(disc) > raster.NEAR:
        rows = raster.by_tiles(field.select(*XY, *[v.alias(k) for k, v in moved.items()]), ["a", "b"], radius, lambda *of: _affine_errors(*of, disc, limit), "oa long, ob long, error double")
        return rows.select(*XY, (F.col("y") + F.col("oa")).cast("int").alias("my"), (F.col("x") + F.col("ob")).cast("int").alias("mx"), "error")
    steps = F.explode(F.array(*[F.struct(F.lit(oy).alias("oy"), F.lit(ox).alias("ox")) for oy, ox in disc]))
    sent = field.select("image_id", "y", "x", "my", "mx", steps.alias("o")).select("image_id", "y", "x", "my", "mx", F.col("o.oy").cast("long").alias("p"), F.col("o.ox").cast("long").alias("q"))
    at = sent.select("image_id", (F.col("y") - F.col("p")).cast("int").alias("y"), (F.col("x") - F.col("q")).cast("int").alias("x"), "p", "q", *[v.alias(k) for k, v in moved.items()])
    own = F.expr("p = 0 AND q = 0")
    sums = [F.sum(x).alias(x) for x in "pqab"] + [F.sum(F.col(c[0]) * F.col(c[1])).alias(c) for c in products]
    rows = at.groupBy(*XY).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(own, F.col("a"))).alias("oa"), F.max(F.when(own, F.col("b"))).alias("ob"), *sums).filter("oa IS NOT NULL")
    spread = [F.expr(f"cast(n * {c} - {c[0]} * {c[1]} AS double)").alias(f"s{c}") for c in products]
    rows = rows.select(*XY, "n", "oa", "ob", *spread).withColumn("det", F.expr("spp * sqq - spq * spq"))
    explained = "CASE WHEN det > 0 THEN (sp{d} * sp{d} * sqq - 2 * sp{d} * sq{d} * spq + sq{d} * sq{d} * spp) / det WHEN spp > 0 THEN sp{d} * sp{d} / spp WHEN sqq > 0 THEN sq{d} * sq{d} / sqq ELSE 0 END"
    error = " + ".join(f"greatest((s{d}{d} - {explained.format(d=d)}) / n, 0)" for d in "ab")
    rows = rows.withColumn("error", F.expr(error)).filter(F.col("error") < limit)
    return rows.select(*XY, (F.col("y") + F.col("oa")).cast("int").alias("my"), (F.col("x") + F.col("ob")).cast("int").alias("mx"), "error")


def _affine_errors(known: np.ndarray, a: np.ndarray, b: np.ndarray, disc: list[tuple[int, int]], limit: float) -> dict[str, np.ndarray]:
    """oa and ob (the displacements themselves), error, and keep: where it is under the limit."""
    one = known.astype(np.int64)
    planes = {"n": one, "a": a, "b": b, "aa": a * a, "bb": b * b}
    total = {k: np.zeros(known.shape, np.int64) for k in ("n", "p", "q", "a", "b", "pp", "qq", "pq", "pa", "qa", "pb", "qb", "aa", "bb")}
    for p, q in disc:
        near = {k: grids.shifted(v, -p, -q) for k, v in planes.items()}  # what stands at (y + p, x + q)
        for k, v in near.items():
            total[k] += v
        for k, w in (("p", p), ("q", q), ("pp", p * p), ("qq", q * q), ("pq", p * q)):
            total[k] += w * near["n"]
        for d in "ab":
            total[f"p{d}"] += p * near[d]
            total[f"q{d}"] += q * near[d]
    n = total["n"]
    s = {c: (n * total[c] - total[c[0]] * total[c[1]]).astype(float) for c in total if len(c) == 2}
    det = s["pp"] * s["qq"] - s["pq"] * s["pq"]
    error = np.zeros(known.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        for d in "ab":
            p, q = s[f"p{d}"], s[f"q{d}"]
            flat = np.where(s["pp"] > 0, p * p / s["pp"], np.where(s["qq"] > 0, q * q / s["qq"], 0.0))
            explained = np.where(det > 0, (p * p * s["qq"] - 2 * p * q * s["pq"] + q * q * s["pp"]) / det, flat)
            error += np.maximum((s[d + d] - explained) / n, 0)
    return {"oa": a, "ob": b, "error": error, "keep": known & (error < limit)}


def dense_areas(field: DataFrame, height: int, width: int, median: int = 4, radius: int = 6, residual: float = 300.0, displacement: float = 50.0, least_size: int = 1200, reach: int = 10) -> DataFrame:
    """image_id, y, x: copied areas of a dense field (image_id, y, x, my, mx), in the order of the published detector.

    Displacements become medians over a disc, clipped to where a target exists; pixels whose neighbours follow no affine map go, then those moved too little, then small 4-connected areas; targets
    join their sources; the rest is dilated by a disc.
    """
    moved = field.select(*XY, (F.col("my") - F.col("y")).alias("dy"), (F.col("mx") - F.col("x")).alias("dx"))
    calm = raster.medians(moved, ["dy", "dx"], grids.disc(median))
    clip = lambda c, d, side: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.col(c) + F.rint(d).cast("int")))
    calm = durable(calm.select(*XY, clip("y", "dy", height).alias("my"), clip("x", "dx", width).alias("mx")), "field")
    kept = least_displacement(affine_residual(calm, radius, residual), displacement * displacement)
    kept = durable(kept.select(*XY, "my", "mx"), "kept")
    areas = label_components(kept.select(*XY, F.lit(1).alias("label")))
    large = raster.open_area(areas, least_size)
    both = symmetric(kept.join(large.select(*XY), XY))
    return raster.dilate(both, grids.disc(reach), height, width)


def correlation_map(pixels: DataFrame, matches: DataFrame, radius: int = 2, value: str = "g") -> DataFrame:
    """image_id, y, x, ncc: zero-mean correlation of the squares around both ends of each match; 0 where one is flat."""
    square = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in grids.box(radius)]))
    cells = matches.select(*XY, "my", "mx").withColumn("o", square)
    near = lambda y, x, name: pixels.select("image_id", F.col("y").alias(y), F.col("x").alias(x), F.col(value).cast("double").alias(name))
    cells = cells.withColumns({"ay": F.col("y") + F.col("o.dy"), "ax": F.col("x") + F.col("o.dx"), "by": F.col("my") + F.col("o.dy"), "bx": F.col("mx") + F.col("o.dx")})
    both = cells.join(near("ay", "ax", "p"), ["image_id", "ay", "ax"]).join(near("by", "bx", "q"), ["image_id", "by", "bx"])
    s = both.groupBy(*XY, "my", "mx").agg(F.covar_pop("p", "q").alias("c"), F.var_pop("p").alias("vp"), F.var_pop("q").alias("vq"))
    return s.select(*XY, "my", "mx", F.when((F.col("vp") > 1e-9) & (F.col("vq") > 1e-9), F.col("c") / F.sqrt(F.col("vp") * F.col("vq"))).otherwise(0.0).alias("ncc"))


def pair_counts(matches: DataFrame, truth: DataFrame) -> DataFrame:
    """image_id, pairs, both: matches, and those with both ends in the ground truth."""
    t = truth.select(*XY).distinct()
    at = matches.join(t.withColumn("p", F.lit(1)), XY, "left").join(t.select("image_id", F.col("y").alias("my"), F.col("x").alias("mx"), F.lit(1).alias("q")), ["image_id", "my", "mx"], "left")
    return at.groupBy("image_id").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.expr("p = 1 AND q = 1")).alias("both"))


def outlines(mask: DataFrame) -> DataFrame:
    """image_id, component, kind (contour or hull), n (from 0), y, x: the outer border, in order, and the hull's corners of every 8-connected area."""
    prepare(mask.sparkSession)
    areas = label_components(mask.select(*XY).distinct().withColumn("label", F.lit(1)), eight=True).drop("label")
    kind = dict(mask.dtypes)["image_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        component, points = pdf["component"].to_numpy(), pdf[["y", "x"]].to_numpy()
        order = np.argsort(component, kind="stable")
        names, first = np.unique(component[order], return_index=True)
        made = [(name, kind, line) for name, own in zip(names, np.split(points[order], first[1:]), strict=True) for kind, line in (("contour", lines.contour(own)), ("hull", lines.hull(own)))]
        sizes = [len(line) for *_, line in made]
        places = np.concatenate([line for *_, line in made])
        columns = {"component": np.repeat([m[0] for m in made], sizes), "kind": np.repeat([m[1] for m in made], sizes), "n": np.concatenate([np.arange(n) for n in sizes])}
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], **columns, "y": places[:, 0], "x": places[:, 1]})

    # a few areas of an image together, so that many small ones are few groups
    some = areas.withColumn("some", F.pmod(F.xxhash64("component"), F.lit(4)))
    return some.groupBy("image_id", "some").applyInPandas(run, f"image_id {kind}, component long, kind string, n int, y int, x int")


def orientation_consistent(matches: DataFrame, tolerance: float) -> DataFrame:
    """Matches whose angle difference is near their image's circular mean of it."""
    d = F.radians(F.pmod(F.col("theta_b") - F.col("theta_a"), F.lit(360.0)))
    mean = matches.groupBy("image_id").agg(F.degrees(F.atan2(F.avg(F.sin(d)), F.avg(F.cos(d)))).alias("mean"))
    off = F.pmod(F.col("theta_b") - F.col("theta_a") - F.col("mean"), F.lit(360.0))
    return matches.join(mean, "image_id").filter(F.least(off, 360 - off) <= tolerance).drop("mean")


def grow_segments(segments: DataFrame, neighbours: DataFrame, seeds: DataFrame, limit: float = 15.0) -> DataFrame:
    """Matched segments and their neighbours of a near mean value."""
    near = neighbours.join(seeds.withColumnRenamed("segment", "a"), ["image_id", "a"]).join(segments.select("image_id", F.col("segment").alias("a"), F.col("mean").alias("ma")), ["image_id", "a"]).join(segments.select("image_id", F.col("segment").alias("b"), F.col("mean").alias("mb")), ["image_id", "b"])
    return seeds.unionByName(near.filter(F.abs(F.col("ma") - F.col("mb")) <= limit).select("image_id", F.col("b").alias("segment"))).distinct()


def detector_settings(height: Column, width: Column) -> list[Column]:
    """Contrast limit and least clone distance by image size."""
    side = F.least(height, width)
    return [F.when(side < 600, 0.01).when(side < 840, 0.02).otherwise(0.04).alias("contrast"), F.when(side >= 1400, 60).otherwise(25).alias("clone")]
