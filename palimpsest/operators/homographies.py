"""Copied areas from keypoint matches by local homographies: seeds, robust maps, checks, inliers of the whole image, discs that grow where colours agree.

Matches are rows (image_id, id, y, x, my, mx, scale, mscale, theta, mtheta): two ends with their scales and orientations in radians. Settings are rows an image of `settings`.
The estimator runs once a seed on the matches around it; all else is joins and aggregations over matches, models and pixels. Where a published detector follows the last
model's scale for the whole image, or keeps a disc's pixels whose copies lie outside, this goes by each model, and drops them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import estimators, grids
from palimpsest.operators import raster
from palimpsest.operators.images import XY
from palimpsest.operators.scoring import label_components
from palimpsest.session import durable, prepare

MATCH = ["image_id", "id", "y", "x", "my", "mx", "scale", "mscale", "theta", "mtheta"]
MODEL = ["image_id", "seed"]
#: Half the side of the square around an end whose gradients tell how noisy a match is.
PATCH = 16
#: Side of the tiles that are smoothed, or searched for discs, at once.
SMOOTH_TILE = 1024
#: Disc radius by keypoint scale, and what colours of both ends may differ by.
RADIUS_RATIO, COLOUR = 16, 16


def settings(images: DataFrame) -> DataFrame:
    """image_id, height, width (of images) and the detector's settings by image size: fixed values for sides below 600, below 840, from 1400 on, and between."""
    h, w = F.col("height"), F.col("width")
    area = h * w / 1e6
    tiny, small, big = (w < 600) & (h < 600), (w < 840) & (h < 840), (w >= 1400) & (h >= 1400)
    by = lambda t, s, m, b: F.when(tiny, t).when(small, s).when(big, b).otherwise(m)
    size = by(F.lit(2000), F.lit(250), *[F.least(F.lit(500), 400 + F.bround(30 * area).cast("int"))] * 2)
    return images.select(
        "image_id",
        "height",
        "width",
        by(1, 1, 1, 8).alias("allowed"),
        (~big).alias("check_scale"),
        (~small).alias("check_distance"),
        (~small).alias("check_edges"),
        by(0, 0, 25, 130).alias("least_distance"),
        by(1, 1, 1, 2).alias("directions"),
        by(5, 4, 5, 6).alias("least_inliers"),
        by(6, 4, 20, 30).alias("enough_inliers"),
        F.when(small, F.greatest(F.lit(40.0), 25 * F.sqrt(area))).otherwise(25 * F.sqrt(area)).alias("clone_distance"),
        F.when(big, F.bround(size * 1.3).cast("int")).otherwise(size).alias("least_size"),
        by(5, 5, 4, 30).alias("scale_weight"),
        by(0.2, 0.2, 0.2, 0.05).alias("match_share"),
        by(20, 20, 20, 48).alias("largest_radius"),
        by(16, 16, 16, 20).alias("least_radius"),
        by(300, 300, 300, 1500).alias("largest_hole"),
        by(0.65, 0.74, 0.52, 0.6).alias("match_ratio"),
        F.when(big, F.least(F.lit(2), F.bround(3 * F.sqrt(area)).cast("int"))).when(small, F.least(F.lit(3), F.bround(3 * area).cast("int"))).otherwise(F.least(F.lit(3), F.bround(3 * F.sqrt(area)).cast("int"))).alias("least_neighbours"),
        F.when(big, 16000).otherwise(7000).alias("octave_keypoints"),
    )


def inside(matches: DataFrame, sizes: DataFrame) -> DataFrame:
    """Matches of which both ends lie in the image, of images with five matches or more; n is their number."""
    within = lambda c, side: (F.col(c) >= 0) & (F.col(c) < F.col(side))
    kept = matches.select(*MATCH).join(sizes.select("image_id", "height", "width"), "image_id").filter(within("y", "height") & within("x", "width") & within("my", "height") & within("mx", "width"))
    counts = kept.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    return kept.select(*MATCH).join(counts, "image_id")


def seeds(matches: DataFrame, seed: int = 0) -> DataFrame:
    """image_id, seed (a match), sy, sx (its first end): a thirtieth of an image's matches, at least 15 and at most 40, by a seeded hash."""
    order = Window.partitionBy("image_id").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    share = F.bround(F.col("n") / 30)
    most = F.least(F.greatest(F.lit(15.0), share), F.greatest(F.lit(10.0), share), F.lit(40.0), F.col("n").cast("double"))
    picked = matches.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most)
    return picked.select("image_id", F.col("id").alias("seed"), F.col("y").alias("sy"), F.col("x").alias("sx"))


def around(matches: DataFrame, picked: DataFrame, sizes: DataFrame) -> DataFrame:
    """MODEL and the matches with an end near a seed's first end: within half the clone distance and 55 pixels, by cells of that width."""
    reach = sizes.select("image_id", (F.col("clone_distance") / 2 + 55).alias("reach"))
    cell = lambda c: F.floor(F.col(c) / F.col("reach"))
    own = picked.join(reach, "image_id").withColumns({"cy": cell("sy"), "cx": cell("sx")})
    own = own.withColumn("cy", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1))).withColumn("cx", F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1)))
    ends = F.explode(F.array(*[F.struct(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")) for y, x in (("y", "x"), ("my", "mx"))]))
    met = matches.select("image_id", "id", ends.alias("e")).join(reach, "image_id").withColumns({"cy": cell("e.y"), "cx": cell("e.x")}).drop("reach")
    dy, dx = F.col("e.y") - F.col("sy"), F.col("e.x") - F.col("sx")
    near = own.join(met, ["image_id", "cy", "cx"]).filter(dy * dy + dx * dx <= F.col("reach") * F.col("reach")).select(*MODEL, "id").distinct()
    return near.join(matches, ["image_id", "id"])


def _steepness(known: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Gradient lengths: central differences, one-sided at the border; 0 where an axis has no neighbour."""
    slopes = []
    for dy, dx in ((1, 0), (0, 1)):
        (before, is_before), (after, is_after) = ((grids.shifted(v, s * dy, s * dx), grids.shifted(known, s * dy, s * dx, False)) for s in (1, -1))
        slopes.append(np.where(is_before & is_after, (after - before) / 2, np.where(is_after, after - v, np.where(is_before, v - before, np.nan))))
    size = np.sqrt(slopes[0] * slopes[0] + slopes[1] * slopes[1])
    return np.where(known & ~np.isnan(size), size, 0.0)


def gradient_sums(places: DataFrame, pixels: DataFrame, value: str = "g") -> DataFrame:
    """image_id, y, x, energy of places (image_id, y, x; each once, not negative) that are pixels: gradient lengths summed over the square of 32 pixels that ends at 15 below and right.

    Tiles of pixels meet the places in them, so a pixel is sent a few times at most and only squares of places are summed.
    """
    prepare(pixels.sparkSession)
    kinds, tile = dict(places.dtypes), ["image_id", "__ty", "__tx"]
    sent = raster.in_tiles(pixels.select(*XY, F.col(value).cast("double").alias("v")), PATCH + 1, SMOOTH_TILE, 0)
    wanted = raster.in_tiles(places.select(*XY), 0, SMOOTH_TILE, 0)

    def run(px: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
        if not len(px) or not len(at):
            return pd.DataFrame({"image_id": [], "y": [], "x": [], "energy": []})
        (y0, x0), known, (v,) = raster.spread(px, ["v"])
        steep = _steepness(known, v)
        y, x = at["y"].to_numpy() - y0, at["x"].to_numpy() - x0
        inside = (y >= 0) & (y < known.shape[0]) & (x >= 0) & (x < known.shape[1])
        inside[inside] = known[y[inside], x[inside]]
        sums = [steep[max(0, b - PATCH) : b + PATCH, max(0, a - PATCH) : a + PATCH].sum() for b, a in zip(y[inside].tolist(), x[inside].tolist(), strict=True)]
        return at.loc[inside, XY].assign(energy=np.array(sums, dtype=float))

    return sent.groupBy(*tile).cogroup(wanted.groupBy(*tile)).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in XY) + ", energy double")


def noise_ratios(matches: DataFrame, pixels: DataFrame, sizes: DataFrame, value: str = "g") -> DataFrame:
    """image_id, id, ratio: how many times steeper the squares around one end are than around the other, the flatter counted as 1 at least; 1 where a square leaves the image."""
    whole = [(F.floor(c).cast("int") >= PATCH) & (F.floor(c).cast("int") <= F.col(side) - PATCH) for c, side in (("y", "height"), ("x", "width"), ("my", "height"), ("mx", "width"))]
    at = matches.select("image_id", "id", *[F.floor(c).cast("int").alias(f"__{c}") for c in ("y", "x", "my", "mx")], "y", "x", "my", "mx").join(sizes.select("image_id", "height", "width"), "image_id")
    at = at.filter(whole[0] & whole[1] & whole[2] & whole[3]).select("image_id", "id", "__y", "__x", "__my", "__mx")
    end = lambda y, x: at.select("image_id", F.col(y).alias("y"), F.col(x).alias("x"))
    energy = durable(gradient_sums(end("__y", "__x").unionByName(end("__my", "__mx")).distinct(), pixels, value), "energy")
    for y, x, name in (("__y", "__x", "p"), ("__my", "__mx", "q")):
        at = at.join(energy.select("image_id", F.col("y").alias(y), F.col("x").alias(x), F.col("energy").alias(name)), ["image_id", y, x])
    return at.select("image_id", "id", (F.greatest("p", "q") / F.greatest(F.lit(1.0), F.least("p", "q"))).alias("ratio"))


def turn_of(cos: float, sin: float) -> float:
    """Degrees from 0 to 360, to a tenth."""
    turn = float(np.degrees(np.arccos(np.clip(np.round(cos, 5), -1, 1))))
    return round(turn if sin > 0 or (sin == 0 and cos > 0) else 360 - turn, 1)


def turned_alike(turn: Column, tolerance: float, theta: Column | str = "theta", mtheta: Column | str = "mtheta") -> Column:
    """Whether a match's orientations differ by the turn, in either sense, to less than the tolerance; degrees."""
    degrees = lambda c: F.round(F.pmod(F.degrees(c), F.lit(360.0)), 1)
    off = F.pmod(degrees(mtheta) - degrees(theta), F.lit(360.0))
    return (F.abs(off - turn) < tolerance) | (F.abs(360 - off - turn) < tolerance)


def _turned_alike(turn: float, tolerance: float, theta: np.ndarray, mtheta: np.ndarray) -> np.ndarray:
    degrees = lambda a: np.round(np.degrees(a) % 360, 1)
    off = (degrees(mtheta) - degrees(theta)) % 360
    return (np.abs(off - turn) < tolerance) | (np.abs(360 - off - turn) < tolerance)


def local_models(local: DataFrame, sizes: DataFrame, reprojection: float = 5.0, rounds: int = 500) -> DataFrame:
    """MODEL, h (3 x 3, row-major, last entry 1), s0, s1 (its scales), turn (degrees), allowed (squared error), least_inliers, distance (mean, of local inliers): a plausible homography of the matches around each seed.

    local: matches of MODEL with `ratio` (noise_ratios, null for none). A model needs four inliers, scales between 0.2 and 8 (where scales are checked), and orientations
    that agree with its turn to 15 degrees in four of five inliers. The squared error that is allowed later grows with scale, rotation and noise. A group has a few of an image's seeds.
    """
    prepare(local.sparkSession)
    kinds = dict(local.dtypes)
    rules = local.join(sizes.select("image_id", F.col("allowed").alias("base"), "check_scale", "scale_weight", F.col("least_inliers").alias("least")), "image_id")

    def one(pdf: pd.DataFrame) -> list[tuple]:
        pdf, out = pdf.sort_values("id"), []
        a, b = pdf[["x", "y"]].to_numpy(dtype=float), pdf[["mx", "my"]].to_numpy(dtype=float)
        h, near = estimators.estimate("ransac", a, b, reprojection, rounds)
        if h is not None and near.sum() >= 4:
            first = pdf.iloc[0]
            u, s, v = np.linalg.svd(h[:2, :2])
            rotation = (u @ v).T
            turn = turn_of(rotation[0, 0], rotation[1, 0])
            angle = float(np.degrees(np.arccos(np.clip(rotation[0, 0], -1, 1))))
            plausible = not first["check_scale"] or (0.2 <= s.min() and s.max() <= 8)
            if plausible and _turned_alike(turn, 15, pdf["theta"].to_numpy(), pdf["mtheta"].to_numpy())[near].sum() >= 0.8 * near.sum():
                base, least = int(first["base"]), int(first["least"])
                grown = np.floor(max(abs(s[0] - 1), abs(s[1]) - 1) * first["scale_weight"] + max(0.0, angle - 5) * 0.2)
                allowed = max(base, min(30, base + grown))
                if 30 <= angle <= 70 or angle >= 105:
                    least = max(4, least - 1)
                if 0.8 < s.min() and s.max() < 1.2 and angle < 30:
                    ratios = np.sort(pdf["ratio"].fillna(1.0).to_numpy()[near])[1:-1]
                    noise = ratios.mean() if len(ratios) else 1.0
                    allowed += 100 if noise > 10000 else 60 if noise > 5000 else 30 if noise > 1000 else 0
                    if allowed > 60:
                        least = 4
                distance = float(np.sqrt(((a - b) ** 2).sum(axis=1))[near].mean())
                out.append((first["image_id"], first["seed"], h.ravel().tolist(), float(s[0]), float(s[1]), turn, float(allowed), least, distance))
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [row for _, own in pdf.groupby("seed", sort=False) for row in one(own)]
        return pd.DataFrame(out, columns=[*MODEL, "h", "s0", "s1", "turn", "allowed", "least_inliers", "distance"])

    made = f"image_id {kinds['image_id']}, seed {kinds['seed']}, h array<double>, s0 double, s1 double, turn double, allowed double, least_inliers int, distance double"
    # few bytes are much work here, so the partitions are not left to be put together by size
    dealt = rules.withColumn("__some", F.pmod(F.xxhash64("seed"), F.lit(4))).repartition(_partitions(rules), "image_id", "__some")
    return dealt.groupBy("image_id", "__some").applyInPandas(run, made)


def mapped(x: Column, y: Column, h: str = "h") -> tuple[Column, Column]:
    """(x, y) under a homography column; null where it goes to infinity."""
    m = [F.col(h)[i] for i in range(9)]
    w = m[6] * x + m[7] * y + m[8]
    w = F.when(F.abs(w) > 1e-12, w)
    return (m[0] * x + m[1] * y + m[2]) / w, (m[3] * x + m[4] * y + m[5]) / w


def model_inliers(matches: DataFrame, models: DataFrame) -> DataFrame:
    """MODEL, id, y, x, my, mx, scale, mscale, reversed: the image's matches that a model explains, from first end to second or else the other way round (ends swapped), with orientations that agree to 20 degrees."""
    every = matches.join(models.select(*MODEL, "h", "turn", "allowed"), "image_id")

    def error(y: str, x: str, my: str, mx: str) -> Column:
        px, py = mapped(F.col(x).cast("double"), F.col(y).cast("double"))
        return F.coalesce((px - F.col(mx)) * (px - F.col(mx)) + (py - F.col(my)) * (py - F.col(my)) < F.col("allowed"), F.lit(False))

    kept = every.withColumn("forward", error("y", "x", "my", "mx")).withColumn("reversed", ~F.col("forward") & error("my", "mx", "y", "x")).filter("forward OR reversed")
    swap = lambda p, q: F.when(F.col("reversed"), F.col(q)).otherwise(F.col(p)).alias(p)
    ends = [swap(p, q) for a, b in (("y", "my"), ("x", "mx"), ("scale", "mscale"), ("theta", "mtheta")) for p, q in ((a, b), (b, a))]
    return kept.select(*MODEL, "id", *ends, "turn", "reversed").filter(turned_alike(F.col("turn"), 20.0)).select(*MODEL, "id", "y", "x", "my", "mx", "scale", "mscale", "reversed")


def accepted_models(inliers: DataFrame, models: DataFrame, matches: DataFrame, sizes: DataFrame) -> DataFrame:
    """Models with enough inliers: as many as the model asks and the image's share, or enough in all; that move far enough, and do not follow a vertical or horizontal edge."""
    spread = [F.var_pop(c).alias(f"v_{c}") for c in ("y", "x", "my", "mx")] + [F.var_pop(F.abs(F.col(a) - F.col(b))).alias(f"d_{a}") for a, b in (("y", "my"), ("x", "mx"))]
    counted = inliers.groupBy(*MODEL).agg(F.count(F.lit(1)).alias("inliers"), *spread)
    sizes = sizes.select("image_id", F.col("allowed").alias("base"), "enough_inliers", "match_share", "check_distance", "least_distance", "check_edges")
    every = models.join(counted, MODEL).join(sizes, "image_id").join(matches.select("image_id", "n").distinct(), "image_id")
    random = (F.col("inliers") < F.greatest(F.col("least_inliers"), F.floor(F.col("n") * F.col("match_share")))) & (F.col("inliers") < F.col("enough_inliers"))
    close = (F.col("inliers") < 17) & F.col("check_distance") & (F.col("distance") < F.col("least_distance"))
    edge = (F.col("inliers") < 7) & F.col("check_edges") & (F.col("allowed") == F.col("base")) & (F.least("v_y", "v_x", "v_my", "v_mx") < 25) & (F.greatest("d_y", "d_x") < 1)
    return every.filter(~random & ~close & ~edge).select(*models.columns, "inliers")


def _three(v: np.ndarray, axis: int) -> np.ndarray:
    before, after = np.zeros_like(v), np.zeros_like(v)
    np.swapaxes(before, 0, axis)[1:] = np.swapaxes(v, 0, axis)[:-1]
    np.swapaxes(after, 0, axis)[:-1] = np.swapaxes(v, 0, axis)[1:]
    return before + v + after


def means(known: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Of each raster the means over squares of 3, of what is known; 0 elsewhere."""
    # the sums of a line count at its own pixels, as they do in rows
    number = _three(np.where(known, _three(known.astype(np.int64), 1), 0), 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return [np.where(known, _three(np.where(known, _three(v if v.dtype.kind == "f" else v.astype(np.int64), 1), 0), 0) / number, 0) for v in values]


def smoothed(pixels: DataFrame, bands: tuple[str, ...]) -> DataFrame:
    """Means over squares of 3, of what lies inside the image; coordinates are not negative."""
    return raster.by_tiles(pixels, list(bands), 1, lambda known, *values: dict(zip(bands, means(known, *values), strict=True)), ", ".join(f"{b} double" for b in bands), SMOOTH_TILE, 0)


def inverse(h: str = "h") -> Column:
    """The inverse of a homography column, by cofactors."""
    m = [F.col(h)[i] for i in range(9)]
    cofactor = lambda a, b, c, d: m[a] * m[d] - m[b] * m[c]
    adjugate = [cofactor(4, 5, 7, 8), cofactor(2, 1, 8, 7), cofactor(1, 2, 4, 5), cofactor(5, 3, 8, 6), cofactor(0, 2, 6, 8), cofactor(2, 0, 5, 3), cofactor(3, 4, 6, 7), cofactor(1, 0, 7, 6), cofactor(0, 1, 3, 4)]
    return F.array(*adjugate)


def _partitions(rows: DataFrame) -> int:
    """The session's number of partitions: what grows to many rows from a few bytes is dealt to all of them, whatever its size."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _pixels(spans: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) of stretches of lines."""
    low, n = spans["low"].to_numpy(), (spans["high"] - spans["low"] + 1).to_numpy()
    return np.repeat(spans["y"].to_numpy(), n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def _targets(h: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(y, x), rounded, of places under a homography; not a number where they go to infinity."""
    y, x = y.astype(float), x.astype(float)
    w = h[6] * x + h[7] * y + h[8]
    w = np.where(np.abs(w) > 1e-12, w, np.nan)
    return np.rint((h[3] * x + h[4] * y + h[5]) / w), np.rint((h[0] * x + h[1] * y + h[2]) / w)


def grown_discs(pixels: DataFrame, inliers: DataFrame, models: DataFrame, sizes: DataFrame, bands: tuple[str, ...] = ("g",)) -> DataFrame:
    """image_id, y, x, side (1 the first ends', 2 the second ends'): pixels in discs around the inliers, and their copies, whose smoothed colours differ by less than COLOUR in every band.

    A disc's radius is RADIUS_RATIO times the keypoint's scale (twice that for scales over 2.8) within the image's bounds. In images that ask for two directions, discs around the second
    ends go back by the inverse. Discs are drawn and meet colours in tiles of pixels; only pixels whose copies lie in another tile are joined as rows.
    """
    prepare(pixels.sparkSession)
    odd, large = (F.greatest("s0", "s1") > 1.1) | (F.least("s0", "s1") < 0.9), F.greatest("s0", "s1") > 2.8
    # scales that are near 1 keep the image's largest radius
    model = models.select(*MODEL, "h", F.when(large, 2 * RADIUS_RATIO).otherwise(RADIUS_RATIO).alias("by"), F.when(large, 50).when(odd, 12).otherwise(0).alias("more"))
    model = model.join(sizes.select("image_id", "height", "width", "largest_radius", "least_radius", "directions"), "image_id")
    way = F.explode(F.sequence(F.lit(1), F.col("directions"))).alias("way")
    model = model.select("*", way).withColumn("h", F.when(F.col("way") == 1, F.col("h")).otherwise(inverse()))
    end = lambda p, q: F.when(F.col("way") == 1, F.col(p)).otherwise(F.col(q))
    raw = end("scale", "mscale") * F.col("by")
    radius = F.when(raw > F.col("largest_radius"), F.col("largest_radius") + F.col("more")).when(raw < F.col("least_radius"), F.col("least_radius")).otherwise(raw).cast("int")
    centres = inliers.join(model.drop("h"), MODEL).select("image_id", "seed", "way", "height", "width", end("y", "my").cast("int").alias("cy"), end("x", "mx").cast("int").alias("cx"), radius.alias("r")).distinct()
    rows = centres.withColumn("y", F.explode(F.sequence(F.greatest(F.lit(0), F.col("cy") - F.col("r")), F.least(F.col("height") - 1, F.col("cy") + F.col("r")))))
    half = F.floor(F.sqrt((F.col("r") * F.col("r") - (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))).cast("double"))).cast("int")
    rows = rows.withColumns({"low": F.greatest(F.lit(0), F.col("cx") - half), "high": F.least(F.col("width") - 1, F.col("cx") + half)}).filter("low <= high")
    # the stretches of a line that discs share are united first, so a model has each of its pixels once
    spans = rows.groupBy("image_id", "seed", "way", "y", "low").agg(F.max("high").alias("high")).repartition(_partitions(pixels), "image_id", "seed", "way", "y")
    passed = F.max("high").over(Window.partitionBy("image_id", "seed", "way", "y").orderBy("low").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("low", F.greatest("low", F.coalesce(passed + 1, F.col("low")))).filter("low <= high")
    across = F.explode(F.sequence(F.expr(f"low div {SMOOTH_TILE}"), F.expr(f"high div {SMOOTH_TILE}")))
    discs = spans.withColumns({"__ty": F.expr(f"y div {SMOOTH_TILE}"), "__tx": across}).join(model.select(*MODEL, "way", "h", "height", "width"), [*MODEL, "way"])
    kinds, tile, side = dict(pixels.dtypes), ["image_id", "__ty", "__tx"], SMOOTH_TILE
    columns = [*XY, "side", "ty", "tx", *bands]

    def run(key: tuple, px: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(px) or not len(found):
            return pd.DataFrame({c: [] for c in columns})
        (y0, x0), known, values = raster.spread(px, list(bands))
        soft = means(known, *values)
        top, left = int(key[1]) * side - y0, int(key[2]) * side - x0  # the tile's own pixels begin there
        own = np.zeros_like(known)
        own[max(0, top) : top + side, max(0, left) : left + side] = known[max(0, top) : top + side, max(0, left) : left + side]
        marks, apart = np.zeros((2, *known.shape), dtype=bool), []
        for (_, way), some in found.groupby(["seed", "way"], sort=False):
            first, (y, x) = some.iloc[0], _pixels(some)
            y, x = y - y0, x - x0
            inside = (y >= 0) & (y < known.shape[0]) & (x >= 0) & (x < known.shape[1])
            inside[inside] = own[y[inside], x[inside]]
            y, x = y[inside], x[inside]
            ty, tx = _targets(np.asarray(first["h"], dtype=float), y + y0, x + x0)
            inside = (ty >= 0) & (ty < first["height"]) & (tx >= 0) & (tx < first["width"])
            y, x, ty, tx = y[inside], x[inside], ty[inside].astype(np.int64) - y0, tx[inside].astype(np.int64) - x0
            here = (ty >= max(0, top)) & (ty < min(known.shape[0], top + side)) & (tx >= max(0, left)) & (tx < min(known.shape[1], left + side))
            away = ~here & ~((ty >= top) & (ty < top + side) & (tx >= left) & (tx < left + side))
            apart.append(np.column_stack([np.full(int(away.sum()), way), y[away], x[away], ty[away], tx[away]]))
            y, x, ty, tx = (v[here] for v in (y, x, ty, tx))
            alike = own[ty, tx]
            for b in soft:
                alike = alike & (np.abs(b[y, x] - b[ty, tx]) < COLOUR)
            marks[way - 1, y[alike], x[alike]] = True
            marks[2 - way, ty[alike], tx[alike]] = True
        number, y, x = np.nonzero(marks)
        done = pd.DataFrame({"y": y + y0, "x": x + x0, "side": number + 1, "ty": -1, "tx": -1})
        way, y, x, ty, tx = np.unique(np.concatenate(apart), axis=0).T
        open_ = pd.DataFrame({"y": y + y0, "x": x + x0, "side": way, "ty": ty + y0, "tx": tx + x0} | {b: v[y, x] for b, v in zip(bands, soft, strict=True)})
        return pd.concat([done, open_] if len(open_) else [done]).assign(image_id=px["image_id"].iloc[0]).reindex(columns=columns)

    sent = raster.in_tiles(pixels.select(*XY, *bands), 1, side, 0)
    made = f"image_id {kinds['image_id']}, y {kinds['y']}, x {kinds['x']}, side int, ty int, tx int, " + ", ".join(f"{b} double" for b in bands)
    met = sent.groupBy(*tile).cogroup(discs.groupBy(*tile)).applyInPandas(run, made)
    if not sizes.filter((F.col("height") > side) | (F.col("width") > side)).limit(1).count():
        return met.select(*XY, "side")  # an image is one tile
    met = durable(met, "discs")
    done, away = met.filter("ty < 0").select(*XY, "side"), met.filter("ty >= 0")
    there = smoothed(pixels, bands).select("image_id", F.col("y").alias("ty"), F.col("x").alias("tx"), *[F.col(b).alias(f"t_{b}") for b in bands])
    both = away.join(there, ["image_id", "ty", "tx"])
    for b in bands:
        both = both.filter(F.abs(F.col(b) - F.col(f"t_{b}")) < COLOUR)
    return done.unionByName(both.select(*XY, "side")).unionByName(both.select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), (3 - F.col("side")).alias("side"))).distinct()


#: By half side of a closing element, what |y| + |x| goes to.
CORNERS = {4: 6, 6: 10, 14: 20}


def octagon(reach: int) -> list[tuple[int, int]]:
    """A square of that half side without its corners."""
    return [(y, x) for y, x in grids.box(reach) if abs(y) + abs(x) <= CORNERS[reach]]


def copied_areas(sides: DataFrame, models: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id, y, x: areas of either side that are large enough (4-connected), joined, closed and without small holes, of images where both sides have any."""
    prepare(sides.sparkSession)
    kind = dict(sides.dtypes)["image_id"]
    parts = durable(label_components(sides.withColumn("label", F.col("side").cast("int"))), "parts")
    big = parts.groupBy("image_id", "label", "component").count().join(sizes.select("image_id", "least_size"), "image_id").filter("count >= least_size").select("image_id", "label", "component")
    kept = parts.join(big, ["image_id", "label", "component"], "left_semi")
    both = kept.groupBy("image_id").agg(F.countDistinct("label").alias("s")).filter("s = 2").select("image_id")
    scale = models.groupBy("image_id").agg(F.max(F.greatest("s0", "s1")).alias("top"), F.min(F.least("s0", "s1")).alias("low"))
    reach = F.when(F.col("top") > 2.8, 14).when((F.col("top") > 1.1) | (F.col("low") < 0.9), 6).otherwise(4).alias("reach")
    rules = sizes.select("image_id", "height", "width", "largest_hole").join(scale.select("image_id", reach), "image_id")
    marked = kept.join(both, "image_id", "left_semi").select(*XY).distinct().join(rules, "image_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        mask = np.zeros((int(first["height"]), int(first["width"])), bool)
        mask[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = True
        mask = grids.fill_holes(grids.MORPHOLOGY["CLOSE"](mask, octagon(int(first["reach"]))), int(first["largest_hole"]))
        y, x = np.nonzero(mask)
        return pd.DataFrame({"image_id": first["image_id"], "y": y.astype(np.int32), "x": x.astype(np.int32)})

    return marked.groupBy("image_id").applyInPandas(run, f"image_id {kind}, y int, x int")


def matched(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """MATCH rows of pairs (image_id, a, b) of keypoints (image_id, id, y, x, scale, theta)."""
    side = lambda key, y, x, scale, theta: points.select("image_id", F.col("id").alias(key), F.col("y").alias(y), F.col("x").alias(x), F.col("scale").alias(scale), F.col("theta").alias(theta))
    both = pairs.join(side("a", "y", "x", "scale", "theta"), ["image_id", "a"]).join(side("b", "my", "mx", "mscale", "mtheta"), ["image_id", "b"])
    return both.withColumn("id", F.col("a") * (1 << 31) + F.col("b")).select(*MATCH)


def verified(matches: DataFrame, pixels: DataFrame, sizes: DataFrame, bands: tuple[str, ...] = ("g",), gray: str = "g") -> tuple[DataFrame, DataFrame]:
    """(models, areas): the accepted models with their inliers' number, and image_id, y, x of the copied areas. sizes: rows of settings()."""
    sizes = durable(sizes, "sizes")
    matches = durable(inside(matches, sizes), "matches")
    local = around(matches, seeds(matches), sizes).join(noise_ratios(matches, pixels, sizes, gray), ["image_id", "id"], "left")
    models = durable(local_models(local, sizes), "models")
    inliers = durable(model_inliers(matches, models), "inliers")
    good = durable(accepted_models(inliers, models, matches, sizes), "accepted")
    sides = durable(grown_discs(pixels, inliers, good, sizes, bands), "sides")
    return good, copied_areas(sides, good, sizes)
