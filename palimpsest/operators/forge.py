"""Forgery operators: each gives the changed pixels and the exact ground truth of what moved or changed.

Integer geometry is SQL on coordinates. Choices that would be random follow a seeded hash of the image and object.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import grids, inpainting
from palimpsest.operators import raster as R
from palimpsest.operators.images import XY
from palimpsest.session import durable, prepare

#: Families of the operators by name (fixed values).
MODALITIES = {
    "duplication": ("copy_move_forgery", "random_copy_move", "splicing_forgery", "overlap_forgery", "simple_copy"),
    "retouching": ("retouching_contrast", "retouching_brightness", "retouching_brightness_contrast", "retouching_blurring"),
    "cleaning": ("cleaning_using_bf", "cleaning_with_inpainting"),
}


def modality_of(name: Column) -> Column:
    out = F.lit("Not Implemented")
    for family, names in MODALITIES.items():
        out = F.when(name.isin(*names), family).otherwise(out)
    return out


def pick_objects(objects: DataFrame, n: int, seed: int = 0, label: str = "component") -> DataFrame:
    """Pixels of up to n objects of each image."""
    kinds = objects.select("image_id", label).distinct()
    order = Window.partitionBy("image_id").orderBy(F.xxhash64("image_id", label, F.lit(seed)), label)
    chosen = kinds.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n")
    return objects.join(chosen, ["image_id", label], "left_semi")


def retouch(pixels: DataFrame, objects: DataFrame, alpha: float, beta: float, height: int, width: int, grow: int = 1) -> tuple[DataFrame, DataFrame]:
    """Contrast and brightness of the objects, through their dilated shapes within their boxes."""
    box = R.boxes(objects, ["image_id"]).select("image_id", "y0", "y1", "x0", "x1")
    shape = R.dilate(objects, grids.box(grow), height, width).join(box, "image_id").filter("y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1").select(*XY)
    changed = pixels.join(shape.withColumn("__t", F.lit(True)), XY, "left")
    value = F.when(F.col("__t"), R.contrast(F.col("g"), alpha, beta)).otherwise(F.col("g"))
    return changed.select(*XY, value.alias("g")), shape.withColumn("label", F.lit(1))


def copy_move(pixels: DataFrame, objects: DataFrame, dy: Column, dx: Column, height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Objects moved by whole steps and pasted; truth has label 1 at the source and its copy, without what fell outside or on the source."""
    source = objects.select(*XY)
    moved = source.withColumn("ty", F.col("y") + dy).withColumn("tx", F.col("x") + dx).filter(F.col("ty").between(0, height - 1) & F.col("tx").between(0, width - 1))
    landed = moved.join(source.select("image_id", F.col("y").alias("ty"), F.col("x").alias("tx")), ["image_id", "ty", "tx"], "left_anti")
    copied = landed.join(pixels.select(*XY, "g"), XY).select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), "g")
    truth = landed.select(*XY, F.lit("source").alias("part")).unionByName(copied.select(*XY, F.lit("copy").alias("part")))
    return R.paste(pixels.select(*XY, "g"), copied, "g"), truth


def splice(donor: DataFrame, donor_objects: DataFrame, host: DataFrame, pairs: DataFrame, dy: int, dx: int, height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Objects of a donor image in a host image; pairs: (donor, host)."""
    moved = donor_objects.select(F.col("image_id").alias("donor"), "y", "x").join(pairs, "donor").join(donor.select(F.col("image_id").alias("donor"), "y", "x", "g"), ["donor", "y", "x"])
    moved = moved.select(F.col("host").alias("image_id"), (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), "g").filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    return R.paste(host.select(*XY, "g"), moved, "g"), moved.select(*XY, F.lit(1).alias("label"))


def overlap(images: DataFrame, height: int, width: int) -> DataFrame:
    """Two crops of one image and the ground truth of what they share, in each crop's frame.

    images: image_id and the crops' y0, x0, h, w as a_* and b_*. Rectangles are half-open.
    """
    low = lambda c: F.greatest(f"a_{c}0", f"b_{c}0")
    high = lambda c, s: F.least(F.col(f"a_{c}0") + F.col(f"a_{s}"), F.col(f"b_{c}0") + F.col(f"b_{s}"))
    shared = images.withColumns({"y0": low("y"), "x0": low("x"), "y1": high("y", "h"), "x1": high("x", "w")}).filter("y0 < y1 AND x0 < x1")
    frame = lambda k: [(F.col("y0") - F.col(f"{k}_y0")).alias(f"{k}_top"), (F.col("x0") - F.col(f"{k}_x0")).alias(f"{k}_left")]
    return shared.select("image_id", *frame("a"), *frame("b"), (F.col("y1") - F.col("y0")).alias("h"), (F.col("x1") - F.col("x0")).alias("w"))


def simple_copy(pixels: DataFrame, height: int, width: int, turns: int = 0, mirrored: bool = False, brightness: int = 0) -> DataFrame:
    """A whole image again, turned, mirrored or brightened; all of it is ground truth."""
    out = R.rotate90(pixels.select(*XY, "g"), height, width, turns)
    if mirrored:
        out = R.flip(out, *((height, width) if turns % 2 == 0 else (width, height)), "horizontal")
    return out.select(*XY, R.brighten(F.col("g"), F.lit(brightness)).alias("g"), F.lit(255).alias("truth"))


def clean_by_tiles(pixels: DataFrame, objects: DataFrame, tiles: DataFrame, tile_h: int, tile_w: int, label: str = "component", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Objects covered by free background tiles, no tile twice in an image; truth has both ends.

    Objects that fit a tile take the image's free tiles in seeded order; objects without a tile stay.
    """
    box = R.boxes(objects, ["image_id", label]).filter((F.col("y1") - F.col("y0") < tile_h) & (F.col("x1") - F.col("x0") < tile_w))
    n = lambda key: F.row_number().over(Window.partitionBy("image_id").orderBy(*key))
    a = box.select("image_id", label, "y0", "y1", "x0", "x1").withColumn("__n", n([F.xxhash64("image_id", label, F.lit(seed)), F.col(label)]))
    b = tiles.withColumn("__n", n([F.xxhash64("image_id", "ty", "tx", F.lit(seed)), F.col("ty"), F.col("tx")]))
    pair = a.join(b, ["image_id", "__n"])
    cover = pair.select("image_id", F.explode(F.sequence("y0", "y1")).alias("y"), "y0", "x0", "x1", "ty", "tx").withColumn("x", F.explode(F.sequence("x0", "x1")))
    cover = cover.withColumns({"sy": F.col("ty") + F.col("y") - F.col("y0"), "sx": F.col("tx") + F.col("x") - F.col("x0")})
    source = pixels.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("g").alias("__g"))
    patch = cover.join(source, ["image_id", "sy", "sx"])
    out = R.paste(pixels.select(*XY, "g"), patch.select(*XY, F.col("__g").alias("g")), "g")
    truth = patch.select(*XY, F.lit("object").alias("part")).unionByName(patch.select("image_id", F.col("sy").alias("y"), F.col("sx").alias("x"), F.lit("background").alias("part")))
    return out, truth.distinct()


def isolated(objects: DataFrame, by: int, label: str = "component") -> DataFrame:
    """Pixels of the objects whose box, enlarged by so many pixels on all sides, holds no pixel of another."""
    objects = durable(objects, "objects")  # read three times
    box = R.boxes(objects, ["image_id", label]).select("image_id", F.col(label).alias("__own"), "y0", "y1", "x0", "x1")
    near = F.col("y").between(F.col("y0") - by, F.col("y1") + by) & F.col("x").between(F.col("x0") - by, F.col("x1") + by)
    crowded = objects.join(box, "image_id").filter((F.col(label) != F.col("__own")) & near).select("image_id", F.col("__own").alias(label)).distinct()
    return objects.join(crowded, ["image_id", label], "left_anti")


def inpaint(packed: DataFrame, above: float, patch: int = 3) -> DataFrame:
    """Packed images with everything above a value filled from the rest."""
    return R.on_images(packed, lambda _, image: inpainting.inpaint(image, image > above, patch))


def inpaint_objects(pixels: DataFrame, objects: DataFrame, height: int, width: int, patch: int = 25) -> tuple[DataFrame, DataFrame]:
    """Objects filled from the rest of their image by exemplars; truth is what was filled. One image a task."""
    prepare(pixels.sparkSession)
    kind = dict(pixels.dtypes)["image_id"]
    marked = pixels.select(*XY, "g").join(objects.select(*XY).distinct().withColumn("hole", F.lit(True)), XY, "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        image, hole = np.zeros((height, width)), np.zeros((height, width), bool)
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        image[y, x], hole[y, x] = pdf["g"], pdf["hole"].notna()
        filled = np.floor(inpainting.inpaint(image, hole, patch) + 0.5).astype(np.int32)
        return pd.DataFrame({"image_id": pdf["image_id"], "y": y, "x": x, "g": filled[y, x]})

    out = marked.groupBy("image_id").applyInPandas(run, f"image_id {kind}, y int, x int, g int")
    return out, objects.select(*XY).distinct().withColumn("label", F.lit(1))


def blur_objects(pixels: DataFrame, objects: DataFrame, height: int, width: int, radius: int = 5, level: int = 1, grow: int = 3, label: str = "component") -> tuple[DataFrame, DataFrame]:
    """Objects softened by means over squares, `level` times, each within its own box and through its dilated shape; truth is what changed places. Means are of what lies in the box; in two boxes the lesser object counts."""
    key = ["image_id", label]
    box = R.boxes(objects, key).select(*key, "y0", "y1", "x0", "x1")
    soft = box.join(pixels.select(*XY, F.col("g").cast("double").alias("v")), "image_id").filter("y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1").select(*key, "y", "x", "v")
    along = Window.partitionBy(*key, "y").orderBy("x").rangeBetween(-radius, radius)
    down = Window.partitionBy(*key, "x").orderBy("y").rangeBetween(-radius, radius)
    for _ in range(level):
        rows = soft.select(*key, "y", "x", F.sum("v").over(along).alias("v"), F.count("v").over(along).alias("n"))
        soft = rows.select(*key, "y", "x", (F.sum("v").over(down) / F.sum("n").over(down)).alias("v"))
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in grids.box(grow)]))
    shape = objects.select(*key, "y", "x").withColumn("o", near).select(*key, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()
    changed = soft.join(shape, [*key, "y", "x"]).groupBy(*XY).agg(F.min_by("v", label).alias("v"))
    value = changed.select(*XY, F.floor(F.round("v", 6) + 0.5).cast("int").alias("g"))
    return R.paste(pixels.select(*XY, "g"), value, "g"), value.select(*XY, F.lit(1).alias("label"))


def overlap_crops(pixels: DataFrame, first: tuple[int, int, int, int], second: tuple[int, int, int, int]) -> tuple[DataFrame, DataFrame]:
    """(image_id, crop, y, x, g) of two crops (y0, x0, height, width) of each image, in their own frames, and (image_id, crop, y, x) of what they share."""
    out, truth = None, None
    inside = lambda c: F.col("y").between(c[0], c[0] + c[2] - 1) & F.col("x").between(c[1], c[1] + c[3] - 1)
    for n, crop in enumerate((first, second)):
        place = ["image_id", F.lit(n + 1).alias("crop"), (F.col("y") - crop[0]).alias("y"), (F.col("x") - crop[1]).alias("x")]
        own = pixels.filter(inside(crop)).select(*place, "g")
        shared = pixels.filter(inside(first) & inside(second)).select(*place)
        out, truth = (own, shared) if out is None else (out.unionByName(own), truth.unionByName(shared))
    return out, truth


def applied_type(types: tuple[str, ...]) -> str:
    """The one transformation that is applied of those asked for: a flip before a translation before a rotation."""
    for one in ("flip", "translation", "rotation"):
        if one in types:
            return one
    raise ValueError(f"none of flip, translation, rotation in {types}")


def poisson_move(packed: DataFrame, above: float, dy: int, dx: int) -> DataFrame:
    """Objects moved with their gradients, blended at the border."""

    def kernel(_, stack: np.ndarray) -> np.ndarray:
        moved = lambda a, fill: grids.shifted(a.transpose(1, 2, 0), dy, dx, fill).transpose(2, 0, 1)
        return grids.poisson_clones(stack, moved(stack, 0), moved(stack > above, False))

    return R.on_alike(packed, kernel)


def parameters(images: DataFrame, seed: int = 0) -> DataFrame:
    """Seeded parameters of an image: alpha in [0, 2), beta in [20, 100), quarter turns, mirrored, shift."""
    u = lambda k: F.pmod(F.xxhash64("image_id", F.lit(seed), F.lit(k)), F.lit(1_000_000)) / 1_000_000
    return images.select("image_id", (u(1) * 2).alias("alpha"), F.floor(20 + u(2) * 80).cast("int").alias("beta"), F.floor(u(3) * 4).cast("int").alias("turns"), (u(4) < 0.5).alias("mirrored"), F.floor(1 + u(5) * 3).cast("int").alias("shift"))


def annotation(names: DataFrame) -> DataFrame:
    """image_id, annotation: the metadata document of (image_id, function_name, height, width, args)."""
    info = F.struct(F.lit("forgery").alias("class"), modality_of(F.col("function_name")).alias("modality"), F.lit("simple").alias("figure_type"), "function_name", "args")
    figure = F.struct("height", "width", F.col("image_id").cast("string").alias("image_id"))
    return names.select("image_id", F.to_json(F.struct(info.alias("forgery_info"), figure.alias("figure_annotations"))).alias("annotation"))


def _sampled(at: DataFrame, pixels: DataFrame, objects: DataFrame, height: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Pixels and truth where (ty, tx) takes the object pixel (y, x), but for what falls outside or on the objects."""
    at = at.filter(F.col("ty").between(0, height - 1) & F.col("tx").between(0, width - 1)).join(objects.select(*XY).distinct(), XY, "left_semi")
    landed = at.join(objects.select("image_id", F.col("y").alias("ty"), F.col("x").alias("tx")).distinct(), ["image_id", "ty", "tx"], "left_anti")
    copied = landed.join(pixels.select(*XY, "g"), XY).select("image_id", F.col("ty").alias("y"), F.col("tx").alias("x"), "g")
    truth = landed.select(*XY, F.lit("source").alias("part")).distinct().unionByName(copied.select(*XY, F.lit("copy").alias("part")))
    return R.paste(pixels.select(*XY, "g"), copied, "g"), truth


def turned_copy(pixels: DataFrame, objects: DataFrame, height: int, width: int, dy: int, dx: int, turns: int = 0, mirrored: bool = False, up: int = 1, down: int = 1) -> tuple[DataFrame, DataFrame]:
    """Each image's objects as one piece, mirrored left to right, turned clockwise by quarters, scaled by up / down and pasted at (dy, dx) from their box.

    Every target pixel takes the nearest sample by the inverse transform, so the copy has no holes. What falls outside or on the objects is left out; truth has
    the copy, and as source the pixels that were sampled for it.
    """
    box = R.boxes(objects, ["image_id"]).select("image_id", "y0", "x0", (F.col("y1") - F.col("y0") + 1).alias("h"), (F.col("x1") - F.col("x0") + 1).alias("w"))
    upright = turns % 2 == 0
    box = box.withColumns({"th": F.col("h" if upright else "w"), "tw": F.col("w" if upright else "h")})
    scaled = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * up / down)).cast("int")
    grid = box.withColumns({"nh": scaled("th"), "nw": scaled("tw")}).withColumn("r", F.explode(F.expr("sequence(0, nh - 1)"))).withColumn("c", F.explode(F.expr("sequence(0, nw - 1)")))
    grid = grid.withColumns({"i": F.expr("cast(r * th div nh AS int)"), "j": F.expr("cast(c * tw div nw AS int)")})
    sy, sx = {0: ("i", "j"), 1: ("h - 1 - j", "i"), 2: ("h - 1 - i", "w - 1 - j"), 3: ("j", "w - 1 - i")}[turns % 4]
    sx = f"w - 1 - ({sx})" if mirrored else sx
    at = grid.select("image_id", F.expr(f"y0 + {sy}").alias("y"), F.expr(f"x0 + {sx}").alias("x"), (F.col("y0") + dy + F.col("r")).alias("ty"), (F.col("x0") + dx + F.col("c")).alias("tx"))
    return _sampled(at, pixels, objects, height, width)


def rotated_copy(pixels: DataFrame, objects: DataFrame, height: int, width: int, dy: int, dx: int, degrees: float, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Each image's objects as one piece, turned clockwise by any angle about the centre of their box, scaled and moved by (dy, dx).

    Every target pixel takes the nearest sample by the inverse transform, in units of 2^-16, so the copy has no holes and no result depends on rounding.
    What falls outside or on the objects is left out; truth is as in turned_copy(). Target pixels are made within the reach of the turned box alone.
    """
    if scale <= 0:
        raise ValueError("scale must be positive")
    a, b = rotation_units(degrees, scale)
    cos, sin = abs(math.cos(math.radians(degrees))) * scale, abs(math.sin(math.radians(degrees))) * scale
    box = R.boxes(objects, ["image_id"]).select("image_id", (F.col("y0") + F.col("y1")).alias("cy"), (F.col("x0") + F.col("x1")).alias("cx"), (F.col("y1") - F.col("y0") + 1).alias("h"), (F.col("x1") - F.col("x0") + 1).alias("w"))
    reach = box.withColumns({"ry": F.ceil((F.col("h") * cos + F.col("w") * sin) / 2) + 1, "rx": F.ceil((F.col("w") * cos + F.col("h") * sin) / 2) + 1})
    for axis, shift, last in (("y", dy, height - 1), ("x", dx, width - 1)):
        centre = F.floor(F.col(f"c{axis}") / 2) + shift
        reach = reach.withColumns({f"low{axis}": F.greatest(F.lit(0), centre - F.col(f"r{axis}")).cast("int"), f"high{axis}": F.least(F.lit(last), centre + F.col(f"r{axis}")).cast("int")})
    spots = reach.filter("lowy <= highy AND lowx <= highx").withColumn("ty", F.explode(F.expr("sequence(lowy, highy)"))).withColumn("tx", F.explode(F.expr("sequence(lowx, highx)")))
    spots = spots.withColumns({"u": (2 * (F.col("ty") - dy) - F.col("cy")).cast("long"), "v": (2 * (F.col("tx") - dx) - F.col("cx")).cast("long")})
    nearest = lambda centre, turned: F.floor((F.col(centre) * 65536 + turned + 65536) / 131072.0).cast("int")
    at = spots.select("image_id", nearest("cy", F.col("u") * a - F.col("v") * b).alias("y"), nearest("cx", F.col("v") * a + F.col("u") * b).alias("x"), "ty", "tx")
    return _sampled(at, pixels, objects, height, width)


def rotation_units(degrees: float, scale: float) -> tuple[int, int]:
    """Cosine and sine by scale, in units of 2^-16."""
    return round(65536 * math.cos(math.radians(degrees)) / scale), round(65536 * math.sin(math.radians(degrees)) / scale)


def tile_moves(objects: DataFrame, tiles: DataFrame, pairs: DataFrame, tile_h: int, tile_w: int, n: int, label: str = "component", seed: int | None = None) -> DataFrame:
    """donor, host, label, dy, dx, index: up to n objects of each donor that fit a tile, each with a free tile of its host of its own.

    pairs: (donor, host), at most one host a donor. Objects and tiles go in seeded order, without a seed in that of their labels and places.
    """
    box = R.boxes(objects, ["image_id", label]).filter((F.col("y1") - F.col("y0") < tile_h) & (F.col("x1") - F.col("x0") < tile_w))
    order = lambda *c: [*([] if seed is None else [F.xxhash64(*c, F.lit(seed))]), *map(F.col, c)]
    a = box.select(F.col("image_id").alias("donor"), label, "y0", "x0").withColumn("index", F.row_number().over(Window.partitionBy("donor").orderBy(*order(label)))).filter(F.col("index") <= n)
    b = tiles.select(F.col("image_id").alias("host"), "ty", "tx").withColumn("index", F.row_number().over(Window.partitionBy("host").orderBy(*order("ty", "tx"))))
    return a.join(pairs, "donor").join(b, ["host", "index"]).select("donor", "host", label, (F.col("ty") - F.col("y0")).alias("dy"), (F.col("tx") - F.col("x0")).alias("dx"), "index")


def to_tiles(donor: DataFrame, objects: DataFrame, host: DataFrame, moves: DataFrame, label: str = "component") -> tuple[DataFrame, DataFrame]:
    """Host images with the moved objects; truth has the index that source and copy share, in donor and host coordinates."""
    moved = objects.withColumnRenamed("image_id", "donor").join(moves, ["donor", label]).join(donor.select(F.col("image_id").alias("donor"), "y", "x", "g"), ["donor", "y", "x"])
    copied = moved.select(F.col("host").alias("image_id"), (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "g", "index")
    source = moved.select(F.col("donor").alias("image_id"), "y", "x", F.lit("source").alias("part"), "index")
    return R.paste(host.select(*XY, "g"), copied, "g"), source.unionByName(copied.select(*XY, F.lit("copy").alias("part"), "index"))


def random_copy_move(pixels: DataFrame, objects: DataFrame, height: int, width: int, tile_h: int, tile_w: int, n: int = 1, label: str = "component", seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Up to n objects of each image in free tiles of it."""
    objects = durable(objects, "objects")  # boxes, tiles and what moves read them
    images = pixels.select("image_id").distinct()
    tiles = R.free_tiles(images, objects, height, width, tile_h, tile_w)
    moves = tile_moves(objects, tiles, images.select(F.col("image_id").alias("donor"), F.col("image_id").alias("host")), tile_h, tile_w, n, label, seed)
    return to_tiles(pixels, objects, pixels, moves, label)


def splice_to_tiles(donor: DataFrame, donor_objects: DataFrame, host: DataFrame, host_objects: DataFrame, pairs: DataFrame, height: int, width: int, tile_h: int, tile_w: int, n: int = 1, label: str = "component", seed: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Up to n objects of each donor in free tiles of its host; pairs: (donor, host)."""
    same = host_objects is donor_objects
    donor_objects = durable(donor_objects, "objects")  # boxes and what moves read them
    tiles = R.free_tiles(host.select("image_id").distinct(), donor_objects if same else host_objects, height, width, tile_h, tile_w)
    return to_tiles(donor, donor_objects, host, tile_moves(donor_objects, tiles, pairs, tile_h, tile_w, n, label, seed), label)


def forge(name: str, pixels: DataFrame, objects: DataFrame, height: int, width: int, **arguments) -> tuple[DataFrame, DataFrame]:
    """The forgery of that name: changed pixels and ground truth. An unknown name, or arguments that the operator lacks, raise ValueError before any work."""
    import inspect

    def copy_move_forgery(dy, dx, types=("translation",), turns=0, mirrored=False, up=1, down=1, degrees=0.0, scale=1.0):
        kind = "flip" if mirrored else applied_type(types)
        if kind == "rotation":
            return rotated_copy(pixels, objects, height, width, dy, dx, degrees, scale)
        return turned_copy(pixels, objects, height, width, dy, dx, turns, kind == "flip", up, down)

    def whole_copy(turns=0, mirrored=False, brightness=0):
        out = simple_copy(pixels, height, width, turns, mirrored, brightness)
        return out.select(*XY, "g"), out.select(*XY, F.col("truth").alias("label"))

    makers = {
        "retouching_contrast": lambda alpha: retouch(pixels, objects, alpha, 0, height, width),
        "retouching_brightness": lambda beta: retouch(pixels, objects, 1.0, beta, height, width),
        "retouching_brightness_contrast": lambda alpha, beta: retouch(pixels, objects, alpha, beta, height, width),
        "copy_move_forgery": copy_move_forgery,
        "overlap_forgery": lambda first, second: overlap_crops(pixels, first, second),
        "simple_copy": whole_copy,
        "retouching_blurring": lambda radius=5, level=1: blur_objects(pixels, objects, height, width, radius, level),
        "cleaning_with_inpainting": lambda patch=25: inpaint_objects(pixels, objects, height, width, patch),
        "random_copy_move": lambda tile_h, tile_w, n=1, seed=0: random_copy_move(pixels, objects, height, width, tile_h, tile_w, n, seed=seed),
        "splicing_forgery": lambda host, host_objects, pairs, tile_h, tile_w, n=1, seed=0: splice_to_tiles(pixels, objects, host, host_objects, pairs, height, width, tile_h, tile_w, n, seed=seed),
        "cleaning_using_bf": lambda tile_h, tile_w, seed=0: clean_by_tiles(pixels, objects, R.free_tiles(pixels.select("image_id").distinct(), objects, height, width, tile_h, tile_w), tile_h, tile_w, seed=seed),
    }
    if name not in makers:
        raise ValueError(f"{name}: one of {', '.join(sorted(makers))}")
    known = inspect.signature(makers[name]).parameters
    lacking = [p for p, v in known.items() if v.default is inspect.Parameter.empty and p not in arguments]
    if lacking or set(arguments) - set(known):
        raise ValueError(f"{name} takes {', '.join(known)}")
    return makers[name](**arguments)
