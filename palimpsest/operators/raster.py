"""Raster operators. On sparse or exploded pixels they are joins, windows and arithmetic on coordinates;
what needs iteration over a neighbourhood runs per image on the packed tier."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import grids
from palimpsest.operators.images import XY
from palimpsest.session import prepare


def clamp(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v))


def brighten(v: Column, by: Column | float) -> Column:
    return clamp(v + by)


def expose(v: Column, stops: float) -> Column:
    return F.least(F.lit(255.0), v * F.pow(F.lit(2.0), F.lit(float(stops))))


def contrast(v: Column, alpha: float, beta: float = 0.0) -> Column:
    """alpha v + beta, cut to a whole number and to 0..255."""
    return clamp(F.floor(v * alpha + beta).cast("int"))


def boxes(labels: DataFrame, by: list[str]) -> DataFrame:
    """Bounding box, centroid and size of each object."""
    return labels.groupBy(*by).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count(F.lit(1)).alias("size"))


def enlarged(box: DataFrame, by: int, height: int, width: int) -> DataFrame:
    return box.withColumns({"y0": F.greatest(F.col("y0") - by, F.lit(0)), "x0": F.greatest(F.col("x0") - by, F.lit(0)), "y1": F.least(F.col("y1") + by, F.lit(height - 1)), "x1": F.least(F.col("x1") + by, F.lit(width - 1))})


def drop_border_objects(objects: DataFrame, height: int, width: int, label: str = "component") -> DataFrame:
    """Objects that touch no edge, relabelled from 1 in the order of their labels."""
    edge = objects.filter((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1)).select("image_id", label).distinct()
    kept = objects.join(edge, ["image_id", label], "left_anti")
    return kept.withColumn("label", F.dense_rank().over(Window.partitionBy("image_id").orderBy(label)))


def open_area(objects: DataFrame, least: int, label: str = "component") -> DataFrame:
    """Objects of at least so many pixels."""
    sizes = objects.groupBy("image_id", label).count().filter(F.col("count") >= least)
    return objects.join(sizes.select("image_id", label), ["image_id", label], "left_semi")


def free_tiles(images: DataFrame, mask: DataFrame, height: int, width: int, tile_h: int, tile_w: int) -> DataFrame:
    """image_id, ty, tx of the grid tiles without an object pixel."""
    ys = F.explode(F.sequence(F.lit(0), F.lit(height - tile_h), F.lit(tile_h)))
    xs = F.explode(F.sequence(F.lit(0), F.lit(width - tile_w), F.lit(tile_w)))
    tiles = images.select("image_id").withColumn("ty", ys).withColumn("tx", xs)
    used = mask.select("image_id", F.expr(f"(y div {tile_h}) * {tile_h}").cast("int").alias("ty"), F.expr(f"(x div {tile_w}) * {tile_w}").cast("int").alias("tx")).distinct()
    return tiles.join(used, ["image_id", "ty", "tx"], "left_anti")


def _near(mask: DataFrame, element: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    offsets = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in element]))
    moved = mask.select(*XY).withColumn("o", offsets).select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    return moved.filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def dilate(mask: DataFrame, element: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    return _near(mask, element, height, width).distinct()


def erode(mask: DataFrame, element: list[tuple[int, int]], height: int, width: int) -> DataFrame:
    """Pixels whose whole neighbourhood within the raster is set: as many set neighbours as lie inside."""
    inside = sum((F.when((F.col("y") + dy).between(0, height - 1) & (F.col("x") + dx).between(0, width - 1), 1).otherwise(0) for dy, dx in element), F.lit(0))
    back = [(-dy, -dx) for dy, dx in element]
    return _near(mask, back, height, width).groupBy(*XY).count().filter(F.col("count") == inside).select(*XY)


def flip(pixels: DataFrame, height: int, width: int, axis: str) -> DataFrame:
    return pixels.withColumn("x", width - 1 - F.col("x")) if axis == "horizontal" else pixels.withColumn("y", height - 1 - F.col("y"))


def rotate90(pixels: DataFrame, height: int, width: int, turns: int) -> DataFrame:
    """Counter-clockwise quarter turns."""
    for _ in range(turns % 4):
        pixels = pixels.withColumns({"y": width - 1 - F.col("x"), "x": F.col("y")})
        height, width = width, height
    return pixels


def paste(target: DataFrame, source: DataFrame, value: str) -> DataFrame:
    """Target pixels, with the source's value where it has one."""
    return target.join(source.select(*XY, F.col(value).alias("__s")), XY, "left").withColumn(value, F.coalesce("__s", value)).drop("__s")


def union_masks(masks: DataFrame, value: str) -> DataFrame:
    """One mask an image: the bitwise or of its objects' masks."""
    return masks.groupBy(*XY).agg(F.bit_or(value).alias(value))


def labels_of(masks: DataFrame, label: str = "label") -> DataFrame:
    """image_id, label: the labels of each image without the background's 0."""
    return masks.select("image_id", label).distinct().filter(F.col(label) != 0)


def subimage(pixels: DataFrame, value: str, opacity: float, height: int, width: int, radius: int = 2) -> DataFrame:
    """The mask of what is at least that opaque, worn off by a square."""
    return erode(pixels.filter(F.col(value) >= opacity), grids.box(radius), height, width)


def to_8bit(pixels: DataFrame, value: str) -> DataFrame:
    """Each image's own range to 0..255, cut to whole numbers; a flat image is 0."""
    w = Window.partitionBy("image_id")
    low, high = F.min(value).over(w), F.max(value).over(w)
    return pixels.withColumn("byte", F.coalesce(F.floor(F.try_divide(F.col(value) - low, high - low) * 255), F.lit(0)).cast("int"))


def quadrant(height: int, width: int) -> Column:
    """top_left, bottom_left, bottom_right or top_right."""
    top, left = F.col("y") < height // 2, F.col("x") < width // 2
    return F.when(top & left, "top_left").when(~top & left, "bottom_left").when(~top & ~left, "bottom_right").otherwise("top_right")


def integral(pixels: DataFrame, value: str) -> DataFrame:
    """Sums over everything above and to the left, itself included: two running windows."""
    rows = pixels.withColumn("__r", F.sum(value).over(Window.partitionBy("image_id", "y").orderBy("x")))
    return rows.withColumn("integral", F.sum("__r").over(Window.partitionBy("image_id", "x").orderBy("y"))).drop("__r")


def box_sums(pixels: DataFrame, value: str, radius: int, height: int, width: int) -> DataFrame:
    """Sums over the square of a radius, by running windows along rows and then columns."""
    along = Window.partitionBy("image_id", "y").orderBy("x").rangeBetween(-radius, radius)
    down = Window.partitionBy("image_id", "x").orderBy("y").rangeBetween(-radius, radius)
    return pixels.withColumn("__r", F.sum(value).over(along)).withColumn("box", F.sum("__r").over(down)).drop("__r")


def haar(pixels: DataFrame, value: str) -> DataFrame:
    """One level: image_id, y, x at half size with ll, hl, lh, hh."""
    at = lambda dy, dx: F.sum(F.when((F.col("y") % 2 == dy) & (F.col("x") % 2 == dx), F.col(value)).otherwise(0.0))
    cells = pixels.groupBy("image_id", F.expr("y div 2").cast("int").alias("hy"), F.expr("x div 2").cast("int").alias("hx")).agg(at(0, 0).alias("a"), at(0, 1).alias("b"), at(1, 0).alias("c"), at(1, 1).alias("d"))
    return cells.select("image_id", F.col("hy").alias("y"), F.col("hx").alias("x"), F.expr("(a + b + c + d) / 2").alias("ll"), F.expr("(a - b + c - d) / 2").alias("hl"), F.expr("(a + b - c - d) / 2").alias("lh"), F.expr("(a - b - c + d) / 2").alias("hh"))


def segment_size(pixels: DataFrame, value: str, levels: int) -> DataFrame:
    """image_id, low_share, size: the segment side by how much energy the low band keeps after `levels` levels."""
    sized = pixels.groupBy("image_id").agg((F.count(F.lit(1))).alias("area"), F.sum(F.col(value) * F.col(value)).alias("energy"))
    low = pixels.select(*XY, F.col(value).alias("v"))
    for _ in range(levels):
        low = haar(low, "v").select(*XY, F.col("ll").alias("v"))
    kept = low.groupBy("image_id").agg(F.sum(F.col("v") * F.col("v")).alias("low"))
    joined = sized.join(kept, "image_id").withColumn("low_share", F.coalesce(F.try_divide("low", "energy"), F.lit(0.0)))
    return joined.select("image_id", "low_share", F.sqrt(F.when(F.col("low_share") > 0.5, 0.02).otherwise(0.01) * F.col("area")).alias("size"))


def entropy(pixels: DataFrame, by: list[str], value: str) -> DataFrame:
    """Bits of the value histogram of each block."""
    counts = pixels.groupBy(*by, value).count()
    total = counts.withColumn("n", F.sum("count").over(Window.partitionBy(*by)))
    return total.groupBy(*by).agg(F.sum(-(F.col("count") / F.col("n")) * F.log2(F.col("count") / F.col("n"))).alias("entropy"))


def difference(a: DataFrame, b: DataFrame, bands: list[str]) -> DataFrame:
    """Pixels in which any band differs."""
    other = b.select(*XY, *[F.col(c).alias(f"__{c}") for c in bands])
    differs = F.lit(False)
    for c in bands:
        differs = differs | (F.col(c) != F.col(f"__{c}"))
    return a.join(other, XY).filter(differs).select(*XY)


def yuv() -> list[Column]:
    """Orthonormal colour axes of bands r, g, b."""
    return [F.expr("(r + g + b) / sqrt(3D)").alias("lum"), F.expr("(r - b) / sqrt(2D)").alias("cu"), F.expr("(r - 2 * g + b) / sqrt(6D)").alias("cv")]


def gray_of(bands: str = "GRAY") -> Column:
    """One band of r, g, b by name, or their luminance."""
    named = {"RED": "r", "GREEN": "g", "BLUE": "b"}
    return F.col(named[bands]) if bands in named else F.expr("0.299D * r + 0.587D * g + 0.114D * b")


#: Side of the tiles that neighbourhoods are computed in, and pixels of a neighbourhood up to which it is sent as rows.
TILE, NEAR = 128, 13


def in_tiles(pixels: DataFrame, reach: int, side: int, least: int | None = None) -> DataFrame:
    """Each row once for every tile (__ty, __tx) that has a pixel at most `reach` away. least: the least coordinate there is, where it is known; no tile before it is made."""

    def tiles(c: str) -> Column:
        first = F.floor((F.col(c) - reach) / side)
        return F.explode(F.sequence(first if least is None else F.greatest(first, F.lit(least // side)), F.floor((F.col(c) + reach) / side)))

    return pixels.withColumn("__ty", tiles("y")).withColumn("__tx", tiles("x"))


def spread(pdf: pd.DataFrame, values: list[str]) -> tuple[tuple[int, int], np.ndarray, list[np.ndarray]]:
    """(least y, least x), known (height, width): where pixels are, and an array of each value, 0 elsewhere."""
    y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
    y0, x0 = int(y.min()), int(x.min())
    at = (y - y0, x - x0)
    known = np.zeros((at[0].max() + 1, at[1].max() + 1), dtype=bool)
    known[at] = True
    arrays = []
    for c in values:
        v = pdf[c].to_numpy()
        arrays.append(np.zeros(known.shape, dtype=v.dtype))
        arrays[-1][at] = v
    return (y0, x0), known, arrays


def by_tiles(field: DataFrame, values: list[str], reach: int, kernel: Callable[..., dict[str, np.ndarray]], made: str, side: int = TILE, least: int | None = None) -> DataFrame:
    """XY and what a numpy kernel makes of each pixel's neighbourhood, tile by tile: a tile gets its own pixels and those at most `reach` away, so a pixel is sent a few times at most, and a large image is many keys.

    least: the least coordinate there is, where it is known; no tile before it is made. kernel: takes known (height, width), where pixels are, and an array of each value (0 elsewhere); returns arrays by the names of `made`, of which the tile's own pixels are taken, with `keep`, if there, those it marks.
    """
    prepare(field.sparkSession)
    kinds = dict(field.dtypes)
    names = [c.strip().split(" ")[0] for c in made.split(",")]

    sent = in_tiles(field.select(*XY, *values), reach, side, least)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        own = (y // side == key[1]) & (x // side == key[2])
        (y0, x0), known, arrays = spread(pdf, values)
        at = (y - y0, x - x0)
        out = kernel(known, *arrays)
        if "keep" in out:
            own = own & out["keep"][at]
        at = (at[0][own], at[1][own])
        return pd.DataFrame({"image_id": key[0], "y": y[own], "x": x[own], **{c: out[c][at] for c in names}})

    return sent.groupBy("image_id", "__ty", "__tx").applyInPandas(run, f"image_id {kinds['image_id']}, y {kinds['y']}, x {kinds['x']}, {made}")


def closed(mask: DataFrame, element: list[tuple[int, int]], height: int, width: int, side: int = TILE) -> DataFrame:
    """dilate() and then erode(), tile by tile: a tile gets the set pixels that can change it, so a pixel is sent a few times at most instead of once a neighbour."""
    prepare(mask.sparkSession)
    reach, kinds = 2 * max(max(abs(dy), abs(dx)) for dy, dx in element), dict(mask.dtypes)
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side)))
    sent = mask.select(*XY).withColumn("ty", tiles("y")).filter(F.col("ty").between(0, (height - 1) // side)).withColumn("tx", tiles("x")).filter(F.col("tx").between(0, (width - 1) // side))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y1, x1 = (int(k) * side for k in key[1:])
        h, w = min(side, height - y1), min(side, width - x1)
        near = np.zeros((h + 2 * reach, w + 2 * reach), dtype=bool)
        near[pdf["y"].to_numpy() - y1 + reach, pdf["x"].to_numpy() - x1 + reach] = True
        near = grids.dilate(near, element)
        ys, xs = np.arange(y1 - reach, y1 + h + reach), np.arange(x1 - reach, x1 + w + reach)
        near |= ~((ys >= 0) & (ys < height))[:, None] | ~((xs >= 0) & (xs < width))
        y, x = np.nonzero(grids.erode(near, element)[reach : reach + h, reach : reach + w])
        return pd.DataFrame({"image_id": [key[0]] * len(y), "y": y + y1, "x": x + x1})

    return sent.groupBy("image_id", "ty", "tx").applyInPandas(run, f"image_id {kinds['image_id']}, y {kinds['y']}, x {kinds['x']}")


def medians(field: DataFrame, value: str | list[str], element: list[tuple[int, int]]) -> DataFrame:
    """Median of a value over a neighbourhood, among the pixels that have one; of several values, in columns of their names.

    One value goes to neighbourhoods of up to NEAR pixels as rows; all else goes by tiles.
    """
    if isinstance(value, str) and len(element) <= NEAR:
        offsets = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in element]))
        near = field.withColumn("o", offsets).select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), value)
        return near.join(field.select(*XY), XY, "left_semi").groupBy(*XY).agg(F.expr(f"percentile({value}, 0.5)").alias("median"))
    values = [value] if isinstance(value, str) else value
    names = ["median"] if isinstance(value, str) else value

    def run(known: np.ndarray, *arrays: np.ndarray) -> dict[str, np.ndarray]:
        out = {}
        for name, a in zip(names, arrays, strict=True):
            filled = np.where(known, a.astype(float), np.nan)
            stack = np.sort(np.array([grids.shifted(filled, dy, dx, np.nan) for dy, dx in element]), axis=0)  # without a value last
            n = (~np.isnan(stack)).sum(axis=0)
            low, high = (np.take_along_axis(stack, np.maximum(k, 0)[None], axis=0)[0] for k in ((n - 1) // 2, n // 2))
            out[name] = low + (high - low) / 2
        return out

    reach = max(max(abs(dy), abs(dx)) for dy, dx in element)
    return by_tiles(field, values, reach, run, ", ".join(f"{n} double" for n in names))


#: Pixels of the images that a kernel gets at once.
TOGETHER = 1 << 18


def alike(pdf: pd.DataFrame, most: int = TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Image ids and rasters (n, height, width) of the packed images of a batch, those of one size together, at most so many pixels at once or one image."""
    for (h, w), own in pdf.groupby(["height", "width"], sort=False):
        step = max(1, most // max(1, h * w))
        for k in range(0, len(own), step):
            part = own.iloc[k : k + step]
            yield part["image_id"].to_numpy(), np.concatenate([np.asarray(v, dtype=float) for v in part["values"]]).reshape(len(part), h, w)


def on_images(packed: DataFrame, kernel: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """image_id, height, width, values: a numpy kernel (image_id, raster) over each packed image."""
    return on_alike(packed, lambda ids, stack: [kernel(i, image) for i, image in zip(ids, stack, strict=True)])


def on_alike(packed: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], Iterable[np.ndarray]]) -> DataFrame:
    """image_id, height, width, values: a numpy kernel (image ids, rasters) over packed images, many of one size at once; gives a raster for each."""
    prepare(packed.sparkSession)
    kind = dict(packed.dtypes)["image_id"]

    def run(batches):
        for pdf in batches:
            for ids, stack in alike(pdf):
                out = [(i, made.shape[0], made.shape[1], made.astype(float).ravel()) for i, made in zip(ids, kernel(ids, stack), strict=True)]
                yield pd.DataFrame(out, columns=["image_id", "height", "width", "values"])

    return packed.select("image_id", "height", "width", "values").mapInPandas(run, f"image_id {kind}, height int, width int, values array<double>")
