"""Ground-truth scenes: snippets blended into images, degraded, and found again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.images import XY


def blend(alpha: Column, over: Column, under: Column) -> Column:
    """Alpha 0..255."""
    return F.floor((over * alpha + under * (255 - alpha)) / 255).cast("int")


def splice_layers(image: DataFrame, layers: DataFrame, opaque: int = 200) -> tuple[DataFrame, DataFrame]:
    """The image with all layers blended in order, and the visible owner of each pixel that an opaque layer covers.

    layers: (image_id, layer, y, x, g, alpha). The layers of a pixel fold in order within one aggregation.
    """
    stack = layers.groupBy(*XY).agg(F.array_sort(F.collect_list(F.struct("layer", "g", "alpha"))).alias("layers"))
    mixed = image.join(stack, XY, "left").withColumn("g", F.when(F.col("layers").isNull(), F.col("g")).otherwise(F.aggregate("layers", F.col("g"), lambda s, l: blend(l["alpha"], l["g"], s))))
    top = F.element_at(F.filter("layers", lambda l: l["alpha"] >= opaque), -1)["layer"]
    return mixed.select(*XY, "g"), stack.select(*XY, F.when(F.size(F.filter("layers", lambda l: l["alpha"] >= opaque)) > 0, top).alias("owner")).filter("owner IS NOT NULL")


def aligned(insert: Column, source: Column, factor: int) -> Column:
    """The insert position moved back until it agrees with the source's, modulo the factor."""
    return insert - F.pmod(insert - source, F.lit(factor))


def scaled_nearest(pixels: DataFrame, factor: int) -> DataFrame:
    """Each pixel as a factor x factor square."""
    grow = lambda c: F.explode(F.sequence(F.col(c) * factor, F.col(c) * factor + factor - 1))
    return pixels.withColumn("ny", grow("y")).withColumn("nx", grow("x")).select("image_id", F.col("ny").alias("y"), F.col("nx").alias("x"), "g")


def noisy(pixels: DataFrame, deviation: float, seed: int = 0) -> DataFrame:
    """Gaussian noise from two seeded uniforms a pixel."""
    u = lambda k: (F.pmod(F.xxhash64(*XY, F.lit(seed), F.lit(k)), F.lit(1 << 24)) + 1) / float((1 << 24) + 1)
    normal = F.sqrt(-2 * F.log(u(1))) * F.cos(u(2) * 6.283185307179586)
    return pixels.select(*XY, F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("g") + normal * deviation + 0.5))).cast("int").alias("g"))


def copied_pixels(image: DataFrame, forged: DataFrame, shift: DataFrame, levels: int = 6) -> DataFrame:
    """image_id, y, x, value: 255 where a forged pixel is within `levels` of the original one shift away, 128 where it only changed.

    shift: (image_id, dy, dx), from target to source.
    """
    changed = forged.withColumnRenamed("g", "f").join(image, XY).withColumn("changed", F.col("f") != F.col("g")).join(shift, "image_id")
    source = image.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), F.col("g").alias("s"))
    at = changed.withColumns({"sy": F.col("y") + F.col("dy"), "sx": F.col("x") + F.col("dx")}).join(source, ["image_id", "sy", "sx"], "left")
    value = F.when(F.col("changed") & (F.abs(F.col("f") - F.col("s")) < levels), 255).when(F.col("changed"), 128).otherwise(0)
    return at.select(*XY, value.alias("value")).filter("value > 0")


def random_blocks(images: DataFrame, height: int, width: int, size: int, most: int, seed: int = 0) -> DataFrame:
    """image_id, n, sy, sx, ty, tx: seeded square blocks with source and target corners, on one grid, each target once."""
    u = lambda k, m: F.pmod(F.xxhash64("image_id", "n", F.lit(seed), F.lit(k)), F.lit(m)).cast("int")
    count = 1 + F.pmod(F.xxhash64("image_id", F.lit(seed)), F.lit(most)).cast("int")
    rows = images.select("image_id", F.explode(F.sequence(F.lit(1), count)).alias("n"))
    rows = rows.select("image_id", "n", (u(1, height // size) * size).alias("sy"), (u(2, width // size) * size).alias("sx"), (u(3, height // size) * size).alias("ty"), (u(4, width // size) * size).alias("tx"))
    rows = rows.filter("sy <> ty OR sx <> tx")
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy("image_id", "ty", "tx").orderBy("n"))).filter("__r = 1").drop("__r")


def output_name(base: Column, rotation: Column, scale: Column, noise: Column) -> Column:
    """File name whose suffix encodes the parameters."""
    return F.concat(base, F.when(rotation != 0, F.concat(F.lit("_r"), rotation.cast("string"))).otherwise(""), F.when(scale != 100, F.concat(F.lit("_s"), scale.cast("string"))).otherwise(""), F.when(noise != 0, F.concat(F.lit("_gn"), noise.cast("string"))).otherwise(""), F.lit(".png"))


#: A transform (a, b, c, d, e, f): x to a x + b y + c, y to d x + e y + f.
IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


def step_matrix(degrees: Column, factor: Column, cy: Column, cx: Column) -> Column:
    """The transform of one logged step: a turn, clockwise as rows run down, and a scaling about a centre."""
    c, s = factor * F.cos(F.radians(degrees)), factor * F.sin(F.radians(degrees))
    return F.array(c, -s, cx - c * cx + s * cy, s, c, cy - s * cx - c * cy)


def after(p: Column, q: Column) -> Column:
    """The transform that applies p, then q."""
    row = lambda i: [q[i] * p[0] + q[i + 1] * p[3], q[i] * p[1] + q[i + 1] * p[4], q[i] * p[2] + q[i + 1] * p[5] + q[i + 2]]
    return F.array(*row(0), *row(3))


def inverted(m: Column) -> Column:
    """The transform back; null where there is none."""
    det = m[0] * m[4] - m[1] * m[3]
    d = F.when(F.abs(det) > 1e-12, det)
    a, b, e, f = m[4] / d, -m[1] / d, -m[3] / d, m[0] / d
    return F.when(d.isNotNull(), F.array(a, b, -(a * m[2] + b * m[5]), e, f, -(e * m[2] + f * m[5])))


def composed(log: DataFrame) -> DataFrame:
    """image_id, matrix, back: the transform that a log (image_id, step, degrees, factor, cy, cx) amounts to, steps in order, and its inverse. A log is one row of its image's steps."""
    own = step_matrix(F.col("degrees").cast("double"), F.col("factor").cast("double"), F.col("cy").cast("double"), F.col("cx").cast("double"))
    steps = log.select("image_id", F.struct("step", own.alias("m")).alias("s")).groupBy("image_id").agg(F.array_sort(F.collect_list("s")).alias("steps"))
    whole = F.aggregate("steps", F.array(*[F.lit(v) for v in IDENTITY]), lambda p, s: after(p, s["m"]))
    return steps.select("image_id", whole.alias("matrix")).withColumn("back", inverted(F.col("matrix")))


def replayed(pixels: DataFrame, matrices: DataFrame, height: int, width: int, forward: str = "matrix", value: str = "g") -> DataFrame:
    """image_id, y, x and the value of sparse pixels (an image, an alpha channel, a mask) under the transform in a column of `matrices`: every pixel of the frame takes its nearest source, if there is one.

    With the inverse for `forward`, what a target mask covers is told in the source's frame.
    """
    frame = matrices.select("image_id", inverted(F.col(forward)).alias("m")).filter("m IS NOT NULL")
    frame = frame.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    at = lambda i: F.rint(F.round(F.col("m")[i] * F.col("x") + F.col("m")[i + 1] * F.col("y") + F.col("m")[i + 2], 6)).cast("int")
    from_ = frame.select("image_id", "y", "x", at(3).alias("sy"), at(0).alias("sx"))
    source = pixels.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), value)
    return from_.join(source, ["image_id", "sy", "sx"]).select(*XY, value)


def carried(mask: DataFrame, source_log: DataFrame, target_log: DataFrame, height: int, width: int) -> DataFrame:
    """image_id, y, x: a mask in the frame that the target's log wrote, carried back by that log's inverse and on by the source's log."""
    back = replayed(mask.withColumn("g", F.lit(1)), composed(target_log), height, width, "back")
    return replayed(back, composed(source_log), height, width).select(*XY)
