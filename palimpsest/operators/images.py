"""The two tiers of images: exploded (image_id, y, x, ...) rows, and one packed row an image.

Masks and label maps are sparse: a pixel without a row is background.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XY = ["image_id", "y", "x"]


def explode_pixels(packed: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """image_id, y, x, v of row-major values."""
    rows = packed.select(F.col(key).alias("image_id"), F.posexplode(values).alias("pos", "v"))
    return rows.select("image_id", F.expr(f"pos div {width}").cast("int").alias("y"), (F.col("pos") % width).alias("x"), F.col("v").cast("double").alias("v"))


def pack_pixels(pixels: DataFrame, value: str) -> DataFrame:
    """image_id, height, width, values: row-major, 0 where a pixel has no row."""
    sized = pixels.groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.map_from_entries(F.collect_list(F.struct(F.struct("y", "x"), value))).alias("at"))
    cell = lambda i: F.coalesce(F.try_element_at("at", F.struct(F.floor(i / F.col("width")).cast("int").alias("y"), (i % F.col("width")).alias("x"))), F.lit(0))
    return sized.select("image_id", "height", "width", F.transform(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), cell).alias("values"))


def gray(v: Column) -> Column:
    """[-1, 1] to 0..255."""
    return F.floor((v + 1) * 127.5).cast("int")


def threshold(pixels: DataFrame, least: float, label: Column | None = None) -> DataFrame:
    """The label map of pixels above a value."""
    return pixels.filter(F.col("v") > least).select(*XY, (F.lit(1) if label is None else label).cast("int").alias("label"))


def raw_labels(files: DataFrame, width: int) -> DataFrame:
    """Label maps from raw little-endian 32-bit integers (path, content), values modulo 256.

    Bytes are taken apart in SQL: of each 4 bytes only the first survives the modulus.
    """
    byte = F.expr("conv(substring(hex(content), pos * 8 + 1, 2), 16, 10)").cast("int")
    cells = files.withColumn("pos", F.explode(F.sequence(F.lit(0), F.expr("length(content) div 4 - 1").cast("int"))))
    return cells.select(F.col("path").alias("image_id"), F.expr(f"pos div {width}").cast("int").alias("y"), (F.col("pos") % width).alias("x"), byte.alias("label")).filter("label <> 0")
