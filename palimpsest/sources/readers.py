"""Sources: catalogues, file listings, options, templates, rasters, saved matches and the splice catalogue. Schemas are declared, never inferred."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.session import prepare

CATALOGUE = T.StructType([T.StructField(n, T.StringType()) for n in ("class", "DatasetRef", "License", "Link", "ObjectMaskPath", "RealDataPath", "subset_tag", "dataGTPath", "dataPath")] + [T.StructField("AR", T.DoubleType())])
SCORES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("F1", "F1-Check", "Precision", "Precision-Check")] + [T.StructField(n, T.StringType()) for n in ("Method", "Detection-Map")])
MATCHES = "image_id long, plane int, y int, x int, my int, mx int, distance double"


def read_csv(spark: SparkSession, path: str, schema: T.StructType, index: bool = False) -> DataFrame:
    """A table with a header; `index`: its first column is a row number and is dropped."""
    whole = T.StructType([T.StructField("__index", T.StringType()), *schema.fields]) if index else schema
    out = spark.read.schema(whole).csv(path, header=True, enforceSchema=True)
    return out.drop("__index") if index else out


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """path, length of the files below a folder whose name fits; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def read_options(spark: SparkSession, path: str) -> DataFrame:
    """group, name, value of `key = value` lines; keys are group.name, # starts a comment, the last of equal keys holds."""
    lines = spark.read.text(path, wholetext=False).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line"), F.monotonically_increasing_id().alias("n"))
    pairs = lines.filter(F.col("line").contains("=")).select(F.trim(F.substring_index("line", "=", 1)).alias("key"), F.trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("value"), "n")
    last = pairs.groupBy("key").agg(F.max_by("value", "n").alias("value"))
    return last.select(F.when(F.col("key").contains("."), F.substring_index("key", ".", 1)).alias("group"), F.substring_index("key", ".", -1).alias("name"), "value")


def with_overrides(options: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Options by name, those given on the command line before those of the file."""
    if not overrides:
        return options
    given = options.sparkSession.createDataFrame(list(overrides.items()), "name string, given string")
    joined = options.join(F.broadcast(given), "name", "full")
    return joined.select("group", "name", F.coalesce("given", "value").alias("value"))


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """Saved matches, so that verification can run later."""
    return spark.read.schema(MATCHES).parquet(path)


def decode_png(data: bytes) -> np.ndarray:
    """8- or 16-bit gray, gray-alpha, RGB, RGBA or palette PNG, not interlaced, as (h, w, bands)."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, palette = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += size + 12
    if interlaced or depth not in (8, 16):
        raise ValueError("unsupported PNG")
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    step = bands * depth // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), dtype=np.uint8)
    for y in range(height):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y - 1].astype(np.int64) if y else np.zeros(width * step, np.int64)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        elif kind == 1:
            out[y] = (np.cumsum(line.reshape(width, step), axis=0) & 255).ravel()
        else:
            done = np.zeros(width * step, np.int64)
            for x in range(width * step):
                left, corner = (done[x - step], up[x - step]) if x >= step else (0, 0)
                if kind == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up[x]), 1, up[x]), (abs(p - corner), 2, corner))[2]
                done[x] = (line[x] + guess) & 255
            out[y] = done
    pixels = out.reshape(height, width, bands) if depth == 8 else out.reshape(height, width, bands, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    return palette[pixels[:, :, 0]] if palette is not None and colour == 3 else pixels


def encode_png(image: np.ndarray) -> bytes:
    image = image if image.ndim == 3 else image[:, :, None]
    h, w, bands = image.shape
    wide = image.dtype == np.uint16
    rows = image.astype(">u2" if wide else np.uint8).tobytes()
    stride = len(rows) // max(h, 1)
    body = zlib.compress(b"".join(b"\0" + rows[y * stride : (y + 1) * stride] for y in range(h)))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 16 if wide else 8, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", body) + part(b"IEND", b"")


def read_images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """path, height, width, bands, values: decoded rasters, one packed row a file. A file that cannot be read gives null values."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    image = decode_png(bytes(data))
                    out.append((path, *image.shape, image.ravel().astype(float).tolist()))
                except (ValueError, KeyError, zlib.error, struct.error):
                    out.append((path, 0, 0, 0, None))
            yield pd.DataFrame(out, columns=["path", "height", "width", "bands", "values"])

    return files.mapInPandas(run, "path string, height int, width int, bands int, values array<double>")


def masks_or_zeros(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Each image's mask; zeros of the image's size where it has none."""
    m = masks.select("image_id", F.col("values").alias("mask"))
    return images.join(m, "image_id", "left").withColumn("mask", F.coalesce("mask", F.transform(F.sequence(F.lit(1), F.col("height") * F.col("width")), lambda _: F.lit(0.0))))


def splice_catalogue(spark: SparkSession, entries: dict[str, dict]) -> DataFrame:
    """name, path, prefix, opaque, l2, snippet, ty, tx, sy, sx: one row a snippet, its insert and source corners from comma lists."""
    rows = [(name, e["path"], e["prefix"], int(e["opaque"]), bool(e["l2dist"]), e["insert_positions"], e["source_positions"]) for name, e in entries.items()]
    table = spark.createDataFrame(rows, "name string, path string, prefix string, opaque int, l2 boolean, t string, s string")
    ints = lambda c: F.transform(F.split(c, ","), lambda v: F.trim(v).cast("int"))
    table = table.withColumn("t", ints("t")).withColumn("s", ints("s"))
    table = table.withColumn("snippet", F.explode(F.sequence(F.lit(0), F.expr("cast(size(t) / 2 as int) - 1"))))
    at = lambda a, k: F.element_at(a, F.col("snippet") * 2 + k).alias
    return table.select("name", "path", "prefix", "opaque", "l2", "snippet", at("t", 2)("ty"), at("t", 1)("tx"), at("s", 2)("sy"), at("s", 1)("sx"))
