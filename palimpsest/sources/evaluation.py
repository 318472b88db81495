"""From folders of maps to score tables: how each kind of detector writes its maps, and what a missing or broken file counts for."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.paths import stem
from palimpsest.operators import scoring as S
from palimpsest.session import prepare
from palimpsest.sources.readers import read_images

#: Labels of a map by how it is written: a raster of rows, columns and bands to whole numbers, 0 for the background.
ADAPTERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "mask": lambda a: (a > 0).any(axis=2).astype(int),
    "labels": lambda a: a[:, :, 0].astype(int),
    "network": lambda a: ((a[:, :, 0] > 100) | (a[:, :, 1] > 100)).astype(int),
    "marked": lambda a: (a.max(axis=2) != a.min(axis=2)).astype(int),
}


def label_maps(spark: SparkSession, folder: str, written: str, pattern: str = "*.png") -> tuple[DataFrame, DataFrame]:
    """The maps' pixels (image_id, y, x, label), and their files (image_id, path, readable). image_id is the file's stem; an unreadable file has no pixels."""
    if written not in ADAPTERS:
        raise ValueError(f"{written}: one of {', '.join(sorted(ADAPTERS))}")
    prepare(spark)
    make = ADAPTERS[written]
    images = read_images(spark, folder, pattern).withColumn("image_id", stem(F.col("path")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                labels = make(np.asarray(row.values).reshape(row.height, row.width, row.bands))
                y, x = np.nonzero(labels)
                yield pd.DataFrame({"image_id": row.image_id, "y": y.astype(np.int32), "x": x.astype(np.int32), "label": labels[y, x].astype(np.int32)})

    readable = images.filter("values IS NOT NULL" + (" AND bands >= 2" if written == "network" else ""))
    pixels = readable.select("image_id", "height", "width", "bands", "values").mapInPandas(run, "image_id string, y int, x int, label int")
    files = images.select("image_id", "path", (F.col("values").isNotNull() & ((F.col("bands") >= 2) | F.lit(written != "network"))).alias("readable"))
    return pixels, files


def score_folders(spark: SparkSession, detected: str, truth: str, written: str = "mask", pattern: str = "*.png", check: bool = True) -> DataFrame:
    """image_id, f1, f1_check, precision, precision_check, found, readable: one row for each truth map.

    A truth map without a detection, or with one that cannot be read, is scored against an empty map and marked so; detections without truth are left out.
    """
    want, images = label_maps(spark, truth, "labels", pattern)
    got, files = label_maps(spark, detected, written, pattern)
    scored = S.scores(got, want, images.select("image_id").distinct(), check)
    seen = files.groupBy("image_id").agg(F.bool_or("readable").alias("readable"))
    scored = scored.join(seen.withColumn("found", F.lit(True)), "image_id", "left")
    return scored.fillna(False, ["found", "readable"])
