"""Sinks: score tables, forgery folders, rasters, raw label maps, matches and reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, folder: str, separator: str = ",") -> str:
    """Below a folder of this moment's name, and of a suffix that no other write has; its path."""
    stamp = rows.sparkSession.sql("SELECT date_format(current_timestamp(), 'yyyyMMdd-HHmmss')").first()[0]
    path = f"{folder}/{stamp}-{uuid.uuid4().hex[:8]}"
    rows.write.csv(path, header=True, sep=separator)
    return path


def write_samples(samples: DataFrame, folder: str) -> None:
    """Samples (modality, op, index, ...) as partitioned Parquet; beside them their annotations, a JSON document a line with modality, op and index."""
    samples.drop("annotation").write.partitionBy("modality", "op").mode("overwrite").parquet(f"{folder}/samples")
    if "annotation" in samples.columns:
        samples.select("modality", "op", "index", "annotation").write.mode("overwrite").json(f"{folder}/annotations")


def raw_label_files(packed: DataFrame) -> DataFrame:
    """image_id, content: little-endian 32-bit labels, row-major."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"image_id": pdf["image_id"], "content": [np.asarray(v, dtype="<i4").tobytes() for v in pdf["values"]]})

    return packed.select("image_id", "values").mapInPandas(run, f"image_id {dict(packed.dtypes)['image_id']}, content binary")


def write_matches(matches: DataFrame, path: str) -> None:
    matches.write.mode("overwrite").parquet(path)


def report_matrix(matrix: DataFrame, row: str, digits: int = 5) -> DataFrame:
    """A matrix with fixed decimals, for a tab-separated file."""
    return matrix.select(row, *[F.format_number(c, digits).alias(c) for c in matrix.columns if c != row])


def observed(rows: DataFrame, name: str):
    """The rows, and an observation of how many pass when they are written: a stage log without a second pass."""
    from pyspark.sql import Observation

    watch = Observation(name)
    return rows.observe(watch, F.count(F.lit(1)).alias("rows")), watch


def thumbnails(images: DataFrame, content: str = "content", name: str = "image_id", kind: str = "image/png") -> DataFrame:
    """name, html: an image element that holds the file's bytes."""
    return images.select(name, F.concat(F.lit(f'<img src="data:{kind};base64,'), F.base64(content), F.lit('">')).alias("html"))
