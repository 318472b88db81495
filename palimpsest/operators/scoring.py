"""Pixel scores of detection maps against ground truth, on sparse (image_id, y, x, label) rows.

Counting is one full join on the pixel and one aggregation an image; only component labelling needs
a neighbourhood and runs as an Arrow kernel over a stream of whole images.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import grids
from palimpsest.functions.arrays import quotient
from palimpsest.operators.images import XY
from palimpsest.session import durable, prepare


def merge_truth(before: DataFrame, after: DataFrame) -> DataFrame:
    """One ground truth from two: the label of `before` wins where it is set."""
    joined = before.withColumnRenamed("label", "b").join(after.withColumnRenamed("label", "a"), XY, "full")
    return joined.select(*XY, F.coalesce(F.expr("nullif(b, 0)"), "a").alias("label")).filter("label <> 0")


def confusion(detected: DataFrame, truth: DataFrame, images: DataFrame) -> DataFrame:
    """image_id, tp, fp, fn of the binarised maps; images without rows in either count 0."""
    d = detected.filter("label <> 0").select(*XY, F.lit(1).alias("d"))
    t = truth.filter("label <> 0").select(*XY, F.lit(1).alias("t"))
    counts = d.join(t, XY, "full").groupBy("image_id").agg(F.count_if(F.expr("d = 1 AND t = 1")).alias("tp"), F.count_if(F.expr("t IS NULL")).alias("fp"), F.count_if(F.expr("d IS NULL")).alias("fn"))
    return images.select("image_id").join(counts, "image_id", "left").fillna(0, ["tp", "fp", "fn"])


def f1() -> F.Column:
    """0 without a true positive."""
    return F.expr("CASE WHEN tp = 0 THEN 0.0D ELSE 2.0D * tp / (2 * tp + fp + fn) END")


def precision() -> F.Column:
    return F.expr("CASE WHEN tp = 0 THEN 0.0D ELSE cast(tp as double) / (tp + fp) END")


#: Rows that are labelled at once, and an image's rest.
TOGETHER = 100_000


def label_components(labels: DataFrame, eight: bool = False) -> DataFrame:
    """image_id, y, x, label, component: components of equal labels, 4-connected or 8-connected.

    A component is named by its least y * 2^20 + x. Rows are dealt by image and sorted, and whole images are labelled together as they stream by: a task holds TOGETHER rows and one image.
    """
    prepare(labels.sparkSession)
    neighbours = grids.EIGHT if eight else grids.FOUR

    def labelled(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        first = grids.label_points(pd.factorize(pdf["image_id"], use_na_sentinel=False)[0], pdf["label"].to_numpy(), y, x, neighbours)
        return pdf.assign(component=y[first].astype(np.int64) * (1 << 20) + x[first])

    def run(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n < TOGETHER or len(pdf) == 0:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = rows["image_id"].iloc[-1]
            open_ = (rows["image_id"].isna() if pd.isna(last) else rows["image_id"] == last).to_numpy()
            held, n = [rows[open_]], 0  # the last image may go on
            if not open_.all():
                yield labelled(rows[~open_])
        if held and sum(map(len, held)):
            yield labelled(pd.concat(held, ignore_index=True))

    kind = dict(labels.dtypes)["image_id"]
    dealt = labels.select("image_id", *[F.col(c).cast("int").alias(c) for c in ("y", "x", "label")]).repartition("image_id").sortWithinPartitions("image_id")
    return dealt.mapInPandas(run, f"image_id {kind}, y int, x int, label int, component long")


def consistent_pixels(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """Detected pixels on a truth label, of detected labels that touch two or more components of it."""
    parts = label_components(truth).withColumnRenamed("label", "g")
    touched = detected.filter("label <> 0").withColumnRenamed("label", "r").join(parts, XY)
    good = touched.groupBy("image_id", "g", "r").agg(F.countDistinct("component").alias("n")).filter("n >= 2")
    return touched.join(good.select("image_id", "g", "r"), ["image_id", "g", "r"], "left_semi")


def scores(detected: DataFrame, truth: DataFrame, images: DataFrame, check: bool = True) -> DataFrame:
    """image_id, f1, f1_check, precision, precision_check.

    The checked scores count only consistent pixels as true positives. Where truth is empty, or without the check, both are F1;
    they are 0 where nothing is detected and where the plain score is 0.
    """
    counts = confusion(detected, truth, images)
    plain = (durable(counts, "confusion") if check else counts).withColumns({"f1": f1(), "precision": precision()})  # the check reads them three times
    if not check:
        return plain.select("image_id", "f1", F.col("f1").alias("f1_check"), "precision", F.col("f1").alias("precision_check"))
    # labelling runs only for images that can have a checked score
    worth = plain.filter("tp > 0").select("image_id")
    good = consistent_pixels(detected.join(worth, "image_id", "left_semi"), truth.join(worth, "image_id", "left_semi"))
    good = good.select(*XY).distinct().groupBy("image_id").agg(F.count(F.lit(1)).alias("ctp"))
    joined = plain.join(good, "image_id", "left").fillna(0, ["ctp"])
    joined = joined.withColumns({"det": F.col("tp") + F.col("fp"), "gt": F.col("tp") + F.col("fn")})
    checked_f1 = F.expr("CASE WHEN gt = 0 THEN f1 WHEN f1 = 0 OR ctp = 0 THEN 0.0D ELSE 2.0D * ctp / (2 * ctp + (det - ctp) + (gt - ctp)) END")
    checked_p = F.expr("CASE WHEN gt = 0 THEN f1 WHEN precision = 0 OR ctp = 0 THEN 0.0D ELSE cast(ctp as double) / det END")
    return joined.select("image_id", "f1", checked_f1.alias("f1_check"), "precision", checked_p.alias("precision_check"))


def consistency(detected: DataFrame, truth: DataFrame) -> DataFrame:
    """image_id, any_pair (a detected and a truth label touch two components, or all there are), all_hit (every
    truth component is detected)."""
    parts = durable(label_components(truth), "parts").withColumnRenamed("label", "g")  # the pairs, their sizes and the hits read them
    sizes = parts.groupBy("image_id", "g").agg(F.countDistinct("component").alias("all_parts"))
    touched = detected.filter("label <> 0").withColumnRenamed("label", "r").join(parts, XY)
    pairs = touched.groupBy("image_id", "g", "r").agg(F.countDistinct("component").alias("n")).join(sizes, ["image_id", "g"])
    any_pair = pairs.groupBy("image_id").agg(F.bool_or(F.expr("n >= 2 OR n = all_parts")).alias("any_pair"))
    hit = touched.select("image_id", "g", "component").distinct().withColumn("hit", F.lit(True))
    every = parts.select("image_id", "g", "component").distinct().join(hit, ["image_id", "g", "component"], "left").groupBy("image_id").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all_hit"))
    return every.join(any_pair, "image_id", "left").select("image_id", F.coalesce("any_pair", F.lit(False)).alias("any_pair"), "all_hit")


#: Names of the pixel measures, in the order of reports (fixed values).
MEASURES = ("nposground", "nnegground", "nfp", "nfn", "ntp", "ntn", "nposdetected", "nnegdetected", "tpr", "tnr", "fpr", "fnr", "precision", "recall", "f1", "accuracy")


def pixel_measures(pixels: DataFrame) -> DataFrame:
    """The sixteen measures of each image, from (image_id, d, t) rows of all its pixels.

    Truth is positive at the image's brightest value only, a detection where it is not 0. Ratios are 0 where their denominator is.
    """
    top = pixels.groupBy("image_id").agg(F.max("t").alias("top"))
    marked = pixels.join(top, "image_id").select("image_id", (F.col("d") != 0).alias("d"), (F.col("t") > F.col("top") - 1).alias("t"))
    n = lambda d, t: F.count_if((F.col("d") == d) & (F.col("t") == t))
    c = marked.groupBy("image_id").agg(n(True, True).alias("ntp"), n(True, False).alias("nfp"), n(False, True).alias("nfn"), n(False, False).alias("ntn"))
    col = F.col
    c = c.withColumns({"nposground": col("ntp") + col("nfn"), "nnegground": col("nfp") + col("ntn"), "nposdetected": col("ntp") + col("nfp"), "nnegdetected": col("nfn") + col("ntn")})
    c = c.withColumns({"tpr": quotient(col("ntp"), col("nposground")), "tnr": quotient(col("ntn"), col("nnegground")), "fpr": quotient(col("nfp"), col("nnegground")), "fnr": quotient(col("nfn"), col("nposground")), "precision": quotient(col("ntp"), col("nposdetected"))})
    c = c.withColumns({"recall": col("tpr"), "accuracy": quotient(col("ntp") + col("ntn"), col("nposground") + col("nnegground")), "f1": quotient(2 * col("ntp"), 2 * col("ntp") + col("nfp") + col("nfn"))})
    return c.select("image_id", *[col(m).cast("double").alias(m) for m in MEASURES])


def chosen_measures(measured: DataFrame, wanted: list[str]) -> DataFrame:
    """image_id, measure, value; names that are no measure are left out."""
    known = [m for m in dict.fromkeys(wanted) if m in MEASURES]
    return measured.unpivot("image_id", known, "measure", "value") if known else measured.select("image_id", F.lit("").alias("measure"), F.lit(0.0).alias("value")).limit(0)


def resized_detection(pixels: DataFrame, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """Truth pixels at a detector's size: nearest sample."""
    ys = F.explode(F.filter(F.sequence(F.lit(0), F.lit(new_height - 1)), lambda i: F.floor(i * height / new_height) == F.col("y")))
    xs = F.explode(F.filter(F.sequence(F.lit(0), F.lit(new_width - 1)), lambda i: F.floor(i * width / new_width) == F.col("x")))
    rest = [c for c in pixels.columns if c not in ("y", "x")]
    return pixels.withColumn("ny", ys).withColumn("nx", xs).select(*rest, F.col("ny").alias("y"), F.col("nx").alias("x"))


def network_detection(pixels: DataFrame, red: str = "r", green: str = "g", above: int = 100) -> DataFrame:
    """Label 1 where a colour output is over the limit in red or green."""
    return pixels.filter((F.col(red) > above) | (F.col(green) > above)).select(*XY, F.lit(1).alias("label"))
