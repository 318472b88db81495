"""Queries over pixel scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import scoring as S
from palimpsest.plans import maps
from palimpsest.plans.catalog import query
from palimpsest.plans.maps import COMP, DET, GT, IMAGES, PX
from palimpsest.session import table

_COUNTS = """counts AS (
  SELECT i.image_id, count(*) FILTER (WHERE d.label IS NOT NULL AND g.label IS NOT NULL) AS tp,
         count(*) FILTER (WHERE d.label IS NOT NULL AND g.label IS NULL) AS fp,
         count(*) FILTER (WHERE d.label IS NULL AND g.label IS NOT NULL) AS fn
  FROM images i JOIN px p USING (image_id) LEFT JOIN det d ON d.image_id = p.image_id AND d.y = p.y AND d.x = p.x
  LEFT JOIN gt g ON g.image_id = p.image_id AND g.y = p.y AND g.x = p.x GROUP BY i.image_id)"""
_F1 = "CASE WHEN tp = 0 THEN 0.0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END"
_P = "CASE WHEN tp = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fp) END"


@query(f"WITH {PX}, {GT}, {DET}, {IMAGES}, {_COUNTS} SELECT image_id, tp, fp, fn, round({_F1}, 9) AS f1, round({_P}, 9) AS precision FROM counts")
def pixel_f1_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain scores, 0 without a true positive and for images without output."""
    counts = S.confusion(maps.detection(spark, sf_dir), maps.truth(spark, sf_dir), maps.image_list(spark, sf_dir))
    return counts.select("image_id", "tp", "fp", "fn", F.round(S.f1(), 9).alias("f1"), F.round(S.precision(), 9).alias("precision"))


@query(f"WITH RECURSIVE {PX}, {GT}, {COMP} SELECT image_id, y, x, c AS component FROM comp")
def components_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-connected components of a label map."""
    return S.label_components(maps.truth(spark, sf_dir)).drop("label")


@query(
    f"""WITH RECURSIVE {PX}, {GT}, {DET}, {IMAGES}, {COMP}, {_COUNTS},
touched AS (SELECT d.image_id, d.y, d.x, d.label AS r, c FROM det d JOIN comp USING (image_id, y, x)),
good AS (SELECT image_id, r FROM touched GROUP BY image_id, r HAVING count(DISTINCT c) >= 2),
ctps AS (SELECT image_id, count(*) AS ctp FROM touched JOIN good USING (image_id, r) GROUP BY image_id),
full_ AS (SELECT c.*, coalesce(ctp, 0) AS ctp, tp + fp AS d, tp + fn AS g, {_F1} AS f, {_P} AS p FROM counts c LEFT JOIN ctps USING (image_id))
SELECT image_id, round(f, 9) AS f1,
  round(CASE WHEN g = 0 THEN f WHEN f = 0 OR ctp = 0 THEN 0.0 ELSE 2.0::DOUBLE * ctp / (2 * ctp + (d - ctp) + (g - ctp)) END, 9) AS f1_check,
  round(p, 9) AS precision,
  round(CASE WHEN g = 0 THEN f WHEN p = 0 OR ctp = 0 THEN 0.0 ELSE ctp::DOUBLE / d END, 9) AS precision_check FROM full_"""
)
def ctp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that count only consistent regions."""
    found = S.scores(maps.detection(spark, sf_dir), maps.truth(spark, sf_dir), maps.image_list(spark, sf_dir))
    return found.select("image_id", *[F.round(c, 9).alias(c) for c in ("f1", "f1_check", "precision", "precision_check")])


@query(
    f"""WITH RECURSIVE {PX}, {GT}, {DET}, {COMP},
parts AS (SELECT image_id, count(DISTINCT c) AS n FROM comp GROUP BY image_id),
touched AS (SELECT d.image_id, d.label AS r, c FROM det d JOIN comp USING (image_id, y, x)),
pairs AS (SELECT image_id, r, count(DISTINCT c) AS k FROM touched GROUP BY image_id, r),
flags AS (SELECT image_id, bool_or(k >= 2 OR k = n) AS any_pair FROM pairs JOIN parts USING (image_id) GROUP BY image_id),
hits AS (SELECT image_id, count(DISTINCT c) AS k FROM touched GROUP BY image_id)
SELECT image_id, coalesce(any_pair, FALSE) AS any_pair, coalesce(k, 0) = n AS all_hit
FROM parts LEFT JOIN flags USING (image_id) LEFT JOIN hits USING (image_id)"""
)
def consistency_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7 M8 M9: whether a detection is consistent with the truth's components, and hits them all."""
    return S.consistency(maps.detection(spark, sf_dir), maps.truth(spark, sf_dir))


_RATIO = lambda a, b: f"round(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END, 9)"


@query(
    f"""WITH {PX}, top AS (SELECT image_id, max(g) AS top FROM px GROUP BY image_id),
marked AS (SELECT image_id, v > 0.10 AS d, g > top - 1 AS t FROM px JOIN top USING (image_id)),
c AS (SELECT image_id, count(*) FILTER (WHERE d AND t)::DOUBLE AS ntp, count(*) FILTER (WHERE d AND NOT t)::DOUBLE AS nfp,
      count(*) FILTER (WHERE NOT d AND t)::DOUBLE AS nfn, count(*) FILTER (WHERE NOT d AND NOT t)::DOUBLE AS ntn FROM marked GROUP BY image_id)
SELECT image_id, ntp, nfp, nfn, ntn, ntp + nfn AS nposground, nfp + ntn AS nnegground, ntp + nfp AS nposdetected, nfn + ntn AS nnegdetected,
  {_RATIO("ntp", "ntp + nfn")} AS tpr, {_RATIO("ntn", "nfp + ntn")} AS tnr, {_RATIO("nfp", "nfp + ntn")} AS fpr, {_RATIO("nfn", "ntp + nfn")} AS fnr,
  {_RATIO("ntp", "ntp + nfp")} AS precision, {_RATIO("ntp", "ntp + nfn")} AS recall, {_RATIO("2 * ntp", "2 * ntp + nfp + nfn")} AS f1,
  {_RATIO("ntp + ntn", "ntp + nfp + nfn + ntn")} AS accuracy FROM c"""
)
def pixel_confusion_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen pixel measures."""
    rows = maps.pixels(spark, sf_dir).select("image_id", (F.col("v") > 0.10).cast("int").alias("d"), F.col("g").alias("t"))
    return S.pixel_measures(rows).select("image_id", *[F.round(m, 9).alias(m) for m in S.MEASURES])


@query(
    f"""WITH {PX}, top AS (SELECT image_id, max(g) AS top FROM px GROUP BY image_id),
c AS (SELECT image_id, count(*) FILTER (WHERE v > 0.10 AND g > top - 1)::DOUBLE AS ntp, count(*) FILTER (WHERE g > top - 1)::DOUBLE AS pos FROM px JOIN top USING (image_id) GROUP BY image_id)
SELECT image_id, 'recall' AS measure, round(ntp / pos, 9) AS value FROM c UNION ALL SELECT image_id, 'ntp', ntp FROM c"""
)
def measure_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen measures as rows; a name that is no measure is left out."""
    rows = maps.pixels(spark, sf_dir).select("image_id", (F.col("v") > 0.10).cast("int").alias("d"), F.col("g").alias("t"))
    return S.chosen_measures(S.pixel_measures(rows), ["recall", "sharpness", "ntp"]).withColumn("value", F.round("value", 9))


@query(
    f"""WITH {PX}, m AS (SELECT image_id, y, x, 2 AS label, 0 AS k FROM px WHERE v > 0.2 UNION ALL SELECT image_id, y, x, 1, 1 FROM px WHERE v > 0.1 AND x < 5)
SELECT image_id, y, x, arg_min(label, k) AS label FROM m GROUP BY image_id, y, x"""
)
def truth_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ground truths as one, the first one's labels over the second's."""
    px = maps.pixels(spark, sf_dir)
    before = px.filter("v > 0.05").select("image_id", "y", "x", F.when(F.col("v") > 0.2, 2).otherwise(0).alias("label"))
    return S.merge_truth(before, px.filter("v > 0.1 AND x < 5").select("image_id", "y", "x", F.lit(1).alias("label")))


@query(
    f"""WITH {PX}, gt AS (SELECT image_id, ny AS y, nx AS x, 1 AS label FROM px, (SELECT unnest(range(16)) AS ny), (SELECT unnest(range(16)) AS nx) WHERE v > 0.15 AND ny // 2 = y AND nx // 2 = x),
det AS (SELECT image_id, ny AS y, nx AS x FROM px, (SELECT unnest(range(16)) AS ny), (SELECT unnest(range(16)) AS nx) WHERE ny // 2 = y AND nx // 2 = x AND (g + ny > 150 OR g - nx > 150)),
c AS (SELECT e.vec_id AS image_id, (SELECT count(*) FROM gt JOIN det USING (image_id, y, x) WHERE image_id = e.vec_id) AS tp,
  (SELECT count(*) FROM gt WHERE image_id = e.vec_id) AS g, (SELECT count(*) FROM det WHERE image_id = e.vec_id) AS d FROM embeddings e)
SELECT image_id, tp, d - tp AS fp, g - tp AS fn FROM c"""
)
def network_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-colour detection over a limit, the truth resized to its size."""
    px = maps.pixels(spark, sf_dir)
    large = S.resized_detection(px, 8, 8, 16, 16).withColumns({"red": F.col("g") + F.col("y"), "green": F.col("g") - F.col("x")})
    found = S.network_detection(large, "red", "green", 150)
    gt = S.resized_detection(maps.truth(spark, sf_dir), 8, 8, 16, 16)
    return S.confusion(found, gt, maps.image_list(spark, sf_dir))


_GROUPS = """m AS (SELECT source AS modality, lang AS method, toxic AS d, quality AS t FROM labels JOIN documents USING (doc_id)),
c AS (SELECT modality, method, count(*) FILTER (WHERE d = 1 AND t = 1) AS tp, count(*) FILTER (WHERE d = 1 AND t = 0) AS fp, count(*) FILTER (WHERE d = 0 AND t = 1) AS fn FROM m GROUP BY modality, method)"""


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    n = lambda d, t: F.count_if((F.col("toxic") == d) & (F.col("quality") == t))
    return joined.groupBy(F.col("source").alias("modality"), F.col("lang").alias("method")).agg(n(1, 1).alias("tp"), n(1, 0).alias("fp"), n(0, 1).alias("fn"))


@query(f"WITH {_GROUPS} SELECT modality, method, round({_F1}, 9) AS f1 FROM c")
def score_f1_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 by modality and method."""
    return group_counts(spark, sf_dir).select("modality", "method", F.round(S.f1(), 9).alias("f1"))


@query(f"WITH {_GROUPS} SELECT modality, method, round({_P}, 9) AS precision FROM c")
def score_precision_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: precision by modality and method."""
    return group_counts(spark, sf_dir).select("modality", "method", F.round(S.precision(), 9).alias("precision"))
