"""Score reports by modality and method."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import paths
from palimpsest.operators import scoring as S
from palimpsest.operators import tabular as T
from palimpsest.plans.catalog import query
from palimpsest.plans.scoring import _F1, _GROUPS, group_counts
from palimpsest.session import table

METHODS = ["de", "en", "es", "fr"]
_PIVOT = ", ".join(f"round(coalesce(max(CASE WHEN method = '{m}' THEN f1 END), 0), 9) AS {m}" for m in METHODS)
_SCORED = f"{_GROUPS}, s AS (SELECT modality, method, {_F1} AS f1 FROM c)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_counts(spark, sf_dir).select("modality", "method", S.f1().alias("f1"))


@query(f"WITH {_SCORED} SELECT modality, {_PIVOT} FROM s GROUP BY modality")
def score_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of each method by modality, one column a method."""
    matrix = T.mean_matrix(_scored(spark, sf_dir), "modality", "method", METHODS, "f1")
    return matrix.select("modality", *[F.round(F.coalesce(m, F.lit(0.0)), 9).alias(m) for m in METHODS])


@query(f"WITH {_SCORED}, means AS (SELECT modality, avg(f1) AS f FROM s GROUP BY modality) SELECT round(avg(round(f * 100, 2)), 6) AS rounded_first, round(avg(f * 100), 6) AS rounded_last FROM means")
def macro_average_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro averages of means rounded before, and only after."""
    means = _scored(spark, sf_dir).groupBy("modality").agg(F.avg("f1").alias("m"))
    return means.agg(F.round(F.avg(F.round(F.col("m") * 100, 2)), 6).alias("rounded_first"), F.round(F.avg(F.col("m") * 100), 6).alias("rounded_last"))


@query(f"WITH {_SCORED}, b AS (SELECT *, max(f1) OVER (PARTITION BY modality) AS best FROM s) SELECT modality, method, round(f1, 9) AS f1 FROM b WHERE f1 = best")
def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best method of each modality, ties all."""
    scored = _scored(spark, sf_dir)
    best = scored.groupBy("modality").agg(F.max("f1").alias("best"))
    return scored.join(best, "modality").filter("f1 = best").select("modality", "method", F.round("f1", 9).alias("f1"))


@query(f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY f1 DESC, modality) AS n FROM s) SELECT method, modality, round(f1, 9) AS f1 FROM r WHERE n = 2")
def second_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second-best modality of each method."""
    return T.kth(_scored(spark, sf_dir), ["method"], [F.desc("f1"), F.col("modality")], 2).select("method", "modality", F.round("f1", 9).alias("f1"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def worst_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 by value, as a bounded heap in each task."""
    return table(spark, sf_dir, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    f"""WITH {_SCORED}, p AS (SELECT modality, {", ".join(f"round(coalesce(max(CASE WHEN method = '{m}' THEN f1 END), 0) * 100, 2) AS {m}" for m in METHODS)} FROM s GROUP BY modality),
g AS (SELECT *, greatest(de, en, es, fr) AS top FROM p)
SELECT modality, modality || {" || ".join(f"' & ' || CASE WHEN {m} = top THEN '\\textbf{{' || printf('%.2f', {m}) || '}}' ELSE printf('%.2f', {m}) END" for m in METHODS)} || ' \\\\' AS line FROM g"""
)
def latex_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: report lines with the best method bold."""
    return T.bold_best(T.mean_matrix(_scored(spark, sf_dir), "modality", "method", METHODS, "f1"), "modality", METHODS)


@query(f"WITH {_SCORED}, t AS (SELECT DISTINCT modality FROM s) SELECT modality, coalesce(modality, 'all') AS shown, 0 AS level, round(avg(f1), 9) AS f1 FROM s GROUP BY modality UNION ALL SELECT NULL, 'all', 1, round(avg(f1), 9) FROM s")
def score_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extra: means by modality and over all."""
    rolled = _scored(spark, sf_dir).rollup("modality").agg(F.grouping_id().cast("int").alias("level"), F.round(F.avg("f1"), 9).alias("f1"))
    return rolled.select("modality", F.coalesce("modality", F.lit("all")).alias("shown"), "level", "f1")


@query(
    """SELECT l_orderkey, l_linenumber, m.method, round(m.value, 9) AS value FROM lineitem,
(SELECT unnest(['quantity', 'discount', 'tax']) AS method) k, LATERAL (SELECT k.method, CASE k.method WHEN 'quantity' THEN l_quantity WHEN 'discount' THEN l_discount ELSE l_tax END AS value) m"""
)
def wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a method from one column a method."""
    wide = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return wide.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "method", "value").withColumn("value", F.round("value", 9))


@query(
    """WITH p AS (SELECT page_id, 'output/' || string_split(regexp_replace(url, '^https?://', ''), '/')[1] || '/' || page_id || '/map.png' AS path FROM pages)
SELECT page_id, path, array_to_string(string_split(path, '/')[2:len(string_split(path, '/')) - 2], '/') AS modality, 'map.png' AS name, 'map' AS stem, contains(path, 'blog') AS chosen FROM p"""
)
def path_modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modality of a path, its file name and stem, and a choice by substring."""
    host = F.split(F.regexp_replace("url", "^https?://", ""), "/")[0]
    path = F.concat(F.lit("output/"), host, F.lit("/"), F.col("page_id").cast("string"), F.lit("/map.png"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return rows.select("page_id", "path", paths.modality(F.col("path")).alias("modality"), paths.base_name(F.col("path")).alias("name"), paths.stem(F.col("path")).alias("stem"), F.col("path").contains("blog").alias("chosen"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE 'other' END AS shown, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'F')")
def renamed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a tag of a set, labels renamed by a map."""
    names = F.create_map(*[F.lit(x) for x in ("1-URGENT", "urgent", "2-HIGH", "high")])
    rows = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "F"))
    return rows.select("o_orderkey", F.coalesce(F.try_element_at(names, F.col("o_orderpriority")), F.lit("other")).alias("shown"), "o_orderstatus")
