"""Queries over catalogues, similarity lists, tolerance joins, grids and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import paths
from palimpsest.operators import tabular as T
from palimpsest.plans.catalog import query
from palimpsest.session import table


@query(
    """WITH u AS (SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier)
SELECT printf('%06d', row_number() OVER (ORDER BY name, balance)) AS id, name, balance, segment FROM u"""
)
def catalogue_union_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One catalogue from several, missing columns null, with zero-padded numbers."""
    c = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return T.numbered_ids(T.stack_catalogues([c, s]), ["name", "balance"], 6).select("id", "name", "balance", "segment")


@query("SELECT p_partkey, p_type, p_size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08) AND p_partkey <> 7")
def contamination_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates without the rejected ones and without the query itself."""
    rejected = table(spark, sf_dir, "lineitem").filter("l_discount > 0.08").select(F.col("l_partkey").alias("p_partkey"))
    return T.without(table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size"), rejected, ["p_partkey"]).filter("p_partkey <> 7")


@query("SELECT p_partkey, p_name, l_orderkey, l_linenumber FROM part JOIN lineitem ON p_partkey = l_partkey WHERE contains(p_name, 'ring')")
def natural_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inner join on the shared key, after a substring filter."""
    parts = table(spark, sf_dir, "part").filter(F.col("p_name").contains("ring")).select(F.col("p_partkey").alias("key"), "p_name")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_orderkey", "l_linenumber")
    return parts.join(lines, "key").withColumnRenamed("key", "p_partkey")


@query(
    """WITH c AS (SELECT p_partkey, p_brand AS klass, CAST(p_size AS DOUBLE) / 10 AS ratio FROM part),
panels AS (SELECT s_suppkey AS panel, 'Brand#' || (1 + s_suppkey % 25) AS klass, CAST(s_suppkey % 50 AS DOUBLE) / 10 AS ratio_r FROM supplier)
SELECT panel, count(*) AS fits, min(p_partkey) AS first FROM c JOIN panels USING (klass) WHERE abs(ratio - ratio_r) <= CASE WHEN klass = 'Brand#11' THEN 2.0 ELSE 0.4 END GROUP BY panel"""
)
def ar_tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a panel's class whose aspect ratio is within the class's tolerance."""
    c = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("klass"), (F.col("p_size").cast("double") / 10).alias("ratio"))
    return T.tolerance_join(c, panels(spark, sf_dir), "klass", "ratio", {"Brand#11": 2.0}, 0.4).groupBy("panel").agg(F.count(F.lit(1)).alias("fits"), F.min("p_partkey").alias("first"))


def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.concat(F.lit("Brand#"), (1 + F.col("s_suppkey") % 25).cast("string"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("panel"), brand.alias("klass"), (F.col("s_suppkey") % 50).cast("double").__truediv__(10).alias("ratio"))


@query()
def greedy_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panels of each template take images in order; templates that stay open give nothing. Six suppliers in a row are a template, and all parts are dealt to the templates."""
    slots = panels(spark, sf_dir).select(F.expr("panel div 6").alias("template"), F.col("panel").alias("slot"), "klass", "ratio")
    last = slots.agg((F.max("template") + 1).alias("templates"))
    parts = table(spark, sf_dir, "part").crossJoin(F.broadcast(last))  # one row
    images = parts.select((F.col("p_partkey") % F.col("templates")).alias("template"), F.col("p_partkey").alias("image"), F.col("p_brand").alias("klass"), (F.col("p_size").cast("double") / 10).alias("ratio"))
    return T.greedy_fill(slots, images, {"Brand#11": 2.0}, 2.5)


_UNIT = "unit AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_PAIRS = """pairs AS (SELECT p.id AS a, q.id AS b, list_dot_product(p.v, q.v) / sqrt(list_dot_product(p.v, p.v) * list_dot_product(q.v, q.v)) AS score
  FROM unit p JOIN unit q ON p.id < q.id)"""


@query(f"WITH {_UNIT}, {_PAIRS} SELECT a, b, round(score, 6) AS score FROM pairs WHERE score >= 0.3")
def similarity_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors from a cosine on, as matrix products of blocks."""
    return T.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.3).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_UNIT}, {_PAIRS}, near AS (SELECT a, b, round(score, 6) AS score FROM pairs WHERE score >= 0.3),
both_ AS (SELECT a AS query, b AS candidate, score FROM near UNION ALL SELECT b, a, score FROM near),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS rank FROM both_)
SELECT query, candidate, score, rank FROM ranked WHERE rank <= 50"""
)
def similar_top50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most similar rows of each, best first, one row a candidate; here without padding."""
    vectors = table(spark, sf_dir, "embeddings")
    return T.padded_top(T.similar_first(vectors, "vec_id", "embedding", 0.3, 50, 6), vectors.limit(0), "vec_id", 50, 0).select("query", "candidate", "score", F.col("rank").cast("long").alias("rank"))


@query()
def similar_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short similarity lists, filled from a seeded sample at score 0."""
    vectors = table(spark, sf_dir, "embeddings")
    return T.padded_top(T.similar_first(vectors, "vec_id", "embedding", 0.3, 50, 6), vectors, "vec_id", 50, 100)


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by tag, most first."""
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c_mktsegment")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def best_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key by descending score."""
    return T.best_of(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")])


@query()
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R17 (a sampling operator): 100 customers by a seeded draw."""
    return T.draw(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 100, seed=7)


@query()
def random_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with another one of its segment."""
    return T.partners(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", seed=3)


@query(
    """SELECT p_partkey, CAST(p_partkey % 5 * 15 + a * 15 AS DOUBLE) AS angle, CAST(80 + s * 10 AS DOUBLE) AS scale
FROM part, range(4) AS r(a), range(3) AS t(s) WHERE a <= CASE WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN 0 ELSE p_partkey % 4 END AND s <= p_partkey % 3"""
)
def param_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of repaired ranges, which each part gives: some with a word for an end, some without a step."""
    low = "p_partkey % 5 * 15"
    ends = {
        "angle_low": low,
        "angle_high": f"CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE cast({low} + p_partkey % 4 * 15 AS string) END",
        "angle_step": "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE '15' END",
        "scale_low": "80",
        "scale_high": "80 + p_partkey % 3 * 10",
        "scale_step": "10",
    }
    rows = table(spark, sf_dir, "part").select("p_partkey", *[F.expr(f"cast({e} AS string)").alias(n) for n, e in ends.items()])
    return T.parameter_grid(rows, ["angle", "scale"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs whose output does not exist."""
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.unfinished(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query(
    """WITH t AS (SELECT o_orderkey, unnest(range(1, 11)) AS attempt, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)
SELECT o_orderkey, CAST(min(attempt) AS INT) AS attempt FROM t WHERE (p * attempt) % 13 < 3 GROUP BY o_orderkey"""
)
def retry_until_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of ten attempts that a rule accepts."""
    tries = table(spark, sf_dir, "orders").select("o_orderkey", F.floor("o_totalprice").alias("p"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("attempt"))
    return T.first_success(tries, ["o_orderkey"], (F.col("p") * F.col("attempt")) % 13 < 3, "attempt")


@query(
    """SELECT p_partkey, coalesce(sum(l_quantity), 0.0) AS quantity, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'first' WHEN p_brand LIKE 'Brand#2%' THEN 'second' ELSE 'none' END AS adapter
FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_tax > 0.07) ON p_partkey = l_partkey GROUP BY p_partkey, p_brand"""
)
def missing_as_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without output score 0; the adapter follows the name, unknown ones too."""
    sums = table(spark, sf_dir, "lineitem").filter("l_tax > 0.07").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("quantity"))
    adapter = F.when(F.col("p_brand").startswith("Brand#1"), "first").when(F.col("p_brand").startswith("Brand#2"), "second").otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand").join(sums, "p_partkey", "left").select("p_partkey", F.coalesce("quantity", F.lit(0.0)).alias("quantity"), adapter.alias("adapter"))


@query(
    """WITH RECURSIVE t AS (SELECT s_suppkey, s_name FROM supplier), h AS (
SELECT s_suppkey, s_name, 1 AS i, CAST(5381 AS BIGINT) AS d, CAST(0 AS BIGINT) AS s FROM t UNION ALL
SELECT s_suppkey, s_name, i + 1, (d * 33 + ord(s_name[i])) % 4294967296, (s * 65599 + ord(s_name[i])) % 4294967296 FROM h WHERE i <= length(s_name))
SELECT s_suppkey, d AS djb2, s AS sdbm FROM h WHERE i = length(s_name) + 1"""
)
def config_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.12: the two rolling string hashes."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", paths.rolling_hash(F.col("s_name"), 33, 5381).alias("djb2"), paths.rolling_hash(F.col("s_name"), 65599, 0).alias("sdbm"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 50 AS inside FROM events")
def nested_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1.1: values from nested documents."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), k.between(10, 50).alias("inside"))


@query(
    """SELECT n_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY n_name"""
)
def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.13: a star join and an aggregation."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    nations = t("nation").join(t("region").filter(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    customers = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "n_name")
    return lines.join(customers, "o_custkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))
