"""A corpus pipeline: quality rules, near duplicates, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns what it kept; the caller writes a stage's rows and gives them to the next
as docs. All stages but the last return the columns of documents, as they came, whatever else they are called (names that begin with __ are reserved).
Empty tables give empty ones. Each stage's docstring says what becomes of nulls, empty texts and repeated rows; long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import byte_bpe, decontam, host_rules, ngram_join, pii
from palimpsest.llm.queries import BYTE_RANKS, pre_tokens, tokenizer
from palimpsest.llm.tables import join_sized
from palimpsest.session import discard, durable, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go.

    The counters are made with the row's columns beside them, so no join by doc_id is needed and repeated ids keep their own verdicts.
    """
    return host_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the least doc_id stays; five-word shingles, Jaccard from 0.8 on.

    Documents without words link with nothing and stay. Where a doc_id repeats or lacks, rows are told apart by a number, and of each
    component the row of the least doc_id (then of the least number) stays, so repeated rows with words leave one.
    """
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count():
        rows = durable(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        joined = ngram_join.jaccard_components(rows, key="__row", words=5, percent=80)
        joined = joined.join(rows.select("__row", F.col("doc_id").alias("__id")).hint("merge"), "__row")
        keep = joined.groupBy("component_id").agg(F.min_by("__row", F.struct(F.col("__id").isNull(), "__id", "__row")).alias("__keep")).select("__keep")
        return join_sized(rows, durable(keep, "keep"), F.col("__row") == F.col("__keep"), "left_semi").drop("__row")
    joined = ngram_join.jaccard_components(docs, words=5, percent=80)
    keep = durable(joined.filter("doc_id = component_id").select(F.col("doc_id").alias("__keep")), "keep")
    return join_sized(docs, keep, F.col("doc_id") == F.col("__keep"), "left_semi")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go. Null and empty texts contain none and stay, repeated rows are judged each."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), words=5, threshold=0.8)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; n_chars follows the text. A null text stays null, with null characters; repeated rows are masked alike."""
    return pii.mask_pii(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to: one row a document. A null text is empty and has no ids."""
    return byte_bpe.digest(docs, tokenizer(BYTE_RANKS), pre_tokens(), spaced=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mask_personal_data", mask_personal_data),
    ("token_ids", token_ids),
]

#: Similarity components and token ids are beyond SQL; tests check each stage on planted cases and each operator by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written to the shared folder and read again; what a stage read or made on the way is deleted then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch():
            made = stage(spark, docs, sf_dir)
            out = durable(made, f"pipeline-{name}", kept=True)
        if before is not None:
            discard(before)
        docs = before = out
    return docs
