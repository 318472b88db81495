"""Quality rules with host-level verdicts.

Per-document counters come from one pass over the bytes. A document fails when any rule fails. Failures are
summed by host (partial sums before the shuffle, so a host with a third of all rows is one small row a
task), the hosts' failure rates are shrunk toward a beta prior that is fitted to all hosts by moments, and
the verdict of a host goes back to its documents:

* trusted (shrunk rate below `watch`): only the base rules drop a document;
* watched: a document that fails any rule goes too;
* rejected (shrunk rate less two posterior deviations at least `reject`): all documents go.

Nulls: a null text has no words (and so fails); a null host is a host of its own. Repeated rows count as
often as they stand. Long texts are read whole. An empty table gives an empty result. Other columns of the input are not looked at; keep()
returns them as they are, and reserves the names __host and __verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K
from palimpsest.llm.tables import join_sized
from palimpsest.session import durable, prepare

COUNTERS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
WINDOW = 5
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_HEAD = (np.arange(256) & 0xC0) != 0x80


def count_chunk(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counters of each text of a chunk."""
    n = len(offsets) - 1
    w = K.words(data, offsets)
    total = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    out = {"n_words": K.per_row(w.doc, n), "word_chars": total(_HEAD[data] & ~K.SPACE[data]), "n_symbols": total(_SYMBOL[data])}
    newline = np.zeros(256, dtype=bool)
    newline[10] = True
    start, end, row = K.word_spans(data, offsets, newline)
    ink = np.concatenate(([0], np.cumsum(~K.SPACE[data])))
    real = ink[end] > ink[start]
    start, end, row = start[real], end[real], row[real]
    out["n_lines"] = K.per_row(row, n)
    out["n_dup_lines"] = out["n_lines"] - K.per_row(K.distinct_in_row(K.span_hashes(data, start, end), row)[1], n)
    h, row, first = K.shingles(w, WINDOW)
    order = np.lexsort((h, row))
    same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    again = np.zeros(len(h), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    steps = np.zeros(len(w.hash) + 1, dtype=np.int64)
    np.add.at(steps, first[again], 1)
    np.add.at(steps, first[again] + WINDOW, -1)
    out["n_repeat_words"] = K.per_row(w.doc[np.cumsum(steps[:-1]) > 0], n)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [count_chunk(c.bytes, c.offsets) for c in K.chunks(batch.column(batch.num_columns - 1))]
        if parts:
            counted = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COUNTERS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counted], names=[*batch.schema.names[:-1], *COUNTERS])


def count_rules(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns and the counters, one row a document."""
    prepare(docs.sparkSession)
    kept = docs.select(*carry, F.col(text).alias("__text"))
    kinds = ", ".join([f"`{c}` {t}" for c, t in kept.dtypes[:-1]] + [f"{c} long" for c in COUNTERS])
    return kept.mapInArrow(_count, kinds)


def base_failed() -> F.Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def any_failed() -> F.Column:
    """Also: over a symbol in ten words, over three repeated lines in ten, mean word length outside 3 to 10."""
    return base_failed() | F.expr("10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 3 * n_words OR word_chars > 10 * n_words")


def host_verdicts(counted: DataFrame, host: str, watch: float = 0.02, reject: float = 0.5) -> DataFrame:
    """host, n, failed, rate (shrunk), verdict: one row a host."""
    hosts = counted.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr("cast(failed as long)")).alias("failed"))
    prior = hosts.agg(F.sum("n").alias("total"), F.sum("failed").alias("bad"), F.count(F.lit(1)).alias("hosts"), F.sum(F.expr("cast(failed as double) * failed / n")).alias("squares"))
    prior = prior.select(F.expr("(bad + 0.5D) / (total + 1)").alias("m"), F.expr("squares / total - (bad / total) * (bad / total)").alias("spread"), F.expr("hosts / total").alias("per"))
    prior = prior.select("m", F.expr("greatest(spread - m * (1 - m) * per, m * (1 - m) * 1e-4D)").alias("between"))
    prior = prior.select("m", F.expr("greatest(m * (1 - m) / between - 1, 1D)").alias("strength"))
    fitted = prior.first()  # two numbers, whatever the corpus
    m, strength = (0.5, 1.0) if fitted["m"] is None or fitted["strength"] is None else fitted
    shrunk = hosts.withColumns({"m": F.lit(float(m)), "strength": F.lit(float(strength))}).withColumn("rate", F.expr("(failed + m * strength) / (n + strength)"))
    shrunk = shrunk.withColumn("deviation", F.expr("sqrt(rate * (1 - rate) / (n + strength + 1))"))
    verdict = F.when(F.col("rate") - 2 * F.col("deviation") >= reject, "rejected").when(F.col("rate") < watch, "trusted").otherwise("watched")
    return shrunk.select("host", "n", "failed", "rate", verdict.alias("verdict"))


def judge(counted: DataFrame, host: str, watch: float = 0.02, reject: float = 0.5) -> DataFrame:
    """Adds base_failed, failed, host_rate, verdict and kept to counted documents."""
    marked = counted.withColumns({"base_failed": base_failed(), "failed": any_failed()})
    verdicts = host_verdicts(marked, host, watch, reject).select(F.col("host").alias("__host"), F.col("rate").alias("host_rate"), "verdict")
    joined = join_sized(marked, durable(verdicts, "hosts"), marked[host].eqNullSafe(F.col("__host")), "left")
    kept = ~F.col("base_failed") & (F.col("verdict") != "rejected") & ~((F.col("verdict") == "watched") & F.col("failed"))
    return joined.drop("__host").withColumn("kept", kept)


def host_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", watch: float = 0.02, reject: float = 0.5) -> DataFrame:
    """One row a document: key, host, the counters, base_failed, failed, host_rate, verdict, kept."""
    counted = durable(count_rules(docs.select(F.col(key).alias("__key"), F.col(host).alias("__source"), F.col(text)), ["__key", "__source"], text), "rules")
    return judge(counted, "__source", watch, reject).withColumnsRenamed({"__key": key, "__source": host})


def keep(docs: DataFrame, text: str = "text", host: str = "source", watch: float = 0.02, reject: float = 0.5) -> DataFrame:
    """The documents that host_rules() keeps, with their columns as they are.

    Counters and verdicts come first, from host and text alone; then each row's own counters meet its host's verdict.
    """
    counted = durable(count_rules(docs, [host], text), "rules").withColumns({"base_failed": base_failed(), "failed": any_failed()})
    verdicts = host_verdicts(counted, host, watch, reject).select(F.col("host").alias("__host"), "verdict")
    verdicts = durable(verdicts, "hosts").withColumnRenamed("verdict", "__verdict")
    joined = join_sized(docs, verdicts, docs[host].eqNullSafe(F.col("__host")), "left")
    at, last = joined.columns.index(text), joined.columns.index("__verdict")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [count_chunk(c.bytes, c.offsets) for c in K.chunks(batch.column(at))]
            if parts:
                n, repeats, symbols, same, lines, chars = (np.concatenate([p[x] for p in parts]) for x in ("n_words", "n_repeat_words", "n_symbols", "n_dup_lines", "n_lines", "word_chars"))
                base = (n < 10) | (100 * repeats > 20 * n)
                failed = base | (10 * symbols > n) | (10 * same > 3 * lines) | (chars < 3 * n) | (chars > 10 * n)
                verdict = batch.column(last).to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(~base & (verdict != "rejected") & ~((verdict == "watched") & failed)))

    return joined.mapInArrow(run, joined.schema).select(*docs.columns)
