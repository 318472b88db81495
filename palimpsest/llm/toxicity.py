"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Learning uses labelled documents alone, about `most_labelled` of them and `most_bytes` of their texts at most, those whose keys' hash
is lowest (documented bounds; the rest of the operator covers every row). A lexicon feature stands in several of these documents, so
its size is bounded by theirs: under `most_bytes` / 3 entries. Words are letters and digits with A-Z in lower case.

1. A word's features are itself and its beginnings of 4 to 8 bytes, which stand for words that are built from one
   stem. Features that toxic and clean documents hold unequally, by a likelihood ratio of `min_z` standard normal
   units, form the lexicon. A word counts for its most significant feature, all words without one for a class of
   their own, and the scores are the log-odds of these classes' token counts under an informative Dirichlet
   prior: `prior_words` pseudo-tokens spread as the tokens of both classes together. As log-likelihood ratios they sum to less than 0 on clean text, and the extreme-value decay is 1.
2. Each document's maximal scoring segments, all of them, by one left-to-right scan (Ruzzo and Tompa). A
   segment of score S in n words has the E-value K n exp(-S); K is fitted on the clean labelled documents.
3. Per document, the best segment's S - ln(K n) and the summed excess of the significant segments, mapped to a probability by a
   logistic fit on the labelled documents.

A document without words, null and empty texts included, has no segment and gets the probability of such documents. Long texts are
scanned whole. Repeated rows are scored each, and counted as often as they stand if labelled; repeated labels of a key count as toxic if any is. Null keys and
null labels teach nothing. Of a word's features of equal significance the first in the order of `features_of` counts. Without labels of both
classes every score is the share of toxic labels (0 without labels). An empty table gives an empty result; other columns are not looked at.

The features, `min_z` and `prior_words` were chosen by four folds inside the rows whose labels may be learned (`without`), never by held-out ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K
from palimpsest.llm.tables import join_sized
from palimpsest.session import discard, durable, prepare

#: Counts that a task adds up before it passes them on: some 20 MB with the copies that sorting makes.
HELD = 200_000
#: Text whose features are made at once.
COUNTED_BYTES = 1 << 18
STEMS = (4, 5, 6, 7, 8)
STEM_MARK = np.uint64(0x6A09E667F3BCC909)


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes
    significance: np.ndarray  # |z|
    scores: np.ndarray
    other: float
    log_k: float
    weights: tuple[float, float, float]
    significant: float  # E-value


def words_of(data: np.ndarray, offsets: np.ndarray) -> K.Words:
    return K.words(data, offsets, K.NON_ALNUM, K.LOWER)


def features_of(data: np.ndarray, w: K.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, word) of each kind of feature."""
    yield w.hash, np.arange(len(w.hash))
    for k in STEMS:
        long = np.flatnonzero(w.end - w.start >= k)
        yield K.span_hashes(data, w.start[long], w.start[long] + k, K.LOWER) ^ STEM_MARK, long


def classes_of(data: np.ndarray, w: K.Words, features: np.ndarray, significance: np.ndarray) -> np.ndarray:
    """The place of each word's most significant feature, or -1."""
    out, best = np.full(len(w.hash), -1), np.zeros(len(w.hash))
    if len(features):
        bits = np.zeros(1 << 16, dtype=bool)
        bits[(features >> np.uint64(48)).astype(np.int64)] = True
        for h, word in features_of(data, w):
            maybe = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(features, h[maybe]), len(features) - 1)
            hit = features[at] == h[maybe]
            at, word = at[hit], word[maybe[hit]]
            more = significance[at] > best[word]
            out[word[more]], best[word[more]] = at[more], significance[at[more]]
    return out


def fold(key: str) -> F.Column:
    return F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")) % 5


def held_out(key: str) -> F.Column:
    return fold(key) == 0


def maximal_segments(values: list[float]) -> list[tuple[int, int, float]]:
    """(start, end, sum) of all maximal scoring segments (Ruzzo and Tompa), in linear time.

    Open segments are kept with the running sums at both ends. A new one is joined to the nearest open one of a lower left sum,
    unless that one's right sum is at least its own; each entry also links to that nearest one, so no chain is walked twice.
    """
    total, open_ = 0.0, []
    for i, v in enumerate(values):
        if v > 0:
            left, right, start = total, total + v, i
            at = len(open_) - 1
            while True:
                while at >= 0 and open_[at][0] >= left:
                    at = open_[at][4]
                if at < 0 or open_[at][1] >= right:
                    del open_[len(open_) :]
                    open_.append((left, right, start, i + 1, at))
                    break
                left, start = open_[at][0], open_[at][2]
                link = open_[at][4]
                del open_[at:]
                at = link if link >= 0 and open_[link][0] < left else len(open_) - 1
        total += v
    return [(s, e, r - l) for l, r, s, e, _ in open_]


def segments(data: np.ndarray, w: K.Words, rows: int, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(row, its segments as (first word, end word, score)) for each text with a positive word. Runs of words of one score sum up."""
    at = classes_of(data, w, model.features, model.significance)
    hit = np.flatnonzero(at >= 0)
    score = model.scores[at[hit]]
    first = np.searchsorted(w.doc, np.arange(rows + 1))
    cut = np.searchsorted(hit, first)
    for row in np.unique(w.doc[hit[score > 0]]).tolist():
        a, b = cut[row], cut[row + 1]
        places, values, spots = (hit[a:b] - first[row]).tolist(), [], []
        done = 0
        for place, v in zip(places, score[a:b].tolist(), strict=True):
            if place > done:
                values.append((place - done) * model.other)
                spots.append(done)
            values.append(v)
            spots.append(place)
            done = place + 1
        ends = [*spots[1:], done]
        yield row, [(spots[s], ends[e - 1], v) for s, e, v in maximal_segments(values)]


def statistics(data: np.ndarray, offsets: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[tuple[int, int, float]]]]:
    """By text: words, best score less ln(K n), summed excess and number of significant segments, and those segments."""
    rows = len(offsets) - 1
    w = words_of(data, offsets)
    n = K.per_row(w.doc, rows)
    floor = model.log_k + np.log(np.maximum(n, 1))
    best, excess, count = -floor, np.zeros(rows), np.zeros(rows, np.int64)
    passages: list[list[tuple[int, int, float]]] = [[] for _ in range(rows)]
    limit = -np.log(model.significant)
    for row, found in segments(data, w, rows, model):
        best[row] = max(v for *_, v in found) - floor[row]
        passages[row] = [x for x in found if x[2] - floor[row] >= limit]
        count[row] = len(passages[row])
        excess[row] = sum(v - floor[row] - limit for *_, v in passages[row])
    return n, best, excess, count, passages


def probability(best: np.ndarray, excess: np.ndarray, model: Model) -> np.ndarray:
    a, b, c = model.weights
    return 1 / (1 + np.exp(-np.clip(a + b * np.clip(best, -30, 30) + c * np.log1p(np.maximum(excess, 0)), -30, 30)))


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], name: str) -> Iterator[pa.RecordBatch]:
    """The parts' (key, toxic, clean) counts, added up by key."""
    if parts:
        key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        toxic, clean = (np.bincount(at, weights=np.concatenate([p[i] for p in parts]), minlength=len(key)).astype(np.int64) for i in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(toxic), pa.array(clean)], names=[name, "toxic", "clean"])


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and clean texts each feature stands."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False)
        for c in K.chunks(batch.column(1), COUNTED_BYTES):
            w = words_of(c.bytes, c.offsets)
            for h, word in features_of(c.bytes, w):
                h, row = K.distinct_in_row(h, w.doc[word])
                key, at, n = np.unique(h, return_inverse=True, return_counts=True)
                bad = np.bincount(at, weights=toxic[c.first + row], minlength=len(key))
                parts.append((key, bad, n - bad))
                if sum(len(p[0]) for p in parts) > HELD:
                    yield from _summed(parts, "feature")
                    parts = []
    yield from _summed(parts, "feature")


def _class_counts(features: np.ndarray, significance: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            parts = []
            for c in K.chunks(batch.column(1)):
                w = words_of(c.bytes, c.offsets)
                key, at, n = np.unique(classes_of(c.bytes, w, features, significance), return_inverse=True, return_counts=True)
                bad = np.bincount(at, weights=toxic[c.first + w.doc], minlength=len(key))
                parts.append((key, bad, n - bad))
            yield from _summed(parts, "place")

    return run


def lexicon(counts: DataFrame, toxic_docs: int, clean_docs: int, min_z: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features and their |z|, from the documents of each class (feature, toxic, clean) that hold them."""
    if not toxic_docs or not clean_docs:
        return np.zeros(0, np.uint64), np.zeros(0)
    term = lambda seen, row, column: f"CASE WHEN {seen} > 0 THEN ({seen}) * ln(({seen}) * {float(toxic_docs + clean_docs)} / (({row}) * {float(column)})) ELSE 0 END"
    n1, n0 = float(toxic_docs), float(clean_docs)
    holds, lacks = "(toxic + clean)", f"({n1 + n0} - toxic - clean)"
    ratio = " + ".join([term("toxic", holds, n1), term("clean", holds, n0), term(f"({n1} - toxic)", lacks, n1), term(f"({n0} - clean)", lacks, n0)])
    marked = counts.withColumn("z", F.expr(f"sqrt(greatest(0, 2 * ({ratio})))")).filter(F.col("z") >= min_z).select("feature", "z")
    rows = marked.toArrow()  # bounded by the labelled texts
    feature = rows["feature"].to_numpy().view(np.uint64)
    order = np.argsort(feature)
    return feature[order], rows["z"].to_numpy()[order]


def class_scores(counts: list[tuple[int, int, int]], classes: int, prior_words: float) -> tuple[np.ndarray, float]:
    """The log-odds of each place of the lexicon, and of all other words."""
    y = np.zeros((2, classes + 1))
    for place, toxic, clean in counts:
        y[:, place] = toxic, clean
    total = y.sum(axis=1, keepdims=True)
    prior = prior_words * y.sum(axis=0) / max(1.0, total.sum())
    rate = (y + prior) / (total + prior_words)
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = np.where(rate.min(axis=0) > 0, np.log(rate[0] / rate[1]), 0.0)
    return odds[:-1], float(min(odds[-1], -1e-4))


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - 1e-3 * beta
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(curvature, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_labelled: int = 20_000, most_bytes: int = 128 << 20, prior_words: float = 100.0, min_z: float = 5.0, significant: float = 0.05, without: int = 0) -> Model:
    """Of the labelled rows whose key's crc32 modulo 5 is neither 0 nor `without`."""
    spark = prepare(docs.sparkSession)
    allowed = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~fold(key).isin(0, without))
    marked = durable(allowed.groupBy(F.col(key).alias("__key")).agg(F.max(F.col(label).cast("int")).alias("toxic")), "labels")
    place = F.pmod(F.xxhash64("__key"), F.lit(1 << 30))
    limit = int(min(1.0, most_labelled / max(1, marked.count())) * (1 << 30))  # keys of the lowest hashes, by a threshold: no task sees more than its own rows
    body = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    labelled = durable(join_sized(body, durable(marked.filter(place < limit), "labelled"), "__key"), "labelled-texts")
    held = int(labelled.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    rows = labelled.filter(place < int(limit * min(1.0, most_bytes / max(1, held)))).select("toxic", "text")
    counted = rows.mapInArrow(_feature_counts, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    counts = durable(counted, "feature-counts")
    features, significance = lexicon(counts, sizes.get(1, 0), sizes.get(0, 0), min_z)
    discard(counts)
    by_place = rows.mapInArrow(_class_counts(features, significance), "place long, toxic long, clean long").groupBy("place").agg(F.sum("toxic"), F.sum("clean")).collect()  # at most one row a feature
    scores, other = class_scores(by_place, len(features), prior_words)
    model = Model(features, significance, scores, other, 0.0, (0.0, 0.0, 0.0), significant)
    start = float(np.log(20))
    sent = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """By label: words, and segments of at least the starting score."""
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for c in K.chunks(batch.column(1)):
                w = words_of(c.bytes, c.offsets)
                rows = len(c.offsets) - 1
                over = np.zeros(rows, np.int64)
                for row, found in segments(c.bytes, w, rows, sent.value):
                    over[row] = sum(v >= start for *_, v in found)
                yield pa.RecordBatch.from_arrays([pa.array(toxic[c.first : c.first + rows].astype(np.int32)), pa.array(K.per_row(w.doc, rows)), pa.array(over)], names=["toxic", "n", "over"])

    clean = rows.mapInArrow(measure, "toxic int, n long, over long").filter("toxic = 0").agg(F.sum("n"), F.sum("over")).first()
    log_k = float(np.log(((clean[1] or 0) + 0.5) / ((clean[0] or 0) + 1.0)) + start)
    model = model._replace(log_k=log_k)
    sent_k = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                _, best, excess, _, _ = statistics(c.bytes, c.offsets, sent_k.value)
                best, excess = np.clip(best, -30, 30), np.log1p(excess)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, len(best)), pa.array(np.round(best * 4) / 4), pa.array(np.round(excess * 4) / 4)], names=["toxic", "best", "excess"])

    cells = rows.mapInArrow(features, "toxic int, best double, excess double").groupBy("toxic", "best", "excess").count().collect()  # cells of a bounded grid
    discard(marked)
    discard(labelled)
    y = np.array([r[0] for r in cells], dtype=float)
    n = np.array([r[3] for r in cells], dtype=float)
    if not len(y) or y.min() == y.max():
        share = float(y.max()) if len(y) else 0.0
        return model._replace(weights=(30.0 if share else -30.0, 0.0, 0.0))
    beta = _fit(np.array([(1.0, r[1], r[2]) for r in cells]), y, n)
    return model._replace(weights=tuple(float(b) for b in beta))


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted, n_passages, passages (first word, end word, score): one row a document."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                _, best, excess, count, passages = statistics(c.bytes, c.offsets, sent.value)
                score = probability(best, excess, sent.value)
                found = pa.array([[{"first": s, "end": e, "score": v} for s, e, v in p] for p in passages], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, len(score)), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(count), found], names=["__key", "score", "predicted", "n_passages", "passages"])

    body = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    scored = body.mapInArrow(run, f"__key {body.dtypes[0][1]}, score double, predicted int, n_passages long, passages array<struct<first:bigint,end:bigint,score:double>>")
    return scored.select(F.col("__key").alias(key), held_out("__key").alias("held_out"), "score", "predicted", "n_passages", "passages")
