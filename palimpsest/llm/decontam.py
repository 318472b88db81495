"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items and texts are sets of word shingles (five words; letters and digits only, A-Z in lower case, so
punctuation and junk marks don't hide a passage). An item is found in a text when at least `threshold` of its shingles
are in it, wherever they stand. The text may be thousands of times longer, so plain MinHash signatures of both would
hardly ever agree. Instead the item alone is sketched: its least shingles under a seeded permutation. Containment c
means that each of them is in the text with probability c; and with m = n - ceil(threshold * n) + 1 of n, at
least one is for certain. Items are partitioned by size (powers of two), and all items of a partition take the m of its largest
size, so every partition is one fixed-length sketch table and no contained item is missed.

Texts are streamed past the partitions: those that are too short for the least item of a partition leave it out; of the others, a
text that holds a sketch value of an item is a candidate of its partition, and the exact share of the
item's shingles decides. An item of fewer than five words is one shingle of all its words. Items without words are in
no text. Items come in blocks of at most `block_shingles` shingles, the only data that is sent to every executor; each block is one pass.
Null and empty texts hold nothing; long texts are searched whole. Repeated rows are answered each; equal items too. Without texts or items
nothing is found. Columns of other names, and such as clash with the output's, are not looked at (decontaminate keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K
from palimpsest.session import prepare

PERMUTATION = np.uint64(0x5851F42D4C957F2D)


class Partition(NamedTuple):
    """Items of one size class: sorted (shingle, item) pairs, the sketch values among them, and the least number of shingles that a text needs."""

    shingle: np.ndarray
    item: np.ndarray
    probes: np.ndarray
    least: int


class Items(NamedTuple):
    """A block of items: its partitions, the items' sizes, and the words of a shingle that occur."""

    partitions: tuple[Partition, ...]
    size: np.ndarray
    lengths: tuple[int, ...]


def sketch(texts: list[str], words: int, threshold: float) -> Items:
    encoded = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(e) for e in encoded]))).astype(np.int64)
    w = K.words(np.frombuffer(b"".join(encoded), np.uint8), offsets, K.NON_ALNUM, K.LOWER)
    counts = K.per_row(w.doc, len(texts))
    hashes, rows, lengths = [], [], set()
    for k in range(1, words + 1):
        h, row, _ = K.shingles(w, k)
        own = counts[row] >= words if k == words else counts[row] == k
        if own.any():
            lengths.add(k)
        hashes.append(h[own])
        rows.append(row[own])
    shingle, item = K.distinct_in_row(np.concatenate(hashes), np.concatenate(rows))
    size = K.per_row(item, len(texts))
    kind = np.frexp(size)[1][item]
    order = np.lexsort((K.mix(shingle ^ PERMUTATION), item))  # of each item its least values first
    place = np.arange(len(item)) - np.searchsorted(item, item)
    partitions = []
    for p in np.unique(kind):
        own = kind == p
        sizes = size[item[own]]
        most = int(sizes.max())
        m = int(most - np.ceil(threshold * most - 1e-9) + 1)
        probes = np.unique(shingle[order][own & (place < m)])
        by = np.argsort(shingle[own], kind="stable")
        partitions.append(Partition(shingle[own][by], item[own][by], probes, int(np.ceil(threshold * sizes.min() - 1e-9))))
    return Items(tuple(partitions), size, tuple(sorted(lengths)))


def _bits(values: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 16, dtype=bool)
    table[(values >> np.uint64(48)).astype(np.int64)] = True
    return table


def _among(h: np.ndarray, values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of the hashes that are among the sorted values."""
    maybe = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(values, h[maybe]), len(values) - 1)
    return maybe[values[at] == h[maybe]]


def tables(items: Items) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(_bits(p.probes), _bits(p.shingle)) for p in items.partitions]


def search(data: np.ndarray, offsets: np.ndarray, items: Items, bits: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, shared shingles) of every text and item that it contains."""
    rows, found = len(offsets) - 1, [(np.zeros(0, np.int64),) * 3]
    if items.partitions:
        w = K.words(data, offsets, K.NON_ALNUM, K.LOWER)
        made = [K.shingles(w, k)[:2] for k in items.lengths]
        h, row = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made])
        holds = K.per_row(row, rows)
        for p, (probe_bits, all_bits) in zip(items.partitions, bits, strict=True):
            hit = np.zeros(rows, dtype=bool)
            hit[row[_among(h, p.probes, probe_bits)]] = True
            kept = np.flatnonzero((hit & (holds >= p.least))[row])
            kept = kept[_among(h[kept], p.shingle, all_bits)]
            own, at_row = K.distinct_in_row(h[kept], row[kept])
            first, last = np.searchsorted(p.shingle, own, "left"), np.searchsorted(p.shingle, own, "right")
            n = last - first
            at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            pair, shared = np.unique(np.repeat(at_row, n) * len(items.size) + p.item[at], return_counts=True)
            text, item = pair // len(items.size), pair % len(items.size)
            enough = shared >= np.ceil(threshold * items.size[item] - 1e-9)
            found.append((text[enough], item[enough], shared[enough]))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def item_blocks(items: DataFrame, key: str, text: str, block_shingles: int) -> Iterator[tuple[list, list[str]]]:
    """The items, row by row, in blocks whose words are bounded."""
    keys, texts, size = [], [], 0
    for k, t in items.select(key, text).toLocalIterator():
        own = len((t or "").encode()) // 2 + 1  # no fewer than its words
        if keys and size + own > block_shingles:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys.append(k)
        texts.append(t or "")
        size += own
    if keys:
        yield keys, texts


def find_contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", words: int = 5, threshold: float = 0.8, block_shingles: int = 4_000_000) -> DataFrame:
    """key, item key, n_item, n_shared, containment: one row for each text and item that it contains."""
    spark = prepare(docs.sparkSession)
    body = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    item_kind = dict(items.dtypes)[item_key]
    schema = f"__key {body.dtypes[0][1]}, at int, n_item long, n_shared long"
    found = None
    for keys, texts in item_blocks(items, item_key, item_text, block_shingles):
        block = sketch(texts, words, threshold)
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            bits = tables(own)
            for batch in batches:
                for c in K.chunks(batch.column(1)):
                    row, item, shared = search(c.bytes, c.offsets, own, bits, threshold)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + c.first)), pa.array(item.astype(np.int32)), pa.array(own.size[item]), pa.array(shared)], names=["__key", "at", "n_item", "n_shared"])

        names = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], f"at int, __item {item_kind}")
        part = body.mapInArrow(run, schema).join(F.broadcast(names), "at")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"{schema}, __item {item_kind}")
    return found.select(F.col("__key").alias(key), F.col("__item").alias(item_key), "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", words: int = 5, threshold: float = 0.8, block_shingles: int = 4_000_000) -> DataFrame:
    """The documents that contain no item, with their columns as they are."""
    spark = prepare(docs.sparkSession)
    at = docs.columns.index(text)
    for _, texts in item_blocks(items, item_key, item_text, block_shingles):
        sent = spark.sparkContext.broadcast(sketch(texts, words, threshold))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            bits = tables(own)
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for c in K.chunks(batch.column(at)):
                    clean[c.first + search(c.bytes, c.offsets, own, bits, threshold)[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
