"""Cross-entropy difference between a target and a background language model.

Both are interpolated bigram models with one vocabulary, one set of kept bigrams, one discount and one smoothing. The
target model counts the documents marked as target, the background model all documents, with its counts scaled
to the target's size so that discount and smoothing weigh alike (matched models). Counts cover every token of the corpus.

`score_corpus` keeps every word and every bigram of the corpus, so its model grows with the input. The model is never in one place:
texts are cut into blocks, each block sends its distinct pairs (then its distinct words) with their counts to the parts of the hash
space, and each part sends the sums over all blocks back in the order it got them. A message is one packed row for a block and a part,
and a pair occurs once a block, so a word pair in a third of all documents is no larger a key than any other.

`train` gathers the model on the driver instead, for small corpora or with a limit by choice: words that make up at least `word_share` of all tokens (the rest is
one unknown word) and bigrams from `pair_share` on; others back off to their second word by the mass that their first word leaves.
With shares of 0 both ways give the same scores.

A document's score is its mean loss per token under the target less that under the background: lower is more like the target.
Both models have counted the documents that they score, target documents in the target model too; nothing is held out.
Words are letters and digits, A-Z in lower case. A text without words (null and empty ones too) has 0 tokens and null losses; long texts are scored whole.
Repeated rows count as often as they stand; rows without a key are no targets. Without target rows the target model is uniform over the vocabulary. An
empty table gives an empty result. Columns of other names, and such as clash with the output's, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K
from palimpsest.llm.tables import join_sized
from palimpsest.session import discard, durable, prepare

DISCOUNT = 0.75
#: Counts that a task adds up before it passes them on.
HELD = 200_000
#: Tokens of a block, and of a part of the hash space (one text at least).
BLOCK_TOKENS, PART_TOKENS = 1 << 21, 1 << 21


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes; id len(words) is the unknown word
    single: np.ndarray  # (2, words + 1): probability by id, target then background
    left: np.ndarray  # (2, words + 1): mass that a first word leaves to its second's own probability
    pairs: np.ndarray  # sorted first id * (words + 1) + second id
    paired: np.ndarray  # (2, pairs): discounted probability of the second word after the first


def words_of(c: K.Chunk) -> K.Words:
    return K.words(c.bytes, c.offsets, K.NON_ALNUM, K.LOWER)


def ids_of(w: K.Words, words: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(len(w.hash), np.int64)
    at = np.minimum(np.searchsorted(words, w.hash), len(words) - 1)
    return np.where(words[at] == w.hash, at, len(words))


def pairs_of(ids: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(pair, second word's place) of neighbours within one text."""
    second = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    return ids[second - 1] * size + ids[second], second


def _sums(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    if parts:
        key, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        target, everything = (np.bincount(at, weights=np.concatenate([p[i] for p in parts]), minlength=len(key)).astype(np.int64) for i in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(target), pa.array(everything)], names=["key", "target", "everything"])


def _counter(words: np.ndarray | None):
    """Counts of words (of pairs, given the vocabulary) among target texts and among all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            marked = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for c in K.chunks(batch.column(1)):
                w = words_of(c)
                key, doc = w.hash, w.doc
                if words is not None:
                    key, second = pairs_of(ids_of(w, words), w.doc, len(words) + 1)
                    doc = w.doc[second]
                key, at, n = np.unique(key, return_inverse=True, return_counts=True)
                parts.append((key, np.bincount(at, weights=marked[c.first + doc], minlength=len(key)), n))
                if sum(len(p[0]) for p in parts) > HELD:
                    yield from _sums(parts)
                    parts = []
        yield from _sums(parts)

    return run


def _count(marked: DataFrame, words: np.ndarray | None) -> DataFrame:
    counted = marked.mapInArrow(_counter(words), "key long, target long, everything long")
    return durable(counted.groupBy("key").agg(F.sum("target").alias("target"), F.sum("everything").alias("everything")), "words" if words is None else "pairs")


def _kept(counts: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and (2, n) counts of those that occur at least `least` times."""
    rows = counts.filter(F.col("everything") >= least).toArrow()  # at most total / least
    key = rows["key"].to_numpy()
    return key, np.array([rows["target"].to_numpy(), rows["everything"].to_numpy()], dtype=float)


def _marked(docs: DataFrame, targets: DataFrame, key: str, text: str) -> DataFrame:
    named = targets.select(F.col(key).alias("__key")).where("__key IS NOT NULL").distinct().withColumn("__target", F.lit(True))
    body = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    return join_sized(body, durable(named, "targets"), "__key", "left").select("__key", F.coalesce("__target", F.lit(False)).alias("target"), "text")


def train(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", word_share: float = 1e-6, pair_share: float = 1e-6, smoothing: float = 100.0) -> Model:
    """targets: a table whose `key` column names the target documents."""
    prepare(docs.sparkSession)
    marked = _marked(docs, targets, key, text).select("target", "text")

    counted = _count(marked, None)
    totals = np.array([float(x or 0) for x in counted.agg(F.sum("target"), F.sum("everything")).first()])
    kinds, n = _kept(counted, max(1.0, word_share * totals[1]))
    order = np.argsort(kinds.view(np.uint64))
    words, n = kinds.view(np.uint64)[order], n[:, order]
    n = np.hstack([n, np.maximum(totals - n.sum(axis=1), 0)[:, None]])
    scale = np.array([1.0, totals[0] / totals[1] if totals[0] and totals[1] else 1.0])[:, None]
    n = n * scale
    single = (n + smoothing / n.shape[1]) / (n.sum(axis=1, keepdims=True) + smoothing)

    pairs, m = _kept(_count(marked, words), max(1.0, pair_share * totals[1]))
    order = np.argsort(pairs)
    pairs, m = pairs[order], m[:, order] * scale
    first = pairs // (len(words) + 1)
    seen = np.maximum(n[:, first], np.maximum(m, 1e-9))
    paired = np.maximum(m - DISCOUNT, 0) / seen
    left = np.ones_like(n)
    for i in range(2):
        left[i] -= np.bincount(first, weights=paired[i], minlength=n.shape[1])
    return Model(words, single, np.maximum(left, 1e-12), pairs, paired)


def losses(c: K.Chunk, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """By text: tokens, and (2, texts) summed losses in nats, target then background."""
    rows = len(c.offsets) - 1
    w = words_of(c)
    ids = ids_of(w, model.words)
    chance = model.single[:, ids]
    pair, second = pairs_of(ids, w.doc, len(model.words) + 1)
    chance[:, second] *= model.left[:, ids[second - 1]]
    if len(model.pairs) and len(pair):
        at = np.minimum(np.searchsorted(model.pairs, pair), len(model.pairs) - 1)
        hit = np.flatnonzero(model.pairs[at] == pair)
        chance[:, second[hit]] += model.paired[:, at[hit]]
    loss = -np.log(chance)
    return K.per_row(w.doc, rows), np.array([np.bincount(w.doc, weights=x, minlength=rows) for x in loss])


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, target_loss, background_loss (nats a token), score (their difference): one row a document."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in K.chunks(batch.column(1)):
                n, loss = losses(c, sent.value)
                mean = loss / np.maximum(n, 1)
                none = n == 0
                cells = [pa.array(x, mask=none) for x in (mean[0], mean[1], mean[0] - mean[1])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, len(n)), pa.array(n), *cells], names=["__key", "n_tokens", "target_loss", "background_loss", "score"])

    body = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return body.mapInArrow(run, f"__key {body.dtypes[0][1]}, n_tokens long, target_loss double, background_loss double, score double").withColumnRenamed("__key", key)


def _pack(x: np.ndarray) -> bytes:
    """Compressed planes of bytes: high bytes of small numbers are runs of zeros."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(body: bytes, kind: type) -> np.ndarray:
    size, width = int.from_bytes(body[:8], "little"), np.dtype(kind).itemsize
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(body[8:], size, "zstd"), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(ascending: np.ndarray) -> bytes:
    return _pack(np.diff(ascending, prepend=np.uint64(0)))


def _blocks(kind: pa.DataType):
    """Rows (key, target, text) to one row a block: its texts as places in the block's list of words, the most frequent first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        task, made, held = TaskContext.get().partitionId(), 0, 0

        def block() -> pa.RecordBatch:
            keys = pa.concat_arrays([p[0] for p in parts])
            target, lens, hashes = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
            words, ids, n = np.unique(hashes, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            cells = [_pack(target.astype(np.uint8)), _pack(lens), _pack(place[ids]), _pack(words[order])]
            counts = [len(hashes), int(lens[target].sum())]
            listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made]), listed, *[pa.array([x]) for x in counts], *[pa.array([x], pa.binary()) for x in cells]], names=_BLOCK)

        for batch in batches:
            marked = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for c in K.chunks(batch.column(2)):
                w, rows = words_of(c), len(c.offsets) - 1
                if parts and held + len(w.hash) > BLOCK_TOKENS:
                    yield block()
                    parts, made, held = [], made + 1, 0
                parts.append((batch.column(0).slice(c.first, rows).cast(kind), marked[c.first : c.first + rows], K.per_row(w.doc, rows).astype(np.uint32), w.hash))
                held += len(w.hash)
        if parts:
            yield block()

    return run


_BLOCK = ["block", "keys", "tokens", "target_tokens", "target", "lens", "ids", "words"]


class Texts(NamedTuple):
    target: np.ndarray  # by text
    doc: np.ndarray  # text of each token
    rows: int
    ids: np.ndarray  # by token, places in words
    words: np.ndarray
    second: np.ndarray  # tokens that follow one of their text
    pairs: np.ndarray  # distinct pair hashes, ascending
    first: np.ndarray  # first word of each pair
    at: np.ndarray  # pair of each of second


def _texts(row: dict) -> Texts:
    lens, ids, words = _unpack(row["lens"], np.uint32), _unpack(row["ids"], np.uint32).astype(np.int64), _unpack(row["words"], np.uint64)
    doc = np.repeat(np.arange(len(lens)), lens)
    second = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    hashes = K.mix(words[ids[second - 1]] * np.uint64(K.BASE) + words[ids[second]])
    pairs, some, at = np.unique(hashes, return_index=True, return_inverse=True)
    return Texts(_unpack(row["target"], np.uint8).astype(bool), doc, len(lens), ids, words, second, pairs, ids[second[some] - 1], at)


def _dealt(block: int, keys: np.ndarray, parts: int, columns: list[np.ndarray]) -> Iterator[tuple]:
    """Messages (part, block, keys, columns) of ascending keys, none without keys; parts are ranges of the high half of a hash."""
    if not len(keys):
        return
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    edges = np.flatnonzero(np.diff(part, prepend=np.uint64(parts)))
    for low, high in zip(edges, [*edges[1:], len(keys)], strict=True):
        yield (int(part[low]), block, _steps(keys[low:high]), *[_pack(x[low:high]) for x in columns])


def _messages(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64() if n in ("part", "block", "kinds") else pa.binary() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _sent(make, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if rows := list(make(batch.slice(i, 1).to_pylist()[0])):
                    yield _messages(rows, names)

    return run


def _summed(kinds: list[type]):
    """Messages of one part to the sums over all blocks, in the order of each message; `once` marks one place of each key."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        keys = [np.cumsum(_unpack(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
        distinct, some, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        once = np.zeros(len(at), np.uint8)
        once[some] = 1
        sums = [np.bincount(at, weights=np.concatenate([_unpack(r[f"c{i}"], k) for r in rows]), minlength=len(distinct)).astype(k)[at] for i, k in enumerate(kinds)]
        edges = np.cumsum([0, *map(len, keys)])
        out = [
            (r["part"], r["block"], len(distinct) if j == 0 else 0, _pack(once[low:high]), *[_pack(x[low:high]) for x in sums])
            for j, (r, low, high) in enumerate(zip(rows, edges, edges[1:], strict=False))
        ]
        return pa.Table.from_batches([_messages(out, ["part", "block", "kinds", "once", *[f"c{i}" for i in range(len(kinds))]])])

    return run


def _told(messages: pa.Table, name: str, kind: type) -> np.ndarray:
    rows = sorted(zip(messages["part"].to_pylist(), messages[name].to_pylist(), strict=True))
    return np.concatenate([np.zeros(0, kind), *[_unpack(x, kind) for _, x in rows]])


def _exchange(sent: DataFrame, kinds: list[type]) -> DataFrame:
    return sent.groupBy("part").applyInArrow(_summed(kinds), "part long, block long, kinds long, once binary" + "".join(f", c{i} binary" for i in range(len(kinds))))


def score_corpus(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", smoothing: float = 100.0) -> DataFrame:
    """The rows of score_documents under models that keep every word and bigram of docs."""
    prepare(docs.sparkSession)
    marked = _marked(docs, targets, key, text)
    kind = marked.dtypes[0][1]
    arrow = marked.select("__key").limit(0).toArrow().schema.field(0).type
    columns = f"block long, keys array<{kind}>, tokens long, target_tokens long, target binary, lens binary, ids binary, words binary"
    blocks = durable(marked.mapInArrow(_blocks(arrow), columns), "blocks")
    total, target = (int(x or 0) for x in blocks.agg(F.sum("tokens"), F.sum("target_tokens")).first())
    scale = target / total if target and total else 1.0
    parts = max(1, -(-total // PART_TOKENS))

    def pairs_sent(row: dict) -> Iterator[tuple]:
        x = _texts(row)
        marked = x.target[x.doc[x.second]]
        t = np.bincount(x.at, weights=marked, minlength=len(x.pairs)).astype(np.int64)
        yield from _dealt(row["block"], x.pairs, parts, [t, np.bincount(x.at, minlength=len(x.pairs)).astype(np.int64)])

    def pairs_told(one: pa.Table, messages: pa.Table) -> pa.Table:
        x = _texts(one.drop_columns(["keys"]).to_pylist()[0])
        once, t, n = (_told(messages, c, k) for c, k in (("once", np.uint8), ("c0", np.int64), ("c1", np.int64)))
        taken = [np.bincount(x.first, weights=np.maximum(m - DISCOUNT, 0) * once, minlength=len(x.words)) for m in (t, n * scale)]
        cells = [pa.array([_pack(v)], pa.binary()) for v in (t, n, *taken)]
        for name, cell in zip(("pair_target", "pair_all", "taken_target", "taken_all"), cells, strict=True):
            one = one.append_column(name, cell)
        return one

    def words_sent(row: dict) -> Iterator[tuple]:
        lens, ids, words = _unpack(row["lens"], np.uint32), _unpack(row["ids"], np.uint32), _unpack(row["words"], np.uint64)
        marked = np.repeat(_unpack(row["target"], np.uint8), lens)
        t, n = np.bincount(ids, weights=marked, minlength=len(words)).astype(np.int64), np.bincount(ids, minlength=len(words)).astype(np.int64)
        order = np.argsort(words)
        sums = [t, n, _unpack(row["taken_target"], np.float64), _unpack(row["taken_all"], np.float64)]
        yield from _dealt(row["block"], words[order], parts, [v[order] for v in sums])

    def scored(one: pa.Table, messages: pa.Table) -> pa.Table:
        row = one.drop_columns(["keys"]).to_pylist()[0]
        x = _texts(row)
        order, kinds = np.argsort(x.words), [np.int64, np.int64, np.float64, np.float64]
        told = [np.empty(len(order)) for _ in kinds]
        for i, k in enumerate(kinds):
            told[i][order] = _told(messages, f"c{i}", k)
        n_tokens, mean = K.per_row(x.doc, x.rows), []
        for count, by, taken, pair, size in ((told[0], 1.0, told[2], row["pair_target"], target), (told[1], scale, told[3], row["pair_all"], total * scale)):
            n, m = count * by, _unpack(pair, np.int64) * by
            single = (n + smoothing / (vocabulary + 1)) / (size + smoothing)
            left = np.maximum(1 - taken / np.maximum(n, 1e-9), 1e-12)
            chance = single[x.ids]
            chance[x.second] *= left[x.ids[x.second - 1]]
            chance[x.second] += (np.maximum(m - DISCOUNT, 0) / np.maximum(n[x.first], 1e-9))[x.at]
            mean.append(np.bincount(x.doc, weights=-np.log(chance), minlength=x.rows) / np.maximum(n_tokens, 1))
        none = n_tokens == 0
        cells = [pa.array(v, mask=none) for v in (mean[0], mean[1], mean[0] - mean[1])]
        keys = one["keys"].combine_chunks().flatten()
        return pa.table([keys, pa.array(n_tokens), *cells], names=["__key", "n_tokens", "target_loss", "background_loss", "score"])

    sent = blocks.mapInArrow(_sent(pairs_sent, ["part", "block", "keys", "c0", "c1"]), "part long, block long, keys binary, c0 binary, c1 binary")
    back = _exchange(sent, [np.int64, np.int64])
    more = columns + ", pair_target binary, pair_all binary, taken_target binary, taken_all binary"
    known = durable(blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(pairs_told, more), "paired")
    discard(blocks)
    names = ["part", "block", "keys", "c0", "c1", "c2", "c3"]
    narrow = known.select("block", "target", "lens", "ids", "words", "taken_target", "taken_all")
    sent = narrow.mapInArrow(_sent(words_sent, names), "part long, block long, keys binary, c0 binary, c1 binary, c2 binary, c3 binary")
    told = durable(_exchange(sent, [np.int64, np.int64, np.float64, np.float64]), "words")
    vocabulary = int(told.agg(F.sum("kinds")).first()[0] or 0)
    out = known.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(scored, f"__key {kind}, n_tokens long, target_loss double, background_loss double, score double")
    return out.withColumnRenamed("__key", key)
