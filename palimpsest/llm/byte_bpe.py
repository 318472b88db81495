"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

Each byte has a printable character of its own; a vocabulary entry is the piece of its bytes'
characters and is scored by its negative rank, so the pair that sentencepiece merges first is the one of
lowest rank, leftmost among equals. Normalisation is the identity. Each match of the pattern is encoded by itself
(one that is an entry as a whole is that entry), and decoding joins the entries' bytes.

A null text is empty and has no ids. Texts are encoded whole, whatever their length. Repeated rows are encoded each, an empty table gives an
empty result, and other columns are not looked at, whatever their names. The files' paths are
parameters and are opened on the executors. `spaced` states that the pattern lets a single space start a pre-token and none cross it,
so that words can be kept from text to text; without it every text is split as a whole.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K
from palimpsest.llm import piece_model as P
from palimpsest.session import prepare

#: Distinct words that a worker keeps, in each of two generations; text in hand at once.
KEPT, KEPT_CHARS, TEXT_BYTES = 200_000, 32, 2 << 20


def byte_characters() -> list[str]:
    """By byte: itself where Latin-1 prints it, else the next character from U+0100 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printed else chr(next(spare)) for b in range(256)]


class ByteBpe:
    def __init__(self, ranks_path: str, pattern: str, spaced: bool = False):
        import regex
        import sentencepiece

        self.entries = P.read_ranks(ranks_path)
        own = byte_characters()
        self.shown = {b: c for b, c in enumerate(own)}
        pieces = [("".join(own[b] for b in entry), -float(rank), P.NORMAL) for rank, entry in enumerate(self.entries)]
        pieces.append(("⁇", 0.0, P.UNKNOWN))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=P.serialise(pieces, P.BPE))
        self.whole = {entry: rank for rank, entry in enumerate(self.entries)}
        compiled = regex.compile(pattern)
        self.split = compiled.findall if not compiled.groups else lambda text: [m[0] for m in compiled.finditer(text)]
        self.spaced = spaced
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode_tokens(self, tokens: list[str]) -> list[bytes]:
        hard = [t for t in tokens if t.encode() not in self.whole]
        shown = [t.encode().decode("latin-1").translate(self.shown) for t in hard]
        made = iter(self.model.encode(shown, num_threads=1) if shown else ())
        return [rank.to_bytes(4, "little") if (rank := self.whole.get(t.encode())) is not None else array("I", next(made)).tobytes() for t in tokens]

    def _encode_strings(self, strings: list[str]) -> list[bytes]:
        """Each string by itself; each distinct pre-token once."""
        split = [self.split(s) for s in strings]
        tokens = list(set().union(*split)) if split else []
        ids = dict(zip(tokens, self._encode_tokens(tokens), strict=True))
        return [b"".join([ids[t] for t in s]) for s in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text, the ids as little-endian unsigned 32-bit integers.

        Where the pattern is spaced, a word that has neither white space at its ends nor
        another space beside it is encoded with its space, once for all the texts. A text with other spaces is split as a whole.
        """
        if not self.spaced:
            return self._encode_strings(texts)
        cut = [text.split(" ") for text in texts]
        words = set().union(*(c[1:] for c in cut)) - self.kept.keys()
        if self.older:
            again = words & self.older.keys()
            self.kept.update((w, self.older[w]) for w in again)
            words -= again
        loose = {w for w in words if not w or w.strip() != w}
        new = list(words - loose)
        known = self.kept
        known.update(zip(new, self._encode_strings([" " + w for w in new]), strict=True))
        odd = {i for i, c in enumerate(cut) if not c[0] or c[0].strip() != c[0] or (loose and not loose.isdisjoint(c[1:]))}
        first = self._encode_strings([texts[i] if i in odd else c[0] for i, c in enumerate(cut)])
        out = [f if i in odd else b"".join([f, *[known[w] for w in c[1:]]]) for i, (f, c) in enumerate(zip(first, cut, strict=True))]
        for w in new:
            if len(w) > KEPT_CHARS:
                del known[w]
        if len(known) > KEPT:
            self.older, self.kept = known, {}
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.entries.__getitem__, memoryview(ids).cast("I")))


@lru_cache(2)
def codec(ranks_path: str, pattern: str, spaced: bool) -> ByteBpe:
    return ByteBpe(ranks_path, pattern, spaced)


def _texts(column: pa.Array) -> Iterator[list[str]]:
    for c in K.chunks(column, TEXT_BYTES):
        raw = c.bytes.tobytes()
        yield [raw[a:b].decode() for a, b in zip(c.offsets[:-1], c.offsets[1:], strict=True)]


def _digests(ranks_path: str, pattern: str, spaced: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern, spaced)
        for batch in batches:
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()) for texts in _texts(batch.column(1)) for ids in own.encode(texts)]
            counts, coded, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _encode(ranks_path: str, pattern: str, spaced: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern, spaced)
        for batch in batches:
            ids = [memoryview(x).cast("I").tolist() for texts in _texts(batch.column(1)) for x in own.encode(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["key", "ids"])

    return run


def _decode(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern, False)
        for batch in batches:
            texts = [b"".join(map(own.entries.__getitem__, v.as_py() or ())) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["key", "bytes"])

    return run


def _over(df: DataFrame, key: str, column: str, make, made: str) -> DataFrame:
    prepare(df.sparkSession)
    kept = df.select(F.col(key).alias("key"), F.col(column).alias("__in"))
    return kept.mapInArrow(make, f"key {kept.dtypes[0][1]}, {made}").withColumnRenamed("key", key)


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", spaced: bool = False) -> DataFrame:
    """key, ids array<int>."""
    return _over(docs, key, text, _encode(ranks_path, pattern, spaced), "ids array<int>")


def decode(coded: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, bytes binary: the text's UTF-8."""
    return _over(coded, key, ids, _decode(ranks_path, pattern), "bytes binary")


def digest(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text", spaced: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256: encoded and decoded in one pass."""
    return _over(docs, key, text, _digests(ranks_path, pattern, spaced), "n_tokens long, ids_sha256 string, decoded_sha256 string")
