"""Wire format of a sentencepiece model, written and read field by field; and vocabularies by path."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator, Sequence

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE = 1, 2, 6


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _block(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def serialise(pieces: Sequence[tuple[str, float, int]], kind: int, byte_fallback: bool = False, dummy_prefix: bool = False, escape: bool = False) -> bytes:
    """A model with identity normalisation; pieces are (text, score, type) by id, one of them of type UNKNOWN."""
    out = bytearray()
    for text, score, type_ in pieces:
        out += _block(1, _block(1, text.encode()) + b"\x15" + struct.pack("<f", score) + _number(3, type_))
    unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    minus_one = (1 << 64) - 1
    trainer = _number(3, kind) + _number(4, len(pieces)) + _number(35, byte_fallback) + _number(40, unknown) + b"".join(_number(f, minus_one) for f in (41, 42, 43))
    return bytes(out + _block(2, trainer) + _block(3, _block(1, b"identity") + _number(3, dummy_prefix) + _number(4, 0) + _number(5, escape)))


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    at = 0

    def varint() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if wire == 2 else 4 if wire == 5 else 8
        yield tag >> 3, data[at : at + size]
        at += size


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(text, score, type) by id, of a sentencepiece model file."""
    with open(path, "rb") as f:
        data = f.read()
    out = []
    for field, body in _fields(data):
        if field == 1:
            own = dict(_fields(body))
            out.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
    return out


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranks[i] for i in range(len(ranks))]
