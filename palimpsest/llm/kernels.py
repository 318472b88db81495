"""Vectorised kernels over the bytes of an Arrow string column.

Text is never decoded: word boundaries come from a table of separator bytes, and a word's 64-bit hash
is the difference of two prefix sums of a polynomial hash, moved to the origin by the inverse power.
Every array is bounded by CHUNK bytes of text or by one document, whichever is larger.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_MASK = (1 << 64) - 1


def _splitmix(seed: int, n: int) -> np.ndarray:
    out, state = [], seed
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(z ^ (z >> 31))
    return np.array(out, dtype=np.uint64)


BYTE_VALUES = _splitmix(11, 256)
PLACE_VALUES = _splitmix(12, 64) | np.uint64(1)
BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_STEP = 1 << 16


def _powers(base: int) -> np.ndarray:
    steps = np.full(_STEP, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


POWERS, INVERSE_POWERS = _powers(BASE), _powers(BASE_INVERSE)

#: Separators [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators: every ASCII byte that is no letter or digit.
NON_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
SAME = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all else as it is.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Chunk(NamedTuple):
    first: int  # row of the batch
    bytes: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than rows


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray  # row of the chunk
    hash: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Runs of whole texts, each of at most `limit` bytes or one text. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        stop = min(stop, n)
        yield Chunk(row, raw[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
        row = stop


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of data; both arrays ascend."""
    values = BYTE_VALUES[fold]
    at_start = np.zeros(len(start), dtype=np.uint64)
    at_end = np.zeros(len(end), dtype=np.uint64)
    back = np.zeros(len(start), dtype=np.uint64)
    carry, n = np.uint64(0), len(data)
    for a in range(0, n + 1, _STEP):
        b = min(a + _STEP, n)
        shift = np.uint64(pow(BASE, a, 1 << 64))
        sums = np.empty(b - a + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(values[data[a:b]] * POWERS[: b - a], dtype=np.uint64, out=sums[1:])
        sums = sums * shift + carry
        s0, s1 = np.searchsorted(start, (a, a + _STEP))
        e0, e1 = np.searchsorted(end, (a, a + _STEP))
        at_start[s0:s1] = sums[start[s0:s1] - a]
        at_end[e0:e1] = sums[end[e0:e1] - a]
        back[s0:s1] = INVERSE_POWERS[start[s0:s1] - a] * np.uint64(pow(BASE_INVERSE, a, 1 << 64))
        carry = sums[-1]
    return mix((at_end - at_start) * back + (end - start).astype(np.uint64) * PLACE_VALUES[63])


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word; no word crosses two texts."""
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE, fold: np.ndarray = SAME) -> Words:
    start, end, doc = word_spans(data, offsets, separators)
    return Words(start, end, doc, span_hashes(data, start, end, fold))


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of every window of k words within one text."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h += w.hash[j : j + n] * PLACE_VALUES[j]
    first = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    return mix(h[first] + np.uint64(k)), w.doc[first], first


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weights, minlength=n).astype(np.int64)


def distinct_in_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs, by row and then hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]
