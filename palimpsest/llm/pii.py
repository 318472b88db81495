"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust a score.

Four base kinds (email, ip, card, phone) follow fixed rules and always stay. Four kinds come on top: `iban`
(two letters, two digits, 11 to 30 letters or digits in groups, confirmed by mod 97), `ssn` (ddd-dd-dddd with valid parts), `key` (an access key
by its fixed prefix) and `secret` (16 letters and digits or more, of both). Each span has a
score: its kind's prior, plus the weight of a checksum that holds, plus the weight of a context word of
its kind within `CONTEXT` characters before it, or as far behind it in the same sentence and line, less that of a word before it that speaks against personal data (a serial number, an example). An
added span is reported from `threshold` on: ssn and secret need a context word, iban and key go where only a contrary one stands.

Null and empty texts have no spans; texts of any length are read whole. Offsets are code points, ends are exclusive. Repeated rows are treated
alike, an empty table gives an empty result, and the input's other columns are not looked at (mask_pii keeps them). Spans of several kinds may
overlap; they are listed by start, then kind, then end. The time is linear in the text: an email starts from its @, every other
kind from the start of a run of characters that no other match can share.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K
from palimpsest.session import prepare

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "key", "secret")
CONTEXT = 48
PRIOR = {"email": 0.6, "ip": 0.5, "card": 0.3, "phone": 0.5, "iban": 0.2, "ssn": 0.2, "key": 0.6, "secret": 0.2}
CHECKED = {"card": 0.4, "iban": 0.4}
NEARBY = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile"),
    "iban": ("iban", "bank", "account"),
    "ssn": ("ssn", "social security", "taxpayer"),
    "key": ("key", "aws", "access"),
    "secret": ("token", "password", "passwd", "secret", "key", "credential"),
}
CONTRARY = ("example", "sample", "order", "invoice", "serial", "version", "part number", "checksum", "commit")
NEAR_WEIGHT, CONTRARY_WEIGHT = 0.3, 0.3

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,}+")
_NEAR = {kind: re.compile(rf"(?<![a-z])(?:{'|'.join(words)})") for kind, words in NEARBY.items()}
_CONTRARY = re.compile(rf"(?<![a-z])(?:{'|'.join(CONTRARY)})")
_STOP = re.compile(r"[.!?;](?=\s|$)|\n")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else (2 * v if v < 5 else 2 * v - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters go last, letters are 10 to 35, the rest by 97 is 1."""
    compact = iban.replace(" ", "")
    rest = 0
    for c in compact[4:] + compact[:4]:
        v = int(c, 36)
        rest = (rest * (10 if v < 10 else 100) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of the kind, end) of the base kinds, in order."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def score(text: str, start: int, end: int, kind: str, checked: bool) -> float:
    before = text[max(0, start - CONTEXT) : start].lower()
    behind = _STOP.split(text[end : end + CONTEXT], maxsplit=1)[0].lower()
    total = PRIOR[kind] + (CHECKED.get(kind, 0.0) if checked else 0.0)
    total += (NEAR_WEIGHT if _NEAR[kind].search(before) or _NEAR[kind].search(behind) else 0.0) - (CONTRARY_WEIGHT if _CONTRARY.search(before) else 0.0)
    return round(min(1.0, max(0.0, total)), 6)


def added_spans(text: str, threshold: float) -> list[tuple[int, int, str, float]]:
    found = [(m.start(), 4, m.end(), True) for m in _IBAN.finditer(text) if mod97(m[0])]
    if "-" in text:
        found += [(m.start(), 5, m.end(), False) for m in _SSN.finditer(text)]
    keys = [(m.start(), 6, m.end(), False) for m in _KEY.finditer(text)] if "AKIA" in text else []
    taken = {s for s, *_ in found + keys}
    found += keys + [(m.start(), 7, m.end(), False) for m in _SECRET.finditer(text) if m.start() not in taken]
    scored = [(s, k, e, score(text, s, e, KINDS[k], checked)) for s, k, e, checked in found]
    return [x for x in scored if x[3] >= threshold]


def find(text: str | None, threshold: float = 0.5) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of all spans, by start, then kind, then end."""
    if not text:
        return []
    spans = [(s, k, e, score(text, s, e, KINDS[k], True)) for s, k, e in base_spans(text)]
    if _DIGIT.search(text) or "AKIA" in text:
        spans += added_spans(text, threshold)
    return [(s, e, KINDS[k], p) for s, k, e, p in sorted(spans)]


_DIGIT = re.compile("[0-9]")
SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string, scores string"


def _texts(column: pa.Array) -> Iterator[str]:
    """The texts; those that hold neither a digit nor an @ nor a key's prefix come as empty, as no span can start in them."""
    marks = K.np.zeros(256, dtype=bool)
    marks[[*b"0123456789@"]] = True
    for c in K.chunks(column):
        hits = K.np.diff(K.np.concatenate(([0], K.np.cumsum(marks[c.bytes])))[c.offsets])
        raw = c.bytes.tobytes()
        if keys := [m.start() for m in re.finditer(b"AKIA", raw)]:
            hits[K.np.searchsorted(c.offsets, keys, side="right") - 1] += 1
        for i, n in enumerate(hits):
            yield raw[c.offsets[i] : c.offsets[i + 1]].decode() if n else ""


def _digest(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in _texts(batch.column(batch.num_columns - 1)):
                spans = find(text, threshold)
                base = [f"{k}:{s}:{e}" for s, e, k, _ in spans if k in BASE_KINDS]
                counts = [sum(k == x for _, _, k, _ in spans) for x in BASE_KINDS]
                rows.append((*counts, len(spans) - len(base), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, e, k, _ in spans), ",".join(f"{p:.2f}" for *_, p in spans)))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.string()] * 3
            made = [pa.array(c, type=t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *names])

    return run


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row a document: key, counts of the base kinds, n_added, base_sha256, spans, scores (of the spans, in their order)."""
    prepare(docs.sparkSession)
    kept = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return kept.mapInArrow(_digest(threshold), f"__key {kept.dtypes[0][1]}, {SCHEMA}").withColumnRenamed("__key", key)


def mask(text: str | None, threshold: float = 0.5) -> str | None:
    """The text with each span replaced by <KIND>; spans that overlap are replaced as one, by the kind of the first, then the longest."""
    spans = sorted(find(text, threshold), key=lambda x: (x[0], -x[1]))
    out, done = [], 0
    for start, end, kind, _ in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return text if not spans else "".join(out) + text[done:]


def mask_pii(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The input's columns and rows, with personal data in the text column masked."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            texts = [mask(t, threshold) if t else raw for t, raw in zip(_texts(column), _Raw(column), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, type=column.type))

    return docs.mapInArrow(run, docs.schema)


class _Raw:
    """The column's values, made one at a time."""

    def __init__(self, column: pa.Array):
        self.column = column

    def __iter__(self):
        return (x.as_py() for x in self.column)
