"""Conversation structure repair by a dynamic programme over retained turns.

A conversation's rows are taken by turn (nulls first), then role, then text. A row's first fault counts: blank (no character but white space),
duplicate (its role and text stood earlier), truncated (its last character that is no white space does not end a sentence). Edits: keep a row (free),
rerole it to user or assistant (2), delete it (3; blank and duplicate rows must go), insert an empty turn of user or assistant (2); a truncated row that
stays adds 1. The repaired roles are nothing, or an optional system turn and then pairs of user and assistant.

The programme walks the rows once. A state is the role of the last retained row, and holds the least price of reaching it less the deletions so far (a prefix sum), so
rows between two retained ones are priced by a difference and a state that nothing better reaches stays as it is (a running minimum). The two roles at a gap's ends name the
inserts. Equal prices are settled by the audit, the edits' initials in order, least in ASCII: deletions come before inserts in a gap, and the states' audits, none of
which is the beginning of another's, are kept in order by rank, so no string is compared.

Rows are dealt by conversation, sorted, and streamed: a task holds one conversation's digests of earlier rows and its audits, never its texts, and the repaired text is
hashed on the way, once a state. The hash of a conversation is a chain, so its rows pass one task, whatever their number.

Nulls: a null key is a conversation of its own; a null role or text is one space, a null turn takes no part in gaps. Roles count by their first letter (s, u, a);
others can only be reroled or deleted. Repeated rows are duplicates of the first. Long texts are read whole. Gaps beyond 63 bits are 2^63 - 1. A conversation of which no row
is present has zeros, an empty audit and the hash of nothing; an empty table gives an empty result. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import prepare

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
SPACES = b" \t\n\v\f\r"
LEGAL = frozenset((b"su", b"ua", b"au"))
NAMES = {b"u": b"user", b"a": b"assistant"}
#: Roles inserted between the last retained row (b"" before the first) and the next; at the end, None.
BETWEEN = {
    (b"", b"s"): b"", (b"", b"u"): b"", (b"", b"a"): b"u", (b"", None): b"",
    (b"s", b"u"): b"", (b"s", b"a"): b"u", (b"s", None): b"ua",
    (b"u", b"a"): b"", (b"u", b"u"): b"a", (b"u", None): b"a",
    (b"a", b"u"): b"", (b"a", b"a"): b"u", (b"a", None): b"",
}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: Conversations, and characters of audits, of an output batch.
BATCH, AUDIT_BYTES = 1000, 1 << 20


def damage(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """key, turn, role, text, present: the rows with seeded faults, by crc32 of `key:turn` modulo 20.

    0 drops a row (present is false, so that its conversation is still known), 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's.
    """
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (key, turn)]
    marked = rows.select(
        F.col(key).alias("__key"),
        F.col(turn).alias("__turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("__role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("__text"),
        (F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20).alias("__code"),
    )
    body = F.when(F.col("__code") == 1, "").when(F.col("__code") == 2, F.translate("__text", ".!?", "")).when(F.col("__code") > 0, F.col("__text"))
    return marked.select(
        F.col("__key").alias(key),
        F.col("__turn").alias(turn),
        F.when(F.col("__code") == 4, "user").otherwise(F.col("__role")).alias(role),
        body.alias(text),
        (F.col("__code") > 0).alias("present"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("__code") == 3, 2).otherwise(1))).alias("__copy"),
    ).drop("__copy")


class Repair:
    """One conversation, row by row."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = None
        self.turns = self.rows = 0
        self.seen: set[bytes] = set()
        self.role: bytes | None = None
        #: By role of the last retained row: price less the deletions of all rows so far, rank of the audit, rows so far, audit as (earlier, deletions, rest), hash, whether it has lines.
        self.states = {b"": (0, 0, 0, None, hashlib.sha256(), False)}

    def fault(self, role: bytes, text: bytes) -> str | None:
        ink = text.strip(SPACES)
        if not ink:
            self.blank += 1
            return "blank"
        mark = hashlib.blake2b(len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()
        if mark in self.seen:
            self.duplicate += 1
            return "duplicate"
        self.seen.add(mark)
        if ink[-1:] not in (b".", b"!", b"?"):
            self.truncated += 1
            return "truncated"
        return None

    def take(self, turn: int | None, role: bytes, text: bytes) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        initial = role[:1]
        if self.role is not None and self.role + initial not in LEGAL:
            self.illegal += 1
        self.role = initial
        fault = self.fault(role, text)
        if fault in (None, "truncated"):
            self._retain(initial, role, text, TRUNCATED if fault else 0)
        self.rows += 1

    def _retain(self, initial: bytes, role: bytes, text: bytes, extra: int) -> None:
        old, new = self.states, {}
        for to in (b"s", b"u", b"a"):
            own = b"K" if to == initial else b"R"
            stays = (old[to][0], old[to][1], b"D", None) if to in old else None
            best = stays
            if own == b"K" or to != b"s":
                for last, state in old.items():
                    between = BETWEEN.get((last, to))
                    if between is not None:
                        price = state[0] + INSERT * len(between) + (REROLE if own == b"R" else 0) + extra - DELETE
                        one = (price, state[1], b"I" * len(between) + own, last)
                        best = one if best is None or one[:3] < best[:3] else best
            if best is not None:
                new[to] = best
        ranked = sorted([(state[1], b"D", b"") for last, state in old.items() if last == b""] + [(x[1], x[2], to) for to, x in new.items()])
        rank = {to: i for i, (_, _, to) in enumerate(ranked)}
        self.states = {b"": (old[b""][0], rank[b""], *old[b""][2:])}
        for to, (price, _, suffix, last) in new.items():
            if last is None:
                self.states[to] = (price, rank[to], *old[to][2:])
                continue
            _, _, rows, audit, digest, lines = old[last]
            digest = digest.copy()
            self._add(digest, lines, BETWEEN[last, to], (role if to == initial else NAMES[to]) + b":" + text)
            self.states[to] = (price, rank[to], self.rows + 1, (audit, self.rows - rows, suffix), digest, True)

    @staticmethod
    def _add(digest, lines: bool, inserts: bytes, line: bytes | None = None) -> None:
        added = [NAMES[inserts[i : i + 1]] + b":" for i in range(len(inserts))] + ([] if line is None else [line])
        if added:
            digest.update((b"\n" if lines else b"") + b"\n".join(added))

    def end(self) -> tuple[list[int], str, str]:
        """The counts, the audit, and the hash of the repaired lines."""
        last = min(self.states, key=lambda x: (self.states[x][0] + INSERT * len(BETWEEN[x, None]), self.states[x][1]))
        price, _, rows, audit, digest, lines = self.states[last]
        inserts = BETWEEN[last, None]
        self._add(digest, lines, inserts)
        parts = [b"D" * (self.rows - rows) + b"I" * len(inserts)]
        while audit is not None:
            audit, gone, suffix = audit
            parts.append(b"D" * gone + suffix)
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, (1 << 63) - 1)
        counts = [gaps, self.blank, self.duplicate, self.truncated, self.illegal, price + DELETE * self.rows + INSERT * len(inserts)]
        return counts, b"".join(reversed(parts)).decode(), digest.hexdigest()


def _binary(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, done, held = [], [], 0
    now, key, kind = None, None, None

    def out() -> pa.RecordBatch:
        cells = [pa.array([d[0][i] for d in done], pa.int64()) for i in range(len(COUNTS))]
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), *cells, *[pa.array([d[i] for d in done], pa.string()) for i in (1, 2)]], names=["__key", *COUNTS, "audit", "repaired_sha256"])

    for batch in batches:
        kind = batch.column(0).type
        for k, turn, role, text, present in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _binary(batch.column(2)), _binary(batch.column(3)), batch.column(4).to_pylist(), strict=True):
            if now is None or k != key:
                if now is not None:
                    keys.append(key)
                    done.append(now.end())
                    held += len(done[-1][1])
                    if len(keys) >= BATCH or held > AUDIT_BYTES:
                        yield out()
                        keys, done, held = [], [], 0
                now, key = Repair(), k
            if present:
                now.take(turn, role, text)
    if now is not None:
        keys.append(key)
        done.append(now.end())
        yield out()


def _ordered(rows: DataFrame, *more: str) -> DataFrame:
    """Each conversation's rows together and in order."""
    return rows.repartition("__key").sortWithinPartitions("__key", *more, F.col("__turn").asc_nulls_first(), "__role", "__text")


def _named(rows: DataFrame, key: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    shown = [F.coalesce(F.col(c), F.lit(" ")) for c in (role, text)]
    present = F.col(present) if present else F.lit(True)
    return rows.select(F.col(key).alias("__key"), F.col(turn).cast("long").alias("__turn"), shown[0].alias("__role"), F.when(present, shown[1]).otherwise("").alias("__text"), present.alias("__present"))


def plan_repairs(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """key, the counts, cost, audit, repaired_sha256: one row a conversation. present: a boolean column, false for rows that only tell their key."""
    prepare(rows.sparkSession)
    named = _named(rows, key, turn, role, text, present)
    made = f"__key {named.dtypes[0][1]}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    return _ordered(named).mapInArrow(_plans, made).withColumnRenamed("__key", key)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each conversation's audit before them, to the repaired turns. The conversation ends with the rows or with the next audit."""
    kind, out = None, []
    key, audit, at, place, last = None, b"", 0, 0, b""

    def inserted() -> None:
        nonlocal at, place, last
        while audit[at : at + 1] == b"I":
            role = b"u" if last != b"u" else b"a"
            out.append((key, place, "I", None, NAMES[role].decode(), ""))
            at, place, last = at + 1, place + 1, role

    for batch in batches:
        kind = batch.column(0).type
        for k, turn, role, text, present, head in zip(*[batch.column(i).to_pylist() for i in (0, 1)], *[_binary(batch.column(i)) for i in (2, 3)], *[batch.column(i).to_pylist() for i in (4, 5)], strict=True):
            if head == 0:
                key, audit, at, place, last = k, text, 0, 0, b""
                inserted()
            elif present:
                edit = audit[at : at + 1]
                at += 1
                if edit != b"D":
                    to = role[:1] if edit == b"K" else b"u" if last != b"u" else b"a"
                    out.append((key, place, edit.decode(), turn, (role if edit == b"K" else NAMES[to]).decode(), text.decode()))
                    place, last = place + 1, to
                inserted()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["__key", "place", "edit", "turn", "role", "text"])
            out = []


def repaired_turns(rows: DataFrame, plans: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """key, place (from 0), edit (K, R or I), turn (null where inserted), role, text: the turns that the audits of plan_repairs() leave."""
    prepare(rows.sparkSession)
    named = _named(rows, key, turn, role, text, present).withColumn("__head", F.lit(1))
    heads = plans.select(F.col(key).alias("__key"), F.lit(None).cast("long").alias("__turn"), F.lit("").alias("__role"), F.col("audit").alias("__text"), F.lit(True).alias("__present"), F.lit(0).alias("__head"))
    made = f"__key {named.dtypes[0][1]}, place long, edit string, turn long, role string, text string"
    return _ordered(heads.unionByName(named), "__head").mapInArrow(_applied, made).withColumnRenamed("__key", key)
