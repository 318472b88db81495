"""Whitening of embeddings by an exact scatter matrix in residue numbers.

An entry c becomes the whole number x = floor(1024 c) + 100000. Every task multiplies its block of whole numbers (less the common 100000, with a column of ones beside them) by its own
transpose modulo several primes; a product of at most BLOCK rows of residues below 2^19 in size stays within 2^53, so doubles hold it exactly. Residues are summed by prime and panel of
rows of the matrix, first within salted groups, then over them, and the Chinese remainder theorem turns the sums into the exact count, sums and scatter. The covariance
(n times the scatter less the products of the sums, over n^2) is rounded once, and a double eigendecomposition gives the components by falling eigenvalue.

What comes to the driver is one matrix of the vectors' dimension for each prime, whatever the number of rows. There are as many primes as the count of rows and
the largest entry ask for, which a first pass finds.

Rows whose vector is null, or holds a null, a NaN, an infinite entry, or one past 2^52 / 1024, are left out; so are rows of another length than the commonest (of equals the longer), and
empty vectors. Repeated rows and rows without a key count as often as they stand. Where an eigenvalue is zero up to rounding, whitened is null, and so is explained where all are.
A deviation beyond 63 bits is null. An empty table gives an empty result. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import prod
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import durable, prepare

SCALE, SHIFT = 1024, 100_000
#: Entries, as whole numbers, are below this in size.
LARGEST = 1 << 52
#: Rows of one exact product: BLOCK * (2^19)^2 = 2^53.
BLOCK = 1 << 15
#: Rows of the matrix that travel together, and groups of tasks whose residues are summed first.
PANEL, SALTS = 64, 64


def primes(count: int, below: int = 1 << 20) -> list[int]:
    """The largest primes below a bound, falling."""
    sieve = np.ones(below, bool)
    sieve[:2] = False
    for i in range(2, int(below**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    return [int(p) for p in np.flatnonzero(sieve)[::-1][:count]]


def primes_for(rows: int, largest: int) -> list[int]:
    """As many as tell all whole numbers apart that a product of `rows` rows of entries up to `largest` can be."""
    chosen = primes(16)
    need = 2 * max(1, rows) * max(1, largest) ** 2 + 1
    for k in range(1, len(chosen) + 1):
        if prod(chosen[:k]) >= need:
            return chosen[:k]
    raise ValueError("more rows than sixteen primes can count")


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 c): x less the shift."""
    return np.floor(vectors.astype(np.float64) * SCALE).astype(np.int64)


def residue_scatter(x: np.ndarray, p: int) -> np.ndarray:
    """x' x modulo p, exactly: residues are between -p/2 and p/2."""
    out = np.zeros((x.shape[1], x.shape[1]), np.int64)
    for i in range(0, len(x), BLOCK):
        r = x[i : i + BLOCK] % p
        r = np.where(r > p // 2, r - p, r).astype(np.float64)
        out = (out + (r.T @ r).astype(np.int64)) % p
    return out


def rebuilt(residues: list[np.ndarray], chosen: list[int]) -> np.ndarray:
    """The whole numbers, of either sign, with these residues."""
    total = prod(chosen)
    out = np.zeros(residues[0].shape, object)
    for r, p in zip(residues, chosen, strict=True):
        rest = total // p
        out = out + r.astype(object) * (rest * pow(rest, -1, p))
    out = out % total
    return np.where(out > total // 2, out - total, out)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _scatter(dimension: int, chosen: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, rows = None, [], 0

        def add() -> None:
            nonlocal sums, held, rows
            x = np.concatenate(held)
            x = np.hstack([np.ones((len(x), 1), np.int64), x])
            made = [residue_scatter(x, p) for p in chosen]
            sums = made if sums is None else [(a + b) % p for a, b, p in zip(sums, made, chosen, strict=True)]
            held, rows = [], 0

        for batch in batches:
            if batch.num_rows:
                held.append(whole(_matrix(batch.column(0), dimension)))
                rows += batch.num_rows
                if rows * dimension >= 1 << 21:
                    add()
        if held:
            add()
        salt = TaskContext.get().partitionId() % SALTS
        for p, matrix in zip(chosen, sums or [], strict=False):
            for at in range(0, len(matrix), PANEL):
                yield pa.RecordBatch.from_arrays([pa.array([salt], pa.int32()), pa.array([p], pa.int64()), pa.array([at], pa.int32()), pa.array([matrix[at : at + PANEL].tobytes()], pa.binary())], names=["salt", "prime", "at", "residues"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One panel's residues added up as they come."""
    total, one = None, None
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1) if one is None else one
            p = batch.column(1)[row].as_py()
            part = np.frombuffer(batch.column(3)[row].as_py(), np.int64)
            total = part % p if total is None else (total + part) % p
    if one is not None:
        yield pa.RecordBatch.from_arrays([*[one.column(i) for i in range(3)], pa.array([total.tobytes()], pa.binary())], names=["salt", "prime", "at", "residues"])


class Fit(NamedTuple):
    n: int
    largest: int
    sums: np.ndarray  # of x less the shift, whole numbers without bound
    covariance: np.ndarray
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a component a column


def finite(vector: str) -> F.Column:
    """A vector of finite entries within the bound. A null entry makes the inner test null, which counts as false."""
    bound = float(LARGEST // SCALE)
    return F.coalesce(F.forall(F.col(vector), lambda c: F.coalesce(F.abs(c.cast("double")) < bound, F.lit(False)) & ~F.isnan(c.cast("double"))), F.lit(False)) & (F.size(vector) > 0)


def usable(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, int, int]:
    """(__key, __vector) of the rows that count, their number, dimension, and a bound of their whole entries."""
    kept = rows.select(F.col(key).alias("__key"), F.col(vector).alias("__vector")).where(finite("__vector"))
    top = F.array_max(F.transform("__vector", lambda c: F.abs(c.cast("double"))))
    found = kept.groupBy(F.size("__vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(top).alias("top")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not found:
        return kept, 0, 0, 0
    d, n, largest = found[0]
    return kept.where(F.size("__vector") == d), n, d, int(largest * SCALE) + 1


def exact_scatter(kept: DataFrame, n: int, d: int, largest: int) -> np.ndarray:
    """The scatter of (1, x less the shift), (d + 1) by (d + 1), in whole numbers."""
    chosen = primes_for(n, largest)
    made = "salt int, prime long, at int, residues binary"
    parts = kept.select("__vector").mapInArrow(_scatter(d, chosen), made)
    for group in (["prime", "at", "salt"], ["prime", "at"]):
        parts = parts.groupBy(*group).applyInArrow(_summed, made)
    panels = {(r["prime"], r["at"]): np.frombuffer(r["residues"], np.int64).reshape(-1, d + 1) for r in parts.collect()}  # (d + 1)^2 numbers a prime
    return rebuilt([np.vstack([panels[p, at] for at in range(0, d + 1, PANEL)]) for p in chosen], chosen)


def fit(scatter: np.ndarray, largest: int) -> Fit:
    n, sums = int(scatter[0, 0]), scatter[0, 1:]
    exact = n * scatter[1:, 1:] - np.outer(sums, sums)
    covariance = np.array([[v / (n * n) for v in row] for row in exact])  # one rounding each
    values, vectors = np.linalg.eigh(covariance)
    return Fit(n, largest, sums, covariance, values[::-1].copy(), vectors[:, ::-1].copy())


def residuals(x: np.ndarray, n: int, sums: np.ndarray, largest: int) -> tuple[np.ndarray, list[int | None]]:
    """n x - S as doubles, and by row the sum of its squares, exactly (null beyond 63 bits)."""
    if 2 * n * largest < 1 << 62:
        r = n * x - sums.astype(np.int64)
        if len(r) and float(np.square(r.astype(np.float64)).sum(axis=1).max()) < 2.0**62:
            return r.astype(np.float64), np.square(r).sum(axis=1).tolist()
        r = r.astype(object)
    else:
        r = n * x.astype(object) - sums
    squares = [int(v) for v in (r * r).sum(axis=1)]
    return r.astype(np.float64), [v if v < 1 << 63 else None for v in squares]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable row and component."""
    spark = prepare(rows.sparkSession)
    kept, n, d, largest = usable(rows, key, vector)
    kind = kept.dtypes[0][1]
    if not n:
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    model = fit(exact_scatter(kept, n, d, largest), largest)
    top = min(components, d)
    trace = float(np.trace(model.covariance))
    least = max(model.values[0], 0.0) * d * np.finfo(float).eps
    real = [bool(model.values[j] > least) for j in range(top)]
    weights = np.array([model.vectors[:, j] / np.sqrt(model.values[j]) if real[j] else np.zeros(d) for j in range(top)]).T
    sent = spark.sparkContext.broadcast((model.sums, weights))  # d numbers a component

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, weights = sent.value
        for batch in batches:
            if batch.num_rows:
                r, squares = residuals(whole(_matrix(batch.column(1), d)), n, sums, largest)
                made = (r / n) @ weights
                cells = [pa.array(made[:, j]) if real[j] else pa.nulls(len(made), pa.float64()) for j in range(top)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(squares, pa.int64()), *cells], names=["__key", "deviation", *[f"w{j}" for j in range(top)]])

    made = kept.mapInArrow(run, f"__key {kind}, deviation long, " + ", ".join(f"w{j} double" for j in range(top)))
    made = durable(made, "whitened")
    pairs = [(i, j) for i in range(top) for j in range(i, top) if real[i] and real[j]]
    found = made.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first() if pairs else []
    error = max((abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True)), default=None)
    shares = [F.lit(float(max(model.values[j], 0.0) / trace) if trace > 0 else None).cast("double") for j in range(top)]
    each = F.explode(F.array(*[F.struct(F.lit(j + 1).alias("component"), F.col(f"w{j}").alias("whitened"), shares[j].alias("explained")) for j in range(top)]))
    out = made.select("__key", "deviation", each.alias("c"))
    return out.select(F.col("__key").alias(key), F.col("c.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
