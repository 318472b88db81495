"""Column expressions over numeric arrays, all inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(a: Column | str) -> Column:
    return F.col(a) if isinstance(a, str) else a


def total(a: Column | str) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column | str) -> Column:
    """The vector by its length; a zero vector stays."""
    size = norm(a)
    return F.when(size > 0, F.transform(_c(a), lambda x: x / size)).otherwise(_c(a))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def quantise(a: Column | str, start: int, end: int, step: float, absolute: bool = False, before: bool = False, after: bool = False) -> Column:
    """Elements [start, end) by step; optionally their absolutes, and floors before or after the division."""

    def one(x: Column, i: Column) -> Column:
        y = F.abs(x) if absolute else x
        y = F.floor(y).cast("double") if before else y
        y = y / step
        y = F.floor(y).cast("double") if after else y
        return F.when((i >= start) & (i < end), y).otherwise(x)

    return F.transform(_c(a), one)


def quotient(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def angular_difference(a: Column | str, b: Column | str) -> Column:
    """Between directions in degrees: 0 to 180."""
    turn = F.pmod(_c(a) - _c(b), F.lit(360))
    return F.least(turn, 360 - turn)


def homogeneous(a: Column | str) -> Column:
    """The vector by its last element where that is finite and not 0."""
    last = F.element_at(_c(a), -1)
    good = (last != 0) & ~F.isnan(last) & (F.abs(last) < float("inf"))
    return F.when(good, F.transform(_c(a), lambda x: x / last)).otherwise(_c(a))


def log_polar_factor(width: Column | str) -> Column:
    """What a log-radius is multiplied by so that the half diagonal of a square comes to its width."""
    return _c(width) / (F.ln(_c(width)) - F.ln(F.lit(2.0)) / 2)
