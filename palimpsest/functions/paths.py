"""String expressions on file paths and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def modality(path: Column) -> Column:
    """The folders between the first one and the last two parts of a path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 3, F.lit(0))), "/")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def padded(number: Column, width: int) -> Column:
    return F.format_string(f"%0{width}d", number)


def numbers(text: Column, separator: str = ",") -> Column:
    """A list of integers in a string; what is no integer is left out."""
    return F.filter(F.transform(F.split(text, separator), lambda s: F.trim(s).try_cast("int")), lambda x: x.isNotNull())


def letter(number: Column) -> Column:
    """A, B, ... for 1, 2, ..."""
    return F.chr(64 + number)


def rolling_hash(text: Column, times: int, start: int) -> Column:
    """h = h * times + code, in 32 bits, over the characters: djb2 with (33, 5381), sdbm with (65599, 0)."""
    return F.aggregate(F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long")), F.lit(start).cast("long"), lambda h, c: (h * times + c).bitwiseAND((1 << 32) - 1))
