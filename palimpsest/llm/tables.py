"""Joins whose plan depends on a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a narrow side is sent to every executor.
SMALL_ROWS = 500_000


def is_small(side: DataFrame, most: int = SMALL_ROWS) -> bool:
    """Counts at most `most` + 1 rows."""
    return side.limit(most + 1).count() <= most


def join_sized(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner", most: int = SMALL_ROWS) -> DataFrame:
    """Broadcast right where its row count is within `most`; else a shuffled join, whose skewed keys AQE splits.

    right: a written table of a few numbers a row, as it is counted first and read again.
    """
    return left.join(F.broadcast(right) if is_small(right, most) else right.hint("merge"), on, how)
