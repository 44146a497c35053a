"""Newest-version selection with map-side combining."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The hybrid timestamp, compared in this order; a null counts as lowest.
HYBRID = ("ts_seconds", "ts_nanos", "ts_logical")


def order_of(columns: Sequence[str]) -> Column:
    """One comparable value of several columns, compared left to right, nulls lowest."""
    return F.struct(*(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(columns)))


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None, oldest: bool = False) -> DataFrame:
    """The newest (or oldest) row of each key, one row a key.

    An aggregate, not a window: each task reduces its rows to one a key before the shuffle, so
    a key that holds a third of all rows costs no task more than the others. Null keys form a
    group of their own. Ties in ``order`` are broken by the kept columns' values, greatest
    first, so the result does not depend on the order of rows. Kept columns of map type can't
    be compared and are not supported.
    """
    keys, keep = list(keys), [c for c in (keep if keep is not None else df.columns) if c not in keys]
    row = F.struct(order_of(order).alias("order"), F.struct(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), F.lit(0).alias("end")).alias("row"))
    best = df.groupBy(*(F.col(f"`{c}`") for c in keys)).agg((F.min if oldest else F.max)(row).alias("__best"))
    return best.select(*(F.col(f"`{c}`") for c in keys), *(F.col(f"__best.row.k{i}").alias(c) for i, c in enumerate(keep)))
