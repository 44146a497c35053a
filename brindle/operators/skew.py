"""Joins whose small side has a checked size, and salted ones for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.sources.shared import work_dir

#: A broadcast side has at most so many rows and so many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def _bytes(column: Column, kind: T.DataType) -> Column:
    """About the bytes of a value; texts and collections are measured."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType | T.VariantType):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column.alias("v")))), F.lit(0)) + 16
    return F.lit(8)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most so many rows and bytes; reads no more rows than it must."""
    few = df.limit(max_rows + 1)
    size = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0))
    n, total = few.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return n <= max_rows and (total or 0) <= max_bytes


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Joins ``small`` (unique in ``on``) to ``big`` whatever the skew of ``big``.

    Up to ``max_rows`` rows the small side is broadcast, so ``big`` is not shuffled. Beyond
    that, ``big`` gets a random salt and ``small`` one row per salt, so a key that holds a
    third of ``big`` is spread over ``salts`` tasks. Nulls in ``on`` match nothing. The repeated
    rows are never broadcast: Spark's estimate leaves the repetition out.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join keeps the big side; {how} does not")
    if fits_broadcast(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    salt = "__salt"
    salted = small.withColumn(salt, F.explode(F.array(*(F.lit(i) for i in range(salts)))))
    row_hash = F.xxhash64(*(F.col(f"`{c}`") for c, kind in big.dtypes if not kind.startswith("map")))
    return big.withColumn(salt, F.pmod(row_hash, F.lit(salts)).cast("int")).join(salted.hint("merge"), [*on, salt], how).drop(salt)


class Line:
    """Rows in the order of ``keys`` and then ``order``, cut into ranges of about equal size.

    The ranges are cut by sampled bounds, whatever the unit of the order, and written once with
    their number ``__p``, so that a number means the same range wherever it is read. Anything
    that runs along a line is computed within the ranges, and what lies before a range comes
    from one row a range and key. So a key with a third of all rows, or no key at all, is the
    work of many tasks. Rows that are equal in keys and order share a range and have no order
    between them. Nulls in ``order`` come first.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str]):
        self.keys, self.order = list(keys), list(order)
        path = work_dir(df.sparkSession, "line")
        ranged = df.repartitionByRange(*(F.col(f"`{c}`") for c in [*self.keys, *self.order]))
        ranged.withColumn("__p", F.spark_partition_id()).write.parquet(path)
        self.rows = df.sparkSession.read.parquet(path)

    def running(self, rows: DataFrame, value: Column, how: str, name: str, keys: Sequence[str] | None = None, inclusive: bool = True) -> DataFrame:
        """``rows`` (this line's, with ``__p``) and ``name``: ``value`` so far along the line.

        ``how`` is sum, max or last (nulls are passed over by all three). Not ``inclusive`` means
        the rows before each one only. ``keys`` may be more columns than the line's, if the
        line keeps rows of equal values of them together.
        """
        keys = self.keys if keys is None else list(keys)
        merge = {"sum": F.sum, "max": F.max, "last": lambda c: F.last(c, ignorenulls=True)}[how]
        here = rows.withColumn("__v", value)
        by = W.partitionBy("__p", *keys).orderBy(*(F.col(f"`{c}`") for c in self.order)).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        at = F.struct(*(F.col(f"`{c}`") for c in self.order), F.lit(0).alias("__end"))
        whole = F.max_by("__v", F.when(F.col("__v").isNotNull(), at)) if how == "last" else merge(F.col("__v"))
        ends = here.groupBy("__p", *keys).agg(whole.alias("__t"))
        before = W.partitionBy(*keys).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
        # one row a range and key
        carry = ends.select(F.col("__p").alias("__cp"), *(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), merge(F.col("__t")).over(before).alias("__c"))
        on = F.col("__p") == F.col("__cp")
        for i, k in enumerate(keys):
            on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
        ran = here.withColumn("__in", merge(F.col("__v")).over(by)).join(carry.where(F.col("__c").isNotNull()), on, "left")
        both = {"sum": F.when(F.col("__in").isNull() | F.col("__c").isNull(), F.coalesce("__in", "__c")).otherwise(F.col("__in") + F.col("__c")), "max": F.greatest("__in", "__c"), "last": F.coalesce("__in", "__c")}[how]
        return ran.withColumn(name, both).select(*(F.col(f"`{c}`") for c in rows.columns), name)


def running_max_before(df: DataFrame, keys: list[str], at: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the greatest ``value`` of the rows before each in the line of its keys."""
    line = Line(df, keys, [at])
    return line.running(line.rows, F.col(f"`{value}`"), "max", name, inclusive=False).select(*df.columns, name)


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to each row in the line of its keys."""
    line = Line(df, keys, order)
    return line.running(line.rows, F.col(f"`{value}`"), "sum", name).select(*df.columns, name)
