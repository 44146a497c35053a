"""Relational operators that Spark's DataFrame API lacks or that need care at scale."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.operators.skew import Line
from brindle.operators.versions import order_of
from brindle.sources.shared import work_dir


def range_join(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, width: int, on: Sequence[str] = (), how: str = "inner", closed: bool = False) -> DataFrame:
    """Rows of ``points`` with the ``ranges`` that hold ``at``: start <= at < end (<= if closed).

    Both sides are cut into bins of ``width`` (in the unit of the numbers), and joined on bin
    and ``on`` by hash, instead of comparing each point with each range. A range is repeated
    once for each bin it touches: choose a width near the usual range's. ``how`` is inner,
    left, left_semi or left_anti. Nulls match nothing. Columns of both sides must differ,
    apart from ``on``.
    """
    bins = ranges.where(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    bins = bins.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long"))))
    bins = bins.select(*(F.col(c).alias(f"__on_{c}") if c in on else F.col(c) for c in bins.columns))
    left = points.withColumn("__at", F.floor(F.col(at) / width).cast("long"))
    upper = F.col(at) <= F.col(end) if closed else F.col(at) < F.col(end)
    match = (F.col("__at") == F.col("__bin")) & (F.col(at) >= F.col(start)) & upper
    for c in on:
        match = match & (F.col(c) == F.col(f"__on_{c}"))
    return left.join(bins, match, how).drop("__at", "__bin", *(f"__on_{c}" for c in on))


def asof_join(left: DataFrame, right: DataFrame, left_at: str, right_at: str, on: Sequence[str], take: Sequence[str]) -> DataFrame:
    """Each left row with ``take`` of the latest right row of the same ``on`` not after it.

    Both sides are put in one line by key and time, cut into ranges (a hot key is many tasks'
    work), and the last right row so far is carried along. Of right rows at the same time the
    greatest values count. Left rows without a match, key or time get nulls and stay.
    """
    on = list(on)
    newest = right.where(F.col(right_at).isNotNull()).groupBy(*on, right_at).agg(F.max(F.struct(*take)).alias("__take"))
    a = left.select(*on, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(newest.schema["__take"].dataType).alias("__take"))
    b = newest.select(*on, F.col(right_at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), "__take")
    line = Line(a.unionByName(b), on, ["__at", "__side"])
    carried = line.running(line.rows, F.col("__take"), "last", "__last").where("__side = 1")
    whole = F.lit(True)
    for c in on:
        whole = whole & F.col(c).isNotNull()
    return carried.select("__row.*", *(F.when(whole & F.col("__at").isNotNull(), F.col(f"__last.{c}")).alias(c) for c in take))


def groups_frame(df: DataFrame, partition: Sequence[str], order: Column, value: Column, preceding: int, following: int) -> DataFrame:
    """Adds ``value`` (an aggregate) over a frame of peer groups around each row's group."""
    ranked = df.withColumn("__group", F.dense_rank().over(W.partitionBy(*partition).orderBy(order)))
    frame = W.partitionBy(*partition).orderBy("__group").rangeBetween(-preceding, following)
    return ranked.withColumn("value", value.over(frame)).drop("__group")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The ``n`` greatest rows of each key; Spark keeps n a task and key before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order)))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def _joined(line: Line, rows: DataFrame, fresh: Column, start: str, end: str, keep: Sequence[Column] = ()) -> DataFrame:
    """One row per run of rows of a line, a run beginning at each ``fresh`` row."""
    numbered = line.running(rows, F.when(fresh, 1).otherwise(0), "sum", "__island")
    return numbered.groupBy(*line.keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), *keep).drop("__island")


def merge_spans(spans: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Disjoint half-open spans that cover the same points; touching spans become one."""
    line = Line(spans.where(F.col(start) < F.col(end)).select(*keys, start, end), keys, [start, end])
    rows = line.running(line.rows, F.col(end), "max", "__before", inclusive=False)
    return _joined(line, rows, ~F.coalesce(F.col(start) <= F.col("__before"), F.lit(False)), start, end)


def split_spans(spans: DataFrame, keys: Sequence[str], start: str, end: str, stamp: Sequence[str]) -> DataFrame:
    """Disjoint spans, each with the greatest ``stamp`` of the spans that cover it.

    A key's line is cut at every start and end and its pieces are numbered. Numbers stand in a
    binary tree: a span covers whole subtrees, at most two a level, and a piece lies in one
    subtree of each level. So n spans meet their pieces in about n log n rows joined by equal
    subtrees, however many spans cover a piece and however many pieces a span covers.
    Neighbouring pieces with equal stamps are joined again. No join is left to a broadcast:
    Spark's estimate of a side leaves out that its rows are repeated once a level.
    """
    keys = list(keys)
    good = spans.where(F.col(start) < F.col(end)).select(*keys, F.col(start).alias("s"), F.col(end).alias("e"), order_of(stamp).alias("stamp"))
    cuts = Line(good.select(*keys, F.explode(F.array("s", "e")).alias("at")).distinct(), keys, ["at"])
    numbered_at = work_dir(spans.sparkSession, "cuts")
    cuts.running(cuts.rows, F.lit(1).cast("long"), "sum", "__n").write.parquet(numbered_at)
    numbered = spans.sparkSession.read.parquet(numbered_at)
    levels = max(1, int(numbered.agg(F.max("__n")).first()[0] or 1).bit_length())

    def place(df: DataFrame, at: str, name: str) -> DataFrame:
        there = numbered.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), F.col("at").alias("__at"), F.col("__n").alias(name))
        on = F.col(at) == F.col("__at")
        for i, k in enumerate(keys):
            on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
        return df.join(there.hint("merge"), on).drop("__at", *(f"__k{i}" for i in range(len(keys))))

    # one row per pair of bounds, with its greatest stamp
    bounds = place(place(good.groupBy(*keys, "s", "e").agg(F.max("stamp").alias("stamp")), "s", "__a"), "e", "__b")
    level = bounds.select(*keys, "stamp", "__a", "__b", F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("__l"))
    low, high = "shiftright(__a + shiftleft(1L, __l) - 1, __l)", "shiftright(__b, __l)"
    ends = level.selectExpr(*(f"`{k}`" for k in keys), "stamp", "__l", f"filter(array(if({low} & 1 = 1, {low}, NULL), if({high} & 1 = 1, {high} - 1, NULL)), x -> x IS NOT NULL AND {low} < {high}) AS __nodes")
    nodes = ends.select(*keys, "__l", F.explode("__nodes").alias("__i"), "stamp").groupBy(*keys, "__l", "__i").agg(F.max("stamp").alias("stamp"))
    pieces = numbered.select(*keys, "at", F.col("__n").alias("__i0"), F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("__l")).withColumn("__i", F.expr("shiftright(__i0, __l)"))
    on = (F.col("__l") == F.col("__nl")) & (F.col("__i") == F.col("__ni"))
    for i, k in enumerate(keys):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    named = nodes.select(*(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__l").alias("__nl"), F.col("__i").alias("__ni"), "stamp")
    held = pieces.join(named.hint("merge"), on).groupBy(*keys, "at", "__i0").agg(F.max("stamp").alias("stamp"))
    follows = numbered.select(*keys, F.col("at").alias("to"), (F.col("__n") - 1).alias("__j"))
    same = F.col("__i0") == F.col("__j")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    after = follows.select("to", "__j", *(F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)))
    whole = held.join(after.hint("merge"), same).select(*keys, "at", "to", "stamp")
    line = Line(whole, keys, ["at"])
    rows = line.running(line.rows, F.struct("to", "stamp"), "last", "__before", inclusive=False)
    goes_on = F.coalesce((F.col("__before.to") == F.col("at")) & F.col("__before.stamp").eqNullSafe(F.col("stamp")), F.lit(False))
    out = _joined(line, rows, ~goes_on, "at", "to", [F.max("stamp").alias("stamp")])
    return out.select(*keys, F.col("at").alias(start), F.col("to").alias(end), *(F.col(f"stamp.o{i}").alias(c) for i, c in enumerate(stamp)))
