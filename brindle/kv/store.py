"""Operators on versioned rows: keys, a comparable time, a value and tombstones.

A table of versions is a DataFrame with key columns, order columns (time and, for rows at the
same time, the order in which they were appended) and a value; a null ``alive`` flag or False
is a tombstone. Reads at a time see the newest version not after it; the last appended wins a
tie. Filters on keys and times reach the scan; the newest version is a map-side combined
aggregate, never a window over a key's versions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.operators.relational import asof_join, range_join
from brindle.operators.skew import Line, lookup_join, running_sum
from brindle.operators.versions import newest
from brindle.sources.shared import work_dir


@dataclass(frozen=True)
class Layout:
    """Which columns of a table of versions are what."""

    key: str = "key"
    order: Sequence[str] = ("ts_seconds", "ts_nanos", "ts_logical", "append_seq")
    value: Sequence[str] = ("kind", "v_int", "v_float", "v_bytes", "v_string")
    alive: str = "alive"

    @property
    def time(self) -> str:
        return self.order[0]


@dataclass(frozen=True)
class VersionedStore:
    """Reads, conditional writes and validations over one table of versions."""

    versions: DataFrame
    layout: Layout = field(default_factory=Layout)

    def _visible(self, as_of: Column | None) -> DataFrame:
        return self.versions if as_of is None else self.versions.where(F.col(self.layout.time) <= as_of)

    def latest(self, as_of: Column | None = None) -> DataFrame:
        """The newest version of each key, tombstones included."""
        at = self.layout
        return newest(self._visible(as_of), [at.key], list(at.order), [*at.order, at.alive, *at.value])

    def snapshot(self, as_of: Column | None = None) -> DataFrame:
        """The live keys with their newest values."""
        return self.latest(as_of).where(F.coalesce(F.col(self.layout.alive), F.lit(False)))

    def get(self, keys: Sequence, as_of: Column | None = None) -> DataFrame:
        """The live values of some keys; the keys are a filter on the scan."""
        return VersionedStore(self.versions.where(F.col(self.layout.key).isin(list(keys))), self.layout).snapshot(as_of)

    def find(self, key, as_of: Column | None = None) -> DataFrame:
        """The smallest key from ``key`` on with a version; a tombstone counts and has no value."""
        at = self.layout
        found = VersionedStore(self.versions.where(F.col(at.key) >= F.lit(key)), at).latest(as_of).orderBy(at.key).limit(1)
        return found.select(at.key, *at.order, at.alive, *(F.when(F.col(at.alive), F.col(v)).alias(v) for v in at.value))

    def find_each(self, wanted: DataFrame, key: str, as_of: Column | None = None) -> DataFrame:
        """``find`` for each row of ``wanted``: one line of both, read from its end.

        A key that is asked for often is on the line once. The line is ranged over tasks and
        written, so that each task's number means the same range wherever it is read; each
        task's first key is carried into the one before it. Null finds nothing.
        """
        at, spark = self.layout, wanted.sparkSession
        have = self.latest(as_of).select(F.col(at.key).alias("__k")).withColumn("__side", F.lit(1)).withColumn("__hit", F.col("__k"))
        ask = wanted.select(F.col(key).cast(have.schema["__k"].dataType).alias("__k")).where(F.col("__k").isNotNull()).distinct().withColumn("__side", F.lit(0)).withColumn("__hit", F.lit(None).cast(have.schema["__hit"].dataType))
        path = work_dir(spark, "find")
        have.unionByName(ask).repartitionByRange("__k").withColumn("__p", F.spark_partition_id()).write.parquet(path)
        line = spark.read.parquet(path)
        inside = W.partitionBy("__p").orderBy(F.col("__k").desc(), F.col("__side").desc()).rowsBetween(W.unboundedPreceding, 0)
        near = line.withColumn("__near", F.last("__hit", ignorenulls=True).over(inside))
        firsts = line.groupBy("__p").agg(F.min("__hit").alias("__first"))
        # one row a task
        carry = firsts.withColumn("__next", F.min("__first").over(W.orderBy(F.col("__p").desc()).rowsBetween(W.unboundedPreceding, -1))).select("__p", "__next")
        found = near.where("__side = 0").join(F.broadcast(carry), "__p", "left").select(F.col("__k").alias(key), F.coalesce("__near", "__next").alias("found"))
        return lookup_join(wanted.select(key), found, [key])

    def scan(self, start, end, limit: int = 0, as_of: Column | None = None) -> DataFrame:
        """Live rows with start <= key < end in order; ``limit`` 0 is no limit."""
        at = self.layout
        rows = VersionedStore(self.versions.where((F.col(at.key) >= F.lit(start)) & (F.col(at.key) < F.lit(end))), at).snapshot(as_of).orderBy(at.key)
        return rows.limit(limit) if limit else rows

    def scan_page(self, start, end, limit: int, as_of: Column | None = None) -> tuple[DataFrame, object]:
        """A page and the key to go on from: the last key's successor, None at the end."""
        at = self.layout
        page = self.scan(start, end, limit, as_of)
        if not limit:
            return page, None
        last = [r[0] for r in page.select(at.key).collect()]  # at most ``limit`` keys
        if len(last) < limit:
            return page, None
        key = last[-1]
        after = key + 1 if isinstance(key, int) else key + "\0" if isinstance(key, str) else bytes(key) + b"\0"
        more = self.scan(after, end, 1, as_of).count()
        return page, after if more else None

    def put(self, writes: DataFrame, expect: str | None = None) -> DataFrame:
        """What each conditional write gives: ``applied`` and the newest time before it.

        ``expect`` names a column with the expected newest time: null always applies, 0 only
        if the key is absent or a tombstone, else only if that is the newest time. A write
        below the newest time never applies; equal times may.
        """
        at = self.layout
        now = self.latest().select(F.col(at.key).alias("__key"), F.col(at.time).alias("__newest"), F.coalesce(F.col(at.alive), F.lit(False)).alias("__alive"))
        both = writes.join(now, F.col(at.key) == F.col("__key"), "left")
        seen = F.when(F.coalesce("__alive", F.lit(False)), F.col("__newest"))
        ok = F.col("__newest").isNull() | (F.col(at.time) >= F.col("__newest"))
        if expect:
            e = F.col(expect)
            zero = (e == F.lit(0).cast(writes.schema[expect].dataType)) if writes.schema[expect].dataType.typeName() != "timestamp_ntz" else F.lit(False)
            ok = ok & (e.isNull() | F.when(zero, seen.isNull()).otherwise(seen.eqNullSafe(e)))
        return both.withColumn("applied", F.coalesce(ok, F.lit(False))).withColumn("newest_before", seen).drop("__key", "__newest", "__alive")

    def put_if_absent(self, writes: DataFrame, order: Sequence[str] = ()) -> DataFrame:
        """``put`` that expects no live version: ``applied`` is true for absent keys.

        Of several writes of a key in one batch the first in ``order`` is applied (by all
        columns' values, where that leaves ties), the others find its version. The first is a
        minimum combined before the shuffle; only equal firsts are numbered.
        """
        at = self.layout
        rank = F.struct(*(F.col(f"`{c}`") for c in [*order, *(c for c in writes.columns if c not in order)])).alias("__rank")
        live = self.snapshot().select(F.col(at.key).alias("__key"), F.lit(True).alias("__there"))
        first = writes.groupBy(F.col(at.key).alias("__key")).agg(F.min(rank).alias("__first"), F.min(F.lit(0)).alias("__n")).join(live, "__key", "left").select(F.col("__key").alias(at.key), "__first", F.col("__there").isNull().alias("__free"))
        # null keys find no row here and are never applied
        both = lookup_join(writes.withColumn("__rank", rank), first, [at.key])
        leads = F.coalesce(F.col("__free") & (F.col("__rank") == F.col("__first")), F.lit(False))
        once = F.row_number().over(W.partitionBy(at.key).orderBy("__rank")) == 1
        won = both.where(leads).withColumn("applied", once)
        return won.unionByName(both.where(~leads).withColumn("applied", F.lit(False))).select(*writes.columns, "applied")

    def increment(self, deltas: DataFrame, delta: str, order: Sequence[str]) -> DataFrame:
        """The value after each increment, in order, on top of the newest whole number.

        An absent or deleted key is 0. A newest value that is no whole number is an error.
        """
        at = self.layout
        base = self.snapshot().select(F.col(at.key).alias("__key"), F.col("v_int").alias("__base"))
        joined = lookup_join(deltas, base.withColumn(at.key, F.col("__key")), [at.key])
        wrong = F.raise_error(F.lit("increment of a value that is no whole number")).cast("bigint")
        began = F.when(F.col("__key").isNotNull() & F.col("__base").isNull(), wrong).otherwise(F.coalesce("__base", F.lit(0)))
        return running_sum(joined, [at.key], order, delta, "__sum").withColumn("value_after", began + F.col("__sum")).drop("__key", "__base", "__sum")

    def refresh_read(self, spans: DataFrame, start: str, end: str, since: str, upto: str, width: int) -> DataFrame:
        """Adds ``fresh``: whether no version in the span is newer than ``since`` (up to ``upto``).

        Numeric keys; spans are found by bins of ``width``, so no span is compared with all keys.
        """
        at = self.layout
        spans = spans.withColumn("__span", F.monotonically_increasing_id())
        rows = self.versions.select(F.col(at.key).alias("__key"), F.col(at.time).alias("__time"))
        hits = range_join(rows, spans, "__key", start, end, width).where((F.col("__time") > F.col(since)) & (F.col("__time") <= F.col(upto)))
        stale = hits.select("__span").distinct().withColumn("__stale", F.lit(True))
        return spans.join(stale, "__span", "left").withColumn("fresh", F.col("__stale").isNull()).drop("__span", "__stale")


def batch(operations: DataFrame, base: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The answer of each operation of an ordered list, each seeing the writes before it.

    ``operations``: key, seq, op (get, put, delete, increment), operand bigint. ``base``: key,
    v_int, the values before. A put or delete starts a new run of its key; within a run an
    increment adds to what the run began with, so all answers are running sums along a line cut
    into ranges: a hot key is many tasks' work, and no row is handled by Python. Adds ``answer``: the value read or written, null for none.
    """
    line = Line(operations, [key], [seq])
    runs = line.running(line.rows, F.col("op").isin("put", "delete").cast("long"), "sum", "__run")
    runs = line.running(runs, F.when(F.col("op") == "increment", F.col("operand")), "sum", "__added", keys=[key, "__run"])
    # read twice below
    path = work_dir(operations.sparkSession, "runs")
    runs.write.parquet(path)
    runs = operations.sparkSession.read.parquet(path)
    began = runs.where(F.col("op") == "put").select(key, "__run", F.col("operand").alias("__origin"))
    joined = lookup_join(lookup_join(runs, began, [key, "__run"]), base.select(key, F.col("v_int").alias("__base")), [key])
    origin = F.when(F.col("__run") == 0, F.col("__base")).otherwise(F.col("__origin"))
    answer = F.when(F.col("op") == "delete", F.lit(None).cast("bigint")).otherwise(F.when(F.col("__added").isNull(), origin).otherwise(F.coalesce(origin, F.lit(0)) + F.col("__added")))
    return joined.withColumn("answer", answer).select(*operations.columns, "answer")


def read_your_writes(committed: DataFrame, intents: DataFrame, reads: DataFrame, key: str = "key") -> DataFrame:
    """What each read (key, txn_id, sequence) sees: its own newest write up to its sequence,
    else the committed value. ``committed``: key, value. ``intents``: key, txn_id, sequence,
    value (null deletes)."""
    own = reads.select(key, "txn_id", F.col("sequence").alias("__at")).distinct().join(intents.withColumnRenamed("sequence", "__seq"), [key, "txn_id"]).where(F.col("__seq") <= F.col("__at"))
    last = own.groupBy(key, "txn_id", "__at").agg(F.max(F.struct("__seq", "value")).alias("__own"))
    seen = reads.join(last.withColumnRenamed("__at", "sequence"), [key, "txn_id", "sequence"], "left").join(committed.withColumnRenamed("value", "__committed"), key, "left")
    return seen.select(*reads.columns, F.when(F.col("__own").isNotNull(), F.col("__own.value")).otherwise(F.col("__committed")).alias("value"))


def locate(keys: DataFrame, shards: DataFrame, key: str, start: str, end: str, on: Sequence[str] = ()) -> DataFrame:
    """Each key with its shard: start <= key < end, within ``on``; shards of any width.

    The shard that begins last at or before the key is the only one that can hold it: an as-of
    join, with no bins. Keys outside all shards (or null) have nulls.
    """
    take = [c for c in shards.columns if c not in on and c != start]
    found = asof_join(keys, shards, key, start, list(on), take)
    inside = F.col(key) < F.col(end)
    return found.select(*keys.columns, *(F.when(inside, F.col(c)).alias(c) for c in take))


def locate_server(keys: DataFrame, ranges: DataFrame, shards: DataFrame, tablets: DataFrame, key: str) -> DataFrame:
    """Each key with its range, shard, tablet and servers: three levels, one after another.

    ``ranges``: range_id, s, e. ``shards``: range_id, shard_id, tablet_id, s, e. ``tablets``:
    tablet_id, servers.
    """
    first = locate(keys, ranges.select("range_id", "s", "e"), key, "s", "e").drop("e")
    second = locate(first, shards.select("range_id", "shard_id", "tablet_id", "s", "e"), key, "s", "e", ["range_id"]).drop("e")
    return lookup_join(second, tablets, ["tablet_id"])


def scoped(df: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Rows of keys below ``prefix``, with the prefix stripped; the filter reaches the scan."""
    return df.where(F.col(key).startswith(prefix)).withColumn(key, F.substring(key, len(prefix) + 1, 1 << 30))
