"""Problem 3: messages delivered more than once.

Identifiers are numbers that a producer counts up, so what was seen is kept as disjoint ranges
per producer: a few rows instead of one a message. A number is accepted once, if no range
covers it; the ranges are then merged. Rows whose identifier has a null can't be placed in a
range and are looked up exactly by a hash key of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.sources.manifest import SnapshotTable

#: Numbers are cut into blocks of 2 to this power, so that no task gets all of a producer.
BLOCK_BITS = 16
BLOCK = 1 << BLOCK_BITS
#: Tables of seen ranges (or hash keys) that may lie beside each other before they are merged.
MERGE_EVERY = 8


def _block(number: str) -> str:
    # a shift is exact for all 64 bits, which a division in DOUBLE is not
    return f"shiftright(CAST({number} AS bigint), {BLOCK_BITS})"


def merge_ranges(ranges: DataFrame, producer: Sequence[str], lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Disjoint ranges that cover the same whole numbers as ``ranges`` (inclusive bounds).

    Touching ranges become one. Each producer's line is cut into blocks that are merged on
    their own; only ranges that reach a block's edge, at most two a block, are stitched over
    blocks. So a producer with a third of all rows is the work of many tasks, even if its
    numbers are all apart. All 64-bit numbers are exact. A range without a bound or with
    ``lo > hi`` is left out.
    """
    keys = _names(producer)
    good = ranges.where(f"`{lo}` <= `{hi}`").selectExpr(*keys, f"CAST(`{lo}` AS bigint) AS lo", f"CAST(`{hi}` AS bigint) AS hi")
    first = f"shiftleft(__b, {BLOCK_BITS})"
    cut = good.selectExpr(*keys, "lo", "hi", f"explode(sequence({_block('lo')}, {_block('hi')})) AS __b")
    cut = cut.selectExpr(*keys, "__b", f"greatest(lo, {first}) AS lo", f"least(hi, {first} | {BLOCK - 1}L) AS hi")
    inside = _islands(cut, [*keys, "__b"])
    # ranges at an edge are stitched by producer, the others stay in their block
    edge = inside.selectExpr(*keys, f"if(lo = {first} OR hi = {first} | {BLOCK - 1}L, NULL, __b) AS __b", "lo", "hi")
    return _islands(edge, [*keys, "__b"]).drop("__b")


def _names(columns: Sequence[str]) -> list[str]:
    return [f"`{c}`" for c in columns]


def _islands(df: DataFrame, keys: list[str]) -> DataFrame:
    by = f"PARTITION BY {', '.join(keys)} ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND"
    before = df.selectExpr(*keys, "lo", "hi", f"max(hi) OVER ({by} 1 PRECEDING) AS __before")
    # a distance beyond 64 bits is null: no touch
    touches = "coalesce(lo <= __before OR try_subtract(lo, __before) <= 1, false)"
    marked = before.selectExpr(*keys, "lo", "hi", f"sum(if({touches}, 0, 1)) OVER ({by} CURRENT ROW) AS __island")
    return marked.groupBy(*keys, "__island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__island")


def covered(rows: DataFrame, ranges: DataFrame, producer: Sequence[str], number: str) -> DataFrame:
    """The rows whose number lies in one of the disjoint ``ranges`` (a semi-join).

    A range is found by equality on (producer, block), one entry for each block that it
    touches, never by comparing a producer's rows with all its ranges.
    """
    blocks = ranges.selectExpr(*(f"`{c}` AS `__r_{c}`" for c in producer), "lo", "hi", f"explode(sequence({_block('lo')}, {_block('hi')})) AS __b")
    same = "".join(f" AND `{c}` <=> `__r_{c}`" for c in producer)
    on = F.expr(f"__rb = __b AND `{number}` BETWEEN lo AND hi{same}")
    return rows.withColumn("__rb", F.expr(_block(f"`{number}`"))).join(blocks, on, "left_semi").drop("__rb")


@dataclass(frozen=True)
class Message:
    """What a table's columns say about a message."""

    producer: Sequence[str] = ("tablet_id", "epoch")
    number: str = "sequence"
    delivery: Sequence[str] = ()  #: columns on how a copy came, which make no other message of it
    together: Sequence[Sequence[str]] = ()  #: columns that are only taken from one and the same copy

    @property
    def identity(self) -> list[str]:
        return [*self.producer, self.number]


@dataclass
class Deduped:
    """One table, ``rows``, and what can be read from it by filters."""

    rows: DataFrame  #: one row per message: its columns, __copies, __seen, __h1, __h2, __odd, __again
    columns: list[str]
    message: Message
    seen: DataFrame | None = None  #: ranges seen before
    seen_exact: DataFrame | None = None  #: hash keys seen before

    @property
    def accepted(self) -> DataFrame:
        """One complete row per message not seen before."""
        return self.rows.where(~F.col("__seen")).select(*self.columns)

    @property
    def later(self) -> DataFrame:
        """The best copy of each message that was seen before."""
        return self.rows.where("__odd = 0 AND __again = 1 AND __seen").select(*self.columns)

    @property
    def repeated(self) -> DataFrame:
        """Identities with more rows than were accepted: identity, copies."""
        return self.rows.where("__odd = 0 AND __again = 1").select(*self.message.identity, F.col("__copies").alias("copies"))

    @property
    def fresh(self) -> DataFrame:
        """The ranges of the numbers accepted now: disjoint, and apart from those seen before."""
        n = F.col(self.message.number)
        new = self.rows.where("__odd = 0 AND NOT __seen").select(*self.message.producer, n.alias("lo"), n.alias("hi"))
        return merge_ranges(new, self.message.producer)

    @property
    def fresh_exact(self) -> DataFrame:
        return self.rows.where("__odd = 1 AND NOT __seen").select("__h1", "__h2")

    @property
    def ranges(self) -> DataFrame:
        """The merged ranges: producer, lo, hi."""
        both = self.fresh if self.seen is None else self.fresh.unionByName(self.seen.select(*self.message.producer, "lo", "hi"))
        return both if self.seen is None else merge_ranges(both, self.message.producer)

    @property
    def exact(self) -> DataFrame:
        """Hash keys of the rows without identity."""
        return self.fresh_exact if self.seen_exact is None else self.fresh_exact.unionByName(self.seen_exact)


def keyed(rows: DataFrame, identity: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds ``__h1, __h2``: 128 bits of hash over ``columns`` of a row with a null in its
    identity, null for all others."""
    whole = " AND ".join(f"{c} IS NOT NULL" for c in _names(identity))
    kept = _names(columns)
    one = f"xxhash64({', '.join(kept)})"
    two = f"xxhash64(7, {', '.join(f'{c} IS NULL' for c in kept)}, {', '.join(reversed(kept))})"
    return rows.selectExpr("*", f"if({whole}, NULL, {one}) AS __h1", f"if({whole}, NULL, {two}) AS __h2")


def _reduced(rows: DataFrame, m: Message) -> DataFrame:
    """One row per message: its columns, ``__copies``, ``__h1``, ``__h2``.

    One aggregate for well-formed and malformed rows, combined before the shuffle, so an
    identity on a third of all rows is one row by then. Well-formed rows have no hash keys;
    malformed ones are told apart by them.
    """
    rest = [c for c in rows.columns if c not in m.identity]
    # units that are filled as one: each column alone, or those that belong together
    units = [u for u in ([c for c in g if c in rest] for g in m.together) if u]
    units += [[c] for c in rest if not any(c in u for u in units)]
    unit = [f"named_struct({', '.join(f'{chr(39)}c{k}{chr(39)}, `{c}`' for k, c in enumerate(u))})" for u in units]
    filled = " + ".join(["0", *(f"int(`{c}` IS NOT NULL)" for c in rest)])
    best = ", ".join(["'filled'", filled, *(f"'u{i}', {x}" for i, x in enumerate(unit))])
    most = [F.expr(f"max(if(`{u[0]}` IS NOT NULL, {x}, NULL)) AS __m{i}") for i, (u, x) in enumerate(zip(units, unit))]
    out = keyed(rows, m.identity, [c for c in rows.columns if c not in m.delivery]).groupBy(*_names(m.identity), "__h1", "__h2").agg(F.expr("count(1) AS __copies"), F.expr(f"max(named_struct({best})) AS __b"), *most)
    taken = {c: f"if(__b.u{i}.c0 IS NULL AND __m{i} IS NOT NULL, __m{i}.c{k}, __b.u{i}.c{k}) AS `{c}`" for i, u in enumerate(units) for k, c in enumerate(u)}
    return out.selectExpr(*(taken.get(c, f"`{c}`") for c in rows.columns), "__copies", "__h1", "__h2")


def flagged(once: DataFrame, m: Message, seen: DataFrame | None, seen_exact: DataFrame | None) -> DataFrame:
    """Adds ``__seen`` to keyed rows: a seen range covers the number, or a seen hash key is the row's own.

    One join finds both. A number's key is its producer and block, a malformed row's its hash;
    what lies behind an equal key is compared in full. Seen ranges are disjoint, so a row meets
    one of them at most.
    """
    if seen is None and seen_exact is None:
        return once.withColumn("__seen", F.lit(False))
    names, producer = [f"__p{i}" for i in range(len(m.producer))], _names(m.producer)
    known = None
    if seen is not None:
        cut = seen.selectExpr(*(f"{c} AS {n}" for c, n in zip(producer, names)), "lo", "hi", f"explode(sequence({_block('lo')}, {_block('hi')})) AS __b")
        known = cut.selectExpr(f"xxhash64({', '.join(names)}, __b) AS __k", *names, "lo", "hi", "CAST(NULL AS bigint) AS __x1", "CAST(NULL AS bigint) AS __x2")
    if seen_exact is not None:
        none = [f"CAST(NULL AS {once.schema[c].dataType.simpleString()}) AS {n}" for c, n in zip(m.producer, names)]
        odd = seen_exact.distinct().selectExpr("__h1 AS __k", *none, "CAST(NULL AS bigint) AS lo", "CAST(NULL AS bigint) AS hi", "__h1 AS __x1", "__h2 AS __x2")
        known = odd if known is None else known.unionByName(odd)
    inside = " AND ".join([f"`{m.number}` BETWEEN lo AND hi", *(f"{c} = {n}" for c, n in zip(producer, names))])
    rows = once.selectExpr("*", f"coalesce(__h1, xxhash64({', '.join(producer)}, {_block(f'`{m.number}`')})) AS __key")
    on = F.expr(f"__key = __k AND if(__h1 IS NULL, {inside}, __h1 = __x1 AND __h2 = __x2)")
    return rows.join(known.withColumn("__hit", F.lit(True)), on, "left").selectExpr(*_names(once.columns), "coalesce(__hit, false) AS __seen")


def dedupe(rows: DataFrame, message: Message = Message(), seen: DataFrame | None = None, seen_exact: DataFrame | None = None) -> Deduped:
    """Keeps exactly one copy of each message, within ``rows`` and against what was ``seen``.

    ``seen`` has the disjoint ranges and ``seen_exact`` the hash keys that an earlier call gave
    back. Of several copies the one with the most filled columns is accepted, ties by value,
    and its empty columns are filled from the others (columns that belong together from one
    copy), so the result doesn't depend on the order of rows. Rows with a null in the identity
    are the same only if all their columns are, apart from those of the delivery (by 128 bits
    of hash). Empty tables give empty results; further columns are carried along.
    """
    once = flagged(_reduced(rows, message), message, seen, seen_exact)
    once = once.selectExpr("*", "int(__h1 IS NOT NULL) AS __odd", "int(__seen OR __copies > 1) AS __again")
    return Deduped(once, rows.columns, message, seen, seen_exact)


class Deduper:
    """De-duplication over deliveries, with its ranges and hash keys kept under ``root``.

    A delivery is reduced, compared with what was seen, and written once, as one table from
    which all else is read by filters on its partitions: malformed or not, repeated or not. Its new ranges and hash keys are written beside those
    of earlier deliveries, from which they are apart, and merged with them every MERGE_EVERY
    deliveries: a delivery costs its own size, not that of all before. Table and state are
    published in one manifest version. A delivery that fails before that can be given again;
    one given again after that repeats everything and accepts nothing.
    """

    def __init__(self, spark: SparkSession, root: str, message: Message = Message()):
        self.spark, self.table, self.message = spark, SnapshotTable(spark, root), message
        self.folder = f"{self.table.root}/deliveries"

    def _read(self, paths: Sequence[str]) -> DataFrame | None:
        return self.spark.read.parquet(*paths) if paths else None

    def deliver(self, rows: DataFrame) -> int:
        base = self.table.version()
        state, m = self.table.read(base), self.message
        ranges, exact = state.get("ranges", []), state.get("exact", [])
        at = f"{self.folder}/__delivery={uuid.uuid4().hex}"
        once = dedupe(rows, m, self._read(ranges), self._read(exact)).rows
        once.write.partitionBy("__odd", "__again").parquet(at)
        # read back with its own schema, as an empty delivery has no partitions
        out = Deduped(self.spark.read.schema(once.schema).parquet(at), rows.columns, m)
        state_of = {}
        for name, old, new in (("ranges", ranges, out.fresh), ("exact", exact, out.fresh_exact)):
            path = self.table.data_path(name)
            if len(old) + 1 < MERGE_EVERY:
                new.write.parquet(path)
                state_of[name] = [*old, path]
            else:
                whole = new.unionByName(self._read(old))
                (merge_ranges(whole, m.producer) if name == "ranges" else whole).write.parquet(path)
                state_of[name] = [path]
        return self.table.publish(base, {**state_of, "columns": rows.columns, "schema": once.schema.json(), "deliveries": [*state.get("deliveries", []), at]})

    def _all(self) -> Deduped:
        """The tables of all deliveries as one; columns as in the last."""
        state = self.table.read()
        reader = self.spark.read.option("basePath", self.folder).schema(T.StructType.fromJson(json.loads(state["schema"])))
        rows = reader.parquet(*state["deliveries"])
        return Deduped(rows, state["columns"], self.message)

    def accepted(self) -> DataFrame:
        """One row per message: the best copy of the delivery that brought it first."""
        return self._all().accepted

    def complete(self) -> DataFrame:
        """One row per message: its best copy over all deliveries so far."""
        out = self._all()
        return _reduced(out.accepted.unionByName(out.later), self.message).select(*out.columns)

    def repeated(self) -> DataFrame:
        """Identities that came more than once, in one delivery or in several."""
        return self._all().repeated.select(*self.message.identity).distinct()

    def ranges(self) -> DataFrame:
        """The disjoint ranges of numbers seen of each producer."""
        return merge_ranges(self._read(self.table.read()["ranges"]), self.message.producer)
