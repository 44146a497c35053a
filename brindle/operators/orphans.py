"""Problem 5: references to records that do not exist.

References are aggregated per key and period first: one row for all references of a field to a
target in a month. These rows are checked against the targets, those of heavy targets by a
broadcast, all others by a shuffled anti-join; both parts' counts are unioned. Single
references are looked at again only in groups that hold orphans.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.skew import lookup_join
from brindle.operators.versions import HYBRID, newest, order_of
from brindle.sources.shared import work_dir

#: A target that more rows than this refer to is heavy ...
HEAVY_REFS = 10_000
#: ... or, where there are very many references, more than one in so many of them. There can
#: be at most so many heavy targets, whatever the input: that bounds what is broadcast.
MAX_HEAVY = 100_000


@dataclass(frozen=True)
class Reference:
    """A column whose value names an id of the target table."""

    table_name: str
    rows: DataFrame
    field: str
    id: str = "id"


def month(seconds: Column) -> Column:
    """UTC month ``YYYY-MM`` of seconds since 1970."""
    # the month is taken from the date, so the session's time zone has no part in it
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")), "yyyy-MM")


def references(refs: list[Reference], order: tuple[str, ...] = HYBRID) -> DataFrame:
    """``table_name, id, field, target, at, period`` of the newest version of each row.

    Rows that are dropped in their newest version, without id, or whose field is null or 0
    refer to nothing. A null ``dropped`` is false.
    """
    parts: dict[int, tuple[Reference, list[str]]] = {}
    for r in refs:
        parts.setdefault(id(r.rows), (r, []))[1].append(r.field)
    out = None
    for r, fields in parts.values():
        last = newest(r.rows.where(F.col(r.id).isNotNull()), [r.id], list(order), [*order, "dropped", *fields]).where(~F.coalesce("dropped", F.lit(False)))
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("target")) for f in fields)))
        rows = last.select(F.lit(r.table_name).alias("table_name"), F.col(r.id).alias("id"), order_of(order).alias("at"), month(F.col(order[0])).alias("period"), pairs.alias("p")).select("table_name", "id", "p.field", "p.target", "at", "period")
        rows = rows.where(F.col("target").isNotNull() & (F.col("target") != 0))
        out = rows if out is None else out.unionByName(rows)
    return out


def target_states(targets: DataFrame, id: str = "id", order: tuple[str, ...] = HYBRID) -> DataFrame:
    """``target, gone, since``: one row per id that has any row."""
    version = F.struct(order_of(order).alias("at"), F.coalesce("dropped", F.lit(False)).alias("dropped"))
    return targets.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("target")).agg(F.max(version)["dropped"].alias("gone"), F.min(order_of(order)).alias("since"))


#: What a group of references is: all of a table's field to one target in one month.
GROUP = ["table_name", "field", "target", "__period"]


@dataclass
class Checked:
    """References and the groups of them that hold orphans."""

    refs: DataFrame  #: table_name, id, field, target, at, period, __period
    groups: DataFrame  #: GROUP, reason, n_refs, since; reason is missing, dropped, later or mixed

    def _bad(self, groups: DataFrame) -> DataFrame:
        """The references of some groups; of a mixed one those that are older than their target."""
        rows = lookup_join(self.refs, groups.select(*GROUP, "reason", "since"), GROUP, "inner")
        mixed = F.col("reason") == "mixed"
        return rows.where(~mixed | (F.col("since") > F.col("at"))).withColumn("reason", F.when(mixed, "later").otherwise(F.col("reason")))

    def rows(self) -> DataFrame:
        """``table_name, id, field, period, target, reason`` of every orphan reference."""
        return self._bad(self.groups).select("table_name", "id", "field", "period", "target", "reason")

    def counts(self) -> DataFrame:
        """``table_name, field, period, reason, n_refs, n_targets``, from the groups' counts.

        Only groups of which a part is later than its target are counted reference by reference.
        """
        whole = self.groups.where(F.col("reason") != "mixed").select(*GROUP, "reason", "n_refs")
        part = self._bad(self.groups.where(F.col("reason") == "mixed")).groupBy(*GROUP, "reason").agg(F.count(F.lit(1)).alias("n_refs"))
        # a group has one row here, so a target counts once in its table, field, period and reason
        both = whole.unionByName(part).groupBy("table_name", "field", "__period", "reason").agg(F.sum("n_refs").alias("n_refs"), F.count(F.lit(1)).alias("n_targets"))
        return both.select("table_name", "field", F.nullif("__period", F.lit("")).alias("period"), "reason", "n_refs", "n_targets")


def check(refs: list[Reference], targets: DataFrame, heavy_refs: int = HEAVY_REFS, order: tuple[str, ...] = HYBRID) -> Checked:
    """References to targets that are missing, dropped, or younger than the reference.

    References are written once, then aggregated per table, field, target and period, with the
    oldest and the newest of each group (combined before the shuffle). Targets with more than
    ``heavy_refs`` references, and more than one in MAX_HEAVY of all, are heavy: their states,
    at most MAX_HEAVY rows, are broadcast to the groups. All other groups meet the sound
    targets in a shuffled anti-join, and only what is left meets the targets again, for the
    reason. A group whose target is younger than its oldest but not its newest reference is
    mixed. References without a period have a group of their own.
    """
    spark = targets.sparkSession

    def once(df: DataFrame, name: str) -> DataFrame:
        at = work_dir(spark, name)
        df.write.parquet(at)
        return spark.read.parquet(at)

    written = once(references(refs, order).withColumn("__period", F.coalesce("period", F.lit(""))), "refs")
    groups = once(written.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_refs"), F.min("at").alias("first"), F.max("at").alias("last")), "groups")
    states = once(target_states(targets, order=order), "states")
    least = max(heavy_refs, (groups.agg(F.sum("n_refs")).first()[0] or 0) // MAX_HEAVY)
    heavy = groups.groupBy("target").agg(F.sum("n_refs").alias("__n")).where(F.col("__n") > least).select("target")
    # heavy has at most MAX_HEAVY rows
    hot = groups.join(F.broadcast(heavy.join(states, "target", "left")), "target", "inner")
    sound = states.where(~F.col("gone")).select(F.col("target").alias("__t"), F.col("since").alias("__since"))
    rest = groups.join(F.broadcast(heavy), "target", "left_anti")
    rest = rest.join(sound.hint("shuffle_hash"), (F.col("target") == F.col("__t")) & (F.col("__since") <= F.col("first")), "left_anti").join(states, "target", "left")
    reason = F.when(F.col("gone").isNull(), "missing").when(F.col("gone"), "dropped").when(F.col("since") > F.col("last"), "later").when(F.col("since") > F.col("first"), "mixed")
    checked = hot.unionByName(rest).withColumn("reason", reason).where(F.col("reason").isNotNull())
    return Checked(written, once(checked.select(*GROUP, "reason", "n_refs", "since"), "orphans"))


def orphans(refs: list[Reference], targets: DataFrame, heavy_refs: int = HEAVY_REFS, order: tuple[str, ...] = HYBRID) -> DataFrame:
    """Every orphan reference: ``table_name, id, field, period, target, reason``; see ``check``."""
    return check(refs, targets, heavy_refs, order).rows()


def orphan_counts(refs: list[Reference], targets: DataFrame, heavy_refs: int = HEAVY_REFS, order: tuple[str, ...] = HYBRID) -> DataFrame:
    """Orphans per table, field, period and reason; see ``check``."""
    return check(refs, targets, heavy_refs, order).counts()
