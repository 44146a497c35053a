"""Problem 4: far too many small files.

Shards with too many small live files are found and laid side by side into groups of a target
size by prefix sums: a group is a partition of the compacted table, and its files have the
target's size however small its shards are. Only groups that the plan touches are rewritten
and replaced, whole, under a snapshot manifest that names the live partitions and refuses a
plan made from an older snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.operators.skew import lookup_join
from brindle.operators.versions import newest
from brindle.sources.manifest import ConflictError, SnapshotTable

SMALL_BYTES, TARGET_BYTES, HEADER_BYTES = 1 << 20, 128 << 20, 16
#: A partition's files are summed in so many strands, then the strands are laid end to end.
STRANDS = 64

#: What is kept of a listing.
LISTING = ("file_uri", "listed_at", "state", "size", "shard_id", "tablet_id", "last_modified")


def current_files(listings: DataFrame) -> DataFrame:
    """The latest complete listing of each file: file_uri, shard_id, tablet_id, size, state.

    Failed listings (without size) don't count, nor do rows without ``file_uri``. Of listings
    at the same time the greater values count. Repeated rows don't matter.
    """
    keep = ["listed_at", "state", "size", "shard_id", "tablet_id", "last_modified"]
    good = listings.where(F.col("size").isNotNull() & F.col("file_uri").isNotNull())
    return newest(good, ["file_uri"], ["listed_at"], keep)


def small_files(listings: DataFrame, small_bytes: int = SMALL_BYTES, least: int = 2) -> DataFrame:
    """Live files under ``small_bytes`` in shards that have at least ``least`` of them.

    Files without a shard are in none and are left alone.
    """
    return _crowded(current_files(listings).where(F.col("state") == "live"), small_bytes, least)


def _crowded(live: DataFrame, small_bytes: int, least: int) -> DataFrame:
    small = live.where((F.col("size") < small_bytes) & F.col("shard_id").isNotNull())
    full = small.groupBy("shard_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    # one row a shard; small enough to broadcast or not is for the measured sizes to say (AQE)
    return small.join(full.select("shard_id"), "shard_id", "left_semi")


def pack(files: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Adds ``grp`` and ``bin``: files of a group in the same bin become one file.

    Shards are laid on one line, in some order, and a shard belongs to the group of the target's
    width in which it begins; a shard beyond the target has several bins. So a bin has less
    than twice the target, and there are about as many bins as targets in the whole.

    Running sums in two levels: within a strand (a hash class of a shard's files, or of all
    shards), then over the strands' totals. A shard with a third of all files is the work of
    STRANDS tasks, and so are all shards together.
    """
    strand = files.withColumn("__strand", F.pmod(F.xxhash64("file_uri"), F.lit(STRANDS)))
    inside = W.partitionBy("shard_id", "__strand").orderBy("file_uri").rowsBetween(W.unboundedPreceding, 0)
    summed = strand.withColumn("__sum", F.sum("size").over(inside))
    totals = strand.groupBy("shard_id", "__strand").agg(F.sum("size").alias("__total"))
    sofar = W.partitionBy("shard_id").orderBy("__strand").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("shard_id", "__strand", F.coalesce(F.sum("__total").over(sofar), F.lit(0)).alias("__offset"))
    shards = totals.groupBy("shard_id").agg(F.sum("__total").alias("__bytes")).withColumn("__lane", F.pmod(F.xxhash64("shard_id"), F.lit(STRANDS)))
    along = W.partitionBy("__lane").orderBy("shard_id").rowsBetween(W.unboundedPreceding, -1)
    # at most STRANDS rows
    lanes = shards.groupBy("__lane").agg(F.sum("__bytes").alias("__all")).select("__lane", F.sum("__all").over(W.orderBy("__lane").rowsBetween(W.unboundedPreceding, -1)).alias("__from"))
    begins = shards.withColumn("__in", F.sum("__bytes").over(along)).join(F.broadcast(lanes), "__lane").select("shard_id", F.floor((F.coalesce("__in", F.lit(0)) + F.coalesce("__from", F.lit(0))) / F.lit(target_bytes)).cast("long").alias("grp"))
    start = F.col("__sum") - F.col("size") + F.col("__offset")
    packed = summed.join(offsets.join(begins, "shard_id"), ["shard_id", "__strand"])
    return packed.withColumn("bin", F.floor(start / F.lit(target_bytes)).cast("long")).drop("__strand", "__sum", "__offset")


def _named(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("file_uri").isNotNull() & F.col("entry_no").isNotNull()).select("file_uri", "entry_no", "entry_key", "entry_bytes")


@dataclass
class Plan:
    files: DataFrame  #: file_uri, shard_id, size, grp, bin
    held: DataFrame  #: the same of files whose entries the touched groups hold already
    at: str  #: folder of ``files`` and ``held``
    base: int  #: snapshot that the plan was made from
    untouched: DataFrame  #: the live files that stay as they are, as in current_files
    listed: str  #: folder of ``untouched``


class Compactor:
    """Compaction of the entries of small files into a partitioned table under ``root``."""

    def __init__(self, spark: SparkSession, root: str, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, least: int = 2):
        self.spark, self.table = spark, SnapshotTable(spark, root)
        self.small_bytes, self.target_bytes, self.least = small_bytes, target_bytes, least

    def plan(self, listings: DataFrame) -> Plan:
        """Which files to rewrite, into which bins. Written out, so that it can't change.

        All other live files are listed as untouched: large ones, lone small ones of a shard,
        those without a shard. Files that only the base's list of untouched files knows count
        as listed there, so listings may be all there are or only the latest.
        """
        base, at, live_at, listed = self.table.version(), self.table.data_path("plan"), self.table.data_path("live"), self.table.data_path("untouched")
        old = self.table.read(base)
        known, held = listings.select(*LISTING), self._rewritten(old)
        if "untouched" in old:
            known = known.unionByName(self.spark.read.parquet(old["untouched"]))
        live = current_files(known).where(F.col("state") == "live")
        (live if held is None else lookup_join(live, held.select("file_uri"), ["file_uri"], "left_anti")).write.parquet(live_at)
        live = self.spark.read.parquet(live_at)
        files = _crowded(live, self.small_bytes, self.least).select("file_uri", "shard_id", "size", F.lit(False).alias("held"))
        if held is not None:
            # a group is replaced whole: with all shards that it holds
            owners = self.spark.read.parquet(old["owners"])
            touched = lookup_join(owners, files.select("shard_id").distinct(), ["shard_id"], "left_semi").select("part", "grp").distinct()
            again = lookup_join(held, lookup_join(owners, touched, ["part", "grp"], "left_semi").select("shard_id"), ["shard_id"], "left_semi")
            files = files.unionByName(again.withColumn("held", F.lit(True)))
        pack(files, self.target_bytes).select("file_uri", "shard_id", "size", "grp", "bin", "held").write.parquet(at)
        packed = self.spark.read.parquet(at)
        files, held = packed.where(~F.col("held")).drop("held"), packed.where("held").drop("held")
        lookup_join(live, files.select("file_uri"), ["file_uri"], "left_anti").select(*LISTING).write.parquet(listed)
        self.table.delete(live_at)
        return Plan(files, held, at, base, self.spark.read.parquet(listed), listed)

    def rewrite(self, plan: Plan, entries: DataFrame) -> int:
        """Writes the planned partitions and publishes them; ConflictError if out of date.

        Each entry (file_uri, entry_no) is taken once, however often its row is repeated.
        Rows go to one task per (grp, bin), so each bin is one file, sorted by shard; a bin's
        size is bounded by the target. Partitions that the plan touches are replaced: the new
        ones are written under a new data folder, with what the old ones held, and the version
        no longer names the old ones. Readers of an old snapshot keep its folders. The version
        also names the list of the live files left as they are, so bins and listed files
        together hold every entry of all live files once.
        """
        if self.table.version() != plan.base:
            raise ConflictError(f"{self.table.root}: planned on {plan.base}, now {self.table.version()}")
        data, owners = self.table.data_path("entries"), self.table.data_path("owners")
        old, before = self.table.read(plan.base), self.entries(plan.base)
        place = ["file_uri", "shard_id", "grp", "bin"]
        picked = lookup_join(_named(entries), plan.files.select(*place), ["file_uri"], "inner")
        rows = newest(picked, ["file_uri", "entry_no", "shard_id", "grp", "bin"], ["entry_bytes", "entry_key"])
        if before is not None:
            rows = rows.unionByName(lookup_join(before.drop("shard_id", "grp", "bin"), plan.held.select(*place), ["file_uri"], "inner"))
        out = rows.repartition("grp", "bin").sortWithinPartitions("grp", "bin", "shard_id", "entry_key", "file_uri", "entry_no")
        out.write.partitionBy("grp").parquet(data)
        both = plan.files.select("shard_id", "grp").unionByName(plan.held.select("shard_id", "grp"))
        owned, parts = both.distinct().withColumn("part", F.lit(data)), {data: []}
        if "owners" in old:
            mine = self.spark.read.parquet(old["owners"])
            stays = lookup_join(mine, owned.select("shard_id"), ["shard_id"], "left_anti")
            owned = owned.unionByName(stays)
            # one row a partition, of about the target's size
            gone = lookup_join(mine, owned.where(F.col("part") == data).select("shard_id"), ["shard_id"], "left_semi").groupBy("part").agg(F.collect_set("grp").alias("dead"))
            dead, alive = {r.part: r.dead for r in gone.collect()}, {r.part for r in stays.select("part").distinct().collect()}
            parts |= {p: sorted({*d, *dead.get(p, [])}) for p, d in old["parts"].items() if p in alive}
        owned.write.parquet(owners)
        schema = ", ".join(f"{c} {kind}" for c, kind in out.dtypes)
        return self.table.publish(plan.base, {"parts": parts, "owners": owners, "schema": schema, "plans": [*old.get("plans", []), plan.at], "untouched": plan.listed, "target_bytes": self.target_bytes})

    def _rewritten(self, manifest: dict) -> DataFrame | None:
        """All files whose entries are in a version's bins: file_uri, shard_id, size."""
        plans = manifest.get("plans")
        return self.spark.read.parquet(*plans).where(~F.col("held")).select("file_uri", "shard_id", "size") if plans else None

    def entries(self, version: int | None = None) -> DataFrame | None:
        """All compacted entries of a snapshot: shard_id, grp, bin, file_uri, entry_no, ...

        Partitions that a later version replaced are pruned from the scan; None before the first.
        """
        old = self.table.read(version)
        if not old:
            return None
        out = None
        for at, dead in old["parts"].items():
            rows = self.spark.read.schema(old["schema"]).parquet(at)
            rows = rows.where(~F.col("grp").isin(dead)) if dead else rows
            out = rows if out is None else out.unionByName(rows)
        return out

    def untouched(self, version: int | None = None) -> DataFrame | None:
        """The live files that a snapshot lists beside its bins; None before the first."""
        at = self.table.read(version).get("untouched")
        return self.spark.read.parquet(at) if at else None

    def all_entries(self, entries: DataFrame, version: int | None = None) -> DataFrame | None:
        """Each entry of all live files of a snapshot once: shard_id, file_uri, entry_no, ...

        Those of rewritten files come from the bins, those of the listed files from
        ``entries``, which stands for what the files hold.
        """
        version = self.table.version() if version is None else version
        packed, listed = self.entries(version), self.untouched(version)
        if packed is None or listed is None:
            return None
        picked = lookup_join(_named(entries), listed.select("file_uri", "shard_id"), ["file_uri"], "inner")
        return packed.drop("grp", "bin").unionByName(newest(picked, ["file_uri", "entry_no", "shard_id"], ["entry_bytes", "entry_key"]))
