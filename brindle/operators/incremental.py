"""Problem 1: processing only new or changed records.

A run reads the committed high watermark of each log, fixes its upper limit when it starts,
and publishes its output together with the new watermark in one manifest version. A run that
dies before publishing leaves nothing visible, so the next one takes the same records again;
a run that published can't be repeated, as its watermark is in the same version. What is done
is known from kept ranges, so a run reads what is new and not the history.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.dedupe import MERGE_EVERY, Message, flagged, keyed, merge_ranges
from brindle.operators.skew import lookup_join
from brindle.operators.versions import newest
from brindle.sources.files import listed_files, scan_of
from brindle.sources.manifest import SnapshotTable

IDENTITY = ("tablet_id", "epoch", "sequence")


def committed_positions(runs: DataFrame, log: str = "log_name", position: str = "log_position", finished: str = "finished_at", status: str = "status", done: str = "succeeded") -> DataFrame:
    """``(log, position)``: what the last successful run of each log had read.

    The last is the one with the latest end, among successful runs with a position; a run
    without an end counts as the earliest. Repeated rows don't matter. Of runs that ended at
    the same time the greater position counts.
    """
    good = runs.where((F.col(status) == done) & F.col(position).isNotNull() & F.col(log).isNotNull())
    return newest(good, [log], [finished, position], [position])


@dataclass
class Pending:
    """What a run has still to process, and the limits fixed at its start."""

    rows: DataFrame  #: one row per identity
    lower: DataFrame  #: log, position: committed before this run
    upper: DataFrame  #: log, position: the greatest offset there was at the start
    base: int  #: manifest version the run is based on
    marks: DataFrame  #: identities that count as done from this run on
    files: dict[str, tuple[int, int]] | None  #: the files that were read, if the source is a scan


class IncrementalRun:
    """Exactly-once processing of append-only logs.

    ``identity`` names what makes two rows the same record, a whole number last; ``offset``
    grows within ``log``. What is done is kept beside the watermark: as disjoint ranges of
    numbers, and by hash key for identities with a null. So a run over a scan of files reads
    the files that are new (or changed) since the last committed run, and nothing else.

    Edge cases: an identity with a null in ``required`` columns is no record of its own and is
    left out; other nulls in the identity group together. A row without offset or log counts
    as not yet read until a run takes it, and is done from then on, whatever copies come later.
    An identity with any row at or below the committed position of that row's log is done,
    however many later copies there are. Without a committed position everything of the log is
    pending. Empty tables give empty results; extra columns are ignored.
    """

    def __init__(self, spark: SparkSession, root: str, identity: Sequence[str] = IDENTITY, log: str = "log_name", offset: str = "log_offset", required: Sequence[str] = ("epoch", "sequence")):
        self.spark, self.table = spark, SnapshotTable(spark, root)
        self.identity, self.log, self.offset, self.required = list(identity), log, offset, list(required)
        self.message = Message(self.identity[:-1], self.identity[-1])

    def committed(self) -> DataFrame:
        """The watermark in the newest manifest version: ``(log, __lower)``."""
        at = self.table.read().get("watermark")
        schema = T.StructType([T.StructField(self.log, T.StringType()), T.StructField("__lower", T.LongType())])
        return self.spark.read.schema(schema).parquet(at) if at else self.spark.createDataFrame([], schema)

    def _unread(self, messages: DataFrame, state: dict) -> tuple[DataFrame, dict[str, tuple[int, int]] | None]:
        """The rows of files that no committed run has read, and these files."""
        there = listed_files(messages)
        if there is None:
            return messages, None
        read = {r.path: (r.length, r.modified) for r in self.spark.read.parquet(*state["files"]).collect()} if state.get("files") else {}
        new = {p: at for p, at in there.items() if read.get(p) != at}
        return (messages if len(new) == len(there) else scan_of(messages, list(new))), new

    def _done(self, state: dict) -> list[DataFrame | None]:
        return [self.spark.read.parquet(*state[k]) if state.get(k) else None for k in ("ranges", "exact")]

    def plan(self, messages: DataFrame, positions: DataFrame | None = None) -> Pending:
        """The pending records between the watermark and the limits fixed now.

        ``positions`` (log, position) overrides this table's own watermark: the bookkeeping of
        another consumer, for which all files are read. The upper limits are materialised
        before rows are read, so rows that arrive while the run works are left to the next one.
        """
        base = self.table.version()
        state = self.table.read(base)
        if positions is None:
            lower = self.committed()
            messages, files = self._unread(messages, state)
        else:
            lower, files = positions.select(F.col(self.log), F.col([c for c in positions.columns if c != self.log][0]).cast("long").alias("__lower")), listed_files(messages)
        limits, marks = self.table.data_path("limits"), self.table.data_path("marks")
        messages.groupBy(self.log).agg(F.max(self.offset).alias("__upper")).join(lower, self.log, "full_outer").write.parquet(limits)
        bounds = self.spark.read.parquet(limits)
        inside = lookup_join(messages.select(*self.identity, self.log, self.offset), bounds, [self.log])
        # A row without offset or log has no place in the order: it is taken now.
        place = " AND ".join([f"coalesce(`{self.offset}` <= __upper, true)", *(f"`{c}` IS NOT NULL" for c in self.required)])
        first = F.expr(f"min(named_struct('log', `{self.log}`, 'at', `{self.offset}`)) AS __first")
        once = inside.where(place).groupBy(*self.identity).agg(F.expr(f"max(coalesce(`{self.offset}` <= __lower, false)) AS __old"), first)
        flagged(keyed(once, self.identity, self.identity), self.message, *self._done(state)).where(~F.col("__seen")).drop("__seen").write.parquet(marks)
        # not done by an earlier run; those under the watermark are done from now on
        left = self.spark.read.parquet(marks)
        rows = left.where(~F.col("__old")).select(*self.identity, F.col("__first.log").alias(self.log), F.col("__first.at").alias(self.offset))
        return Pending(rows, lower, bounds, base, left, files)

    def commit(self, pending: Pending, output: DataFrame | None = None) -> int:
        """Writes the output and the new watermark and publishes both in one version."""
        at = {k: self.table.data_path(k) for k in ("out", "watermark", "ranges", "exact", "files")}
        state = self.table.read(pending.base)
        (pending.rows if output is None else output).write.parquet(at["out"])
        pending.upper.select(self.log, F.greatest("__upper", "__lower").alias("__lower")).where(F.col("__lower").isNotNull()).coalesce(1).write.parquet(at["watermark"])
        number, whole = F.col(self.message.number), F.col("__h1").isNull()
        fresh = merge_ranges(pending.marks.where(whole).select(*self.message.producer, number.alias("lo"), number.alias("hi")), self.message.producer)
        new, lists = {"ranges": fresh, "exact": pending.marks.where(~whole).select("__h1", "__h2")}, {}
        if pending.files is not None:
            new["files"] = self.spark.createDataFrame([(p, *v) for p, v in pending.files.items()], "path string, length bigint, modified bigint").coalesce(1)
        for k, df in new.items():
            old = state.get(k, [])
            if len(old) + 1 >= MERGE_EVERY:
                df = df.unionByName(self.spark.read.parquet(*old))
                df, old = merge_ranges(df, self.message.producer) if k == "ranges" else df, []
            df.write.parquet(at[k])
            lists[k] = [*old, at[k]]
        return self.table.publish(pending.base, {**state, **lists, "watermark": at["watermark"], "outputs": [*state.get("outputs", []), at["out"]]})

    def output(self, version: int | None = None, last_only: bool = False) -> DataFrame | None:
        """What all runs up to a version (or only its last run) have put out."""
        paths = self.table.read(version).get("outputs", [])
        return self.spark.read.parquet(*(paths[-1:] if last_only else paths)) if paths else None
