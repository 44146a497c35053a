"""Logs: acceptance, replay, clocks and late writes, as batch and streaming programs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.skew import Line, lookup_join, running_max_before
from brindle.operators.versions import newest


def accept(messages: DataFrame, log: str = "log", position: str = "position", epoch: str = "epoch", sequence: str = "sequence") -> DataFrame:
    """Adds ``verdict`` to each message of a log: accept, skip or gap.

    A higher epoch is accepted with any sequence. In the epoch of the last accepted message
    the next sequence is accepted, a lower or equal one skipped, and a greater one is a gap,
    after which the log can't be read on. A lower epoch is skipped. Messages at one position are taken
    by epoch and sequence. All from running maxima: within an epoch that is current, the greatest sequence so far is the last accepted one.
    """
    line = Line(messages, [log], [position, epoch, sequence])
    rows = line.running(line.rows, F.col(epoch), "max", "__current", inclusive=False)
    # epochs of a log may interleave along its line, which a range and key's one row allows for
    rows = line.running(rows, F.col(sequence), "max", "__last", keys=[log, epoch], inclusive=False).select(*messages.columns, "__current", "__last")
    verdict = (
        F.when(F.col("__current").isNull() | (F.col(epoch) > F.col("__current")), "accept")
        .when(F.col(epoch) < F.col("__current"), "skip")
        .when(F.col(sequence) <= F.col("__last"), "skip")
        .when(F.col(sequence) == F.col("__last") + 1, "accept")
        .otherwise("gap")
    )
    return rows.withColumn("verdict", verdict).drop("__current", "__last")


class GapError(RuntimeError):
    """A log lacks a message."""


def accept_stream(stream: DataFrame, root: str, log: str = "log", position: str = "position", epoch: str = "epoch", sequence: str = "sequence") -> int:
    """Runs the acceptance of a stream to its end; ``accepted_rows`` reads what it let through.

    The state is the last accepted (epoch, sequence) of each log: one row a log, written by
    micro-batch. A micro-batch is judged by ``accept`` behind the state's rows, so a log with a
    third of all rows is the work of many tasks. Rows, and the state after them, go into
    folders named by the batch, which a repeated batch overwrites. A gap fails the query, so
    nothing of that batch is taken. Returns the id of the last batch (-1: none).
    """
    spark, columns = stream.sparkSession, [log, position, epoch, sequence]

    def step(batch: DataFrame, batch_id: int) -> None:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/state/batch={batch_id - 1}")
        known = spark.read.parquet(at.toString()) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None
        rows = batch.select(*columns)
        if known is not None:
            # the state stands before a log's first new position
            first = rows.groupBy(log).agg(F.min(position).alias("__first"))
            seed = first.join(known, log).select(log, (F.col("__first") - 1).alias(position), epoch, sequence)
            rows = rows.withColumn("__new", F.lit(True)).unionByName(seed.withColumn("__new", F.lit(False)))
        else:
            rows = rows.withColumn("__new", F.lit(True))
        judged_at = f"{root}/judged/batch={batch_id}"
        accept(rows, log, position, epoch, sequence).write.mode("overwrite").parquet(judged_at)
        judged = spark.read.parquet(judged_at)
        gap = judged.where("verdict = 'gap'").orderBy(log, position).limit(1).collect()
        if gap:
            r = gap[0]
            raise GapError(f"log {r[log]}: sequence {r[sequence]} at {r[position]} leaves a gap in epoch {r[epoch]}")
        new = judged.where("verdict = 'accept' AND __new").select(*columns)
        new.write.mode("overwrite").parquet(f"{root}/accepted/batch={batch_id}")
        last = new.select(log, epoch, sequence) if known is None else new.select(log, epoch, sequence).unionByName(known.select(log, epoch, sequence))
        last.groupBy(log).agg(F.max(F.struct(epoch, sequence)).alias("s")).select(log, f"s.{epoch}", f"s.{sequence}").write.mode("overwrite").parquet(f"{root}/state/batch={batch_id}")

    query = stream.writeStream.option("checkpointLocation", f"{root}/checkpoint").foreachBatch(step).trigger(availableNow=True).start()
    query.awaitTermination()
    progress = query.lastProgress
    return progress["batchId"] if progress else -1


def accepted_rows(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """All rows that ``accept_stream`` has let through under ``root``."""
    return spark.read.schema(schema).parquet(f"{root}/accepted").drop("batch")


def replay(snapshot: DataFrame, log: DataFrame, keys: Sequence[str], order: Sequence[str], after: Column, upto: Column) -> DataFrame:
    """The newest versions after a snapshot and the log's rows in (after, upto]; both filters reach the scan."""
    position = F.col(order[0])
    tail = log.where((position > after) & (position <= upto))
    return newest(snapshot.unionByName(tail, allowMissingColumns=True), keys, order)


def compact_versions(versions: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, partitions: int | None = None) -> None:
    """Writes all versions, once each, sorted by key and newest first, ranged over files."""
    once = versions.dropDuplicates([*keys, *order])
    ranged = once.repartitionByRange(partitions, *keys) if partitions else once.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys, *(F.col(c).desc() for c in order)).write.mode("overwrite").parquet(path)


def hybrid_clock(rows: DataFrame, wall: str, at: str, partition: Sequence[str] = ()) -> DataFrame:
    """Strictly growing times in the order of ``at``: ``hlc_wall`` is the greatest wall time so
    far, ``hlc_logical`` counts the rows since it last grew."""
    keys = list(partition)
    line = Line(rows, keys, [at])
    high = line.running(line.rows, F.col(wall), "max", "hlc_wall")
    # the greatest time never falls along the line, so its rows stay together
    count = line.running(high, F.lit(1).cast("long"), "sum", "hlc_logical", keys=[*keys, "hlc_wall"])
    return count.withColumn("hlc_logical", F.col("hlc_logical") - 1).select(*rows.columns, "hlc_wall", "hlc_logical")


def push_late(writes: DataFrame, ts: str, arrival: str, lag: int, partition: Sequence[str] = ()) -> DataFrame:
    """Adds ``closed`` and ``write_ts``: no write lands at or under the closed time.

    The closed time is ``lag`` behind the greatest time that arrived before; a late write is
    not dropped but moved to just behind it.
    """
    ran = running_max_before(writes, list(partition), arrival, ts, "__before")
    rows = ran.withColumn("closed", F.col("__before") - F.lit(lag)).drop("__before")
    return rows.withColumn("write_ts", F.greatest(F.col(ts), F.col("closed") + 1))


def follower_can_read(reads: DataFrame, at: str, read_only: str, closed: Column) -> DataFrame:
    """Adds ``served``: read-only requests at or under the closed time are; others are redirected."""
    return reads.withColumn("served", F.coalesce(F.col(read_only) & (F.col(at) <= closed), F.lit(False)))


class FileLog:
    """An append-only log as Parquet folders, one a batch; read as a batch or as a stream.

    Positions are given at append: (batch, place in it). Retention drops whole batches.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        from brindle.sources.manifest import SnapshotTable

        self.spark, self.schema, self.table = spark, schema, SnapshotTable(spark, root)
        self._data = f"{root}/data"

    def append(self, rows: DataFrame) -> int:
        """Appends a batch and returns its number; of two writers one gets ConflictError."""
        base = self.table.version()
        manifest = self.table.read(base)
        path = f"{self._data}/batch={base + 1}"
        rows.select(*self.schema.names).write.mode("overwrite").parquet(path)
        size = sum(s.getLen() for s in self.table._fs.listStatus(self.table._jvm.org.apache.hadoop.fs.Path(path)))
        self.table.publish(base, {"batches": [*manifest.get("batches", []), [base + 1, size]]})
        return base + 1

    def latest(self) -> int:
        return self.table.version()

    def read(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """Rows of the batches in (after, upto], with their ``batch``."""
        numbers = [b for b, _ in self.table.read().get("batches", []) if b > after and (upto is None or b <= upto)]
        whole = T.StructType([*self.schema, T.StructField("batch", T.IntegerType())])
        if not numbers:
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).option("basePath", self._data).parquet(*(f"{self._data}/batch={b}" for b in numbers))

    def stream(self, max_files: int = 1000) -> DataFrame:
        return self.spark.readStream.schema(T.StructType([*self.schema, T.StructField("batch", T.IntegerType())])).option("maxFilesPerTrigger", max_files).parquet(self._data)

    def trim(self, keep_bytes: int) -> list[int]:
        """Drops the oldest batches beyond ``keep_bytes``; returns the numbers that are left."""
        base = self.table.version()
        batches, total, kept = self.table.read(base).get("batches", []), 0, []
        for b, size in reversed(batches):
            total += size
            if total > keep_bytes and kept:
                break
            kept.append([b, size])
        kept.reverse()
        self.table.publish(base, {"batches": kept})
        for b, _ in batches[: len(batches) - len(kept)]:
            self.table.delete(f"{self._data}/batch={b}")
        return [b for b, _ in kept]


#: Messages since the last compaction that make the next one due.
COMPACT_AFTER = 5000


class CompactedLog:
    """A log of versions that is folded into a snapshot once enough messages have come.

    ``append`` adds a batch and compacts when ``trigger`` messages lie behind the snapshot;
    all versions are kept, once each. What is read is the snapshot and the log's tail, so a
    process that starts again reads the tail only. Snapshot and position are published in one
    manifest version; a compaction that loses the race to another leaves nothing.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str], trigger: int = COMPACT_AFTER):
        from brindle.sources.manifest import SnapshotTable

        self.spark, self.schema, self.keys, self.order, self.trigger = spark, schema, list(keys), list(order), trigger
        self.log, self.table = FileLog(spark, f"{root}/log", schema), SnapshotTable(spark, f"{root}/snapshots")

    def append(self, rows: DataFrame) -> int:
        number = self.log.append(rows)
        if self.behind() >= self.trigger:
            self.compact()
        return number

    def behind(self) -> int:
        """Messages that no snapshot holds yet."""
        return self.log.read(after=self.table.read().get("upto", 0)).count()

    def rows(self) -> DataFrame:
        """All versions: the snapshot's and the tail's, once each."""
        state = self.table.read()
        tail = self.log.read(after=state.get("upto", 0)).select(*self.schema.names)
        whole = tail if "snapshot" not in state else self.spark.read.schema(self.schema).parquet(state["snapshot"]).unionByName(tail)
        return whole.dropDuplicates([*self.keys, *self.order])

    def compact(self) -> int:
        base, upto = self.table.version(), self.log.latest()
        path = self.table.data_path("snapshot")
        compact_versions(self.rows(), self.keys, self.order, path)
        return self.table.publish(base, {"snapshot": path, "upto": upto})


def quorum_times(acks: DataFrame, write: str, at: str, quorum: int) -> DataFrame:
    """``write, replicated``: when the ``quorum``-th replica had acknowledged each write.

    Null while fewer have. A replica that acknowledges twice counts by its first time
    (``replica``). At most one time a replica is held together for a write.
    """
    first = acks.groupBy(write, "replica").agg(F.min(at).alias("__at"))
    return first.groupBy(write).agg(F.try_element_at(F.sort_array(F.collect_list("__at")), F.lit(quorum)).alias("replicated"))


def replicated_reads(reads: DataFrame, replicated: DataFrame, write: str, at: str) -> DataFrame:
    """Adds ``served``: a read of a value that is not replicated yet waits until it is.

    ``reads`` name the ``write`` whose value they find (null: none, which needs no waiting).
    Null where the write isn't replicated.
    """
    both = lookup_join(reads, replicated, [write])
    return both.withColumn("served", F.when(F.col(write).isNull(), F.col(at)).when(F.col("replicated").isNotNull(), F.greatest(at, "replicated"))).drop("replicated")


#: Times in full, to the microsecond.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def kafka_records(messages: DataFrame, log: str = "log") -> DataFrame:
    """Messages as records: ``key`` and ``value``, both binary. A null log has no key."""
    rest = [F.col(f"`{c}`") for c in messages.columns if c != log]
    return messages.select(F.col(log).cast("binary").alias("key"), F.to_json(F.struct(*rest), _JSON | {"ignoreNullFields": "false"}).cast("binary").alias("value"))


def kafka_messages(records: DataFrame, schema: T.StructType, log: str = "log") -> DataFrame:
    """Records as messages of ``schema`` again; works on a batch and on a stream."""
    rest = T.StructType([f for f in schema if f.name != log])
    return records.select(F.col("key").cast("string").alias(log), F.from_json(F.col("value").cast("string"), rest, _JSON).alias("m")).select(log, "m.*").select(*schema.names)


def kafka_log(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """A Kafka topic as a stream; needs the connector on the class path."""
    try:
        return spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "true"}).load()
    except Exception as e:
        raise RuntimeError("the Kafka connector is not on the class path") from e


def kafka_sink(messages: DataFrame, servers: str, topic: str, checkpoint: str, log: str = "log"):
    """Writes a stream of messages to a Kafka topic, a log's in order; at least once, as
    Kafka's sink is. Returns the running query; needs the connector on the class path."""
    out = kafka_records(messages, log).writeStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint, "kafka.enable.idempotence": "true"})
    try:
        return out.start()
    except Exception as e:
        raise RuntimeError("the Kafka connector is not on the class path") from e
