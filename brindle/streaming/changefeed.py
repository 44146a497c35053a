"""Problem 2: applying a stream of inserts, updates and deletes.

The feed is a Structured Streaming query. Its state store holds, by key, the payload, the last
sequence and whether it was a delete; only a greater sequence replaces it. Each micro-batch
puts out the keys that it touched, into a folder named by the batch, which a repeated batch
overwrites: an idempotent upsert. The state is a maximum, kept on the JVM side and combined
before the shuffle, so repeated and out-of-order changes and hot keys cost nothing special.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.versions import newest, order_of
from brindle.sources.manifest import SnapshotTable

KEYS = ("tablet_id", "key")
ORDER = ("ts_seconds", "ts_nanos", "ts_logical", "epoch", "sequence", "write_no")
#: The state is kept on local disks and its changes in the checkpoint: the keys of a feed need
#: not fit into the executors' memory.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
PAYLOAD = ("operation", "kind", "v_int", "v_float", "v_bytes", "v_string")


def latest_state(changes: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, payload: Sequence[str] = PAYLOAD, deleted: Column | None = None) -> DataFrame:
    """Keyed state after ``changes``: keys, order, payload and ``deleted``; one row a key.

    Works on a batch and on a stream (output mode ``update``). Rows without the first order
    column don't count. Later order columns may be null, which is lowest. Changes with equal
    order are copies: a change with a payload goes before a tombstone, then the greater
    values. Null keys are one key. Tombstones stay in the state, so that an older insert that
    arrives after a delete is not taken for news.
    """
    keys, order, payload = list(keys), list(order), list(payload)
    gone = F.col("kind").isNull() if deleted is None else deleted
    state = F.struct(order_of(order).alias("order"), (~gone).alias("alive"), F.struct(*(F.col(c) for c in payload)).alias("payload"))
    last = changes.where(F.col(order[0]).isNotNull()).groupBy(*keys).agg(F.max(state).alias("s"))
    return last.select(*keys, *(F.col(f"s.order.o{i}").alias(c) for i, c in enumerate(order)), *(F.col(f"s.payload.{c}").alias(c) for c in payload), (~F.col("s.alive")).alias("deleted"))


def apply_feed(spark: SparkSession, source: str, schema: T.StructType, root: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, payload: Sequence[str] = PAYLOAD, max_bytes: int = 64 << 30, partitions: int | None = None) -> int:
    """Runs the feed over the Parquet files of ``source`` that it has not read yet.

    ``root`` keeps the checkpoint (offsets and state) and the output; a later call carries on
    there. ``max_bytes`` bounds a micro-batch (a single larger file is one); ``partitions`` is the number of state partitions,
    which the first call fixes: choose it for the keys, not for one batch. Returns the id of the last batch (-1: none yet).
    """
    # A path that is one file is given as a pattern, as the file source wants a folder otherwise.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile():
        source = f"{source[:-1]}[{source[-1]}]"
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes))
    state = latest_state(reader.parquet(source), keys, order, payload)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/upserts/batch={batch_id}")

    wanted = STATE_STORE | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{root}/checkpoint").foreachBatch(upsert).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    progress = query.lastProgress
    return progress["batchId"] if progress else -1


def _upserts(spark: SparkSession, root: str, read: T.StructType) -> tuple[DataFrame | None, dict]:
    """The folded table's rows (as batch -1) and those of later batches; the fold's manifest."""
    state = SnapshotTable(spark, f"{root}/folded").read()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/upserts")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None, state
    rows = spark.read.schema(T.StructType([*read, T.StructField("batch", T.LongType())])).parquet(f"{root}/upserts")
    if state:
        # folders of folded batches are pruned
        rows = rows.where(F.col("batch") > state["upto"]).unionByName(spark.read.schema(read).parquet(state["table"]).withColumn("batch", F.lit(-1).cast("long")))
    return rows, state


def _read_schema(schema: T.StructType, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> T.StructType:
    types = {f.name: f.dataType for f in schema}
    return T.StructType([*(T.StructField(c, types[c]) for c in [*keys, *order, *payload]), T.StructField("deleted", T.BooleanType())])


def current_table(spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, payload: Sequence[str] = PAYLOAD, with_deleted: bool = False) -> DataFrame:
    """The table that the upserts so far have built: one row per live key.

    What a touched key's state was in its last batch counts; batches that ``fold`` has merged
    are read as one table.
    """
    read = _read_schema(schema, keys, order, payload)
    rows, _ = _upserts(spark, root, read)
    if rows is None:
        return spark.createDataFrame([], read).drop(*([] if with_deleted else ["deleted"]))
    last = newest(rows, keys, ["batch"], [c for c in read.names if c not in keys])
    return last if with_deleted else last.where(~F.col("deleted")).drop("deleted")


def fold(spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER, payload: Sequence[str] = PAYLOAD, expire_before: int | None = None) -> int | None:
    """Merges all upserts so far into one table, in one manifest version; returns the last batch.

    Tombstones whose first order column is below ``expire_before`` are left out of the table:
    the streaming state still has them, so older changes stay refused. Upserts of merged
    batches are no longer read. None if there is nothing to merge.
    """
    table = SnapshotTable(spark, f"{root}/folded")
    base, read = table.version(), _read_schema(schema, keys, order, payload)
    rows, state = _upserts(spark, root, read)
    upto = rows.agg(F.max("batch")).first()[0] if rows is not None else None
    if upto is None or upto < 0:
        return state.get("upto")
    whole = newest(rows.where(F.col("batch") <= upto), keys, ["batch"], [c for c in read.names if c not in keys])
    if expire_before is not None:
        whole = whole.where(~(F.col("deleted") & (F.col(order[0]) < expire_before)))
    path = table.data_path("table")
    whole.write.parquet(path)
    table.publish(base, {"table": path, "upto": upto})
    return upto
