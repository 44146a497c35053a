"""Registered queries of logs, clocks, compaction and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.skew import Line, lookup_join
from brindle.operators.versions import newest
from brindle.sources.shared import work_dir
from brindle.sources.tables import table
from brindle.streaming.logs import CompactedLog, FileLog, accept, accept_stream, accepted_rows, compact_versions, follower_can_read, hybrid_clock, kafka_messages, kafka_records, push_late, quorum_times, replay, replicated_reads


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored messages with an identity and a place, as a log: position, epoch, sequence."""
    m = table(spark, sf_dir, "data_messages").where("epoch IS NOT NULL AND sequence IS NOT NULL AND log_offset IS NOT NULL")
    return m.select(F.col("log_name").alias("log"), F.col("log_offset").alias("position"), "epoch", "sequence")


def log_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each stored message: accept, skip or gap."""
    return accept(_log(spark, sf_dir)).groupBy("log", "verdict").agg(F.count(F.lit(1)).alias("n"))


def log_dedupe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fenced acceptance as a stream with state: all stored messages, in four deliveries.

    Each log is read from its first gap on in a log of its own, as a gap ends a stream.
    """
    root = work_dir(spark, "accept")
    line = Line(accept(_log(spark, sf_dir)), ["log"], ["position"])
    cut = line.running(line.rows, F.when(F.col("verdict") == "gap", 1).otherwise(0), "sum", "__gaps")
    schema = spark.createDataFrame([], "log string, position bigint, epoch bigint, sequence bigint").schema
    rows = cut.withColumn("log", F.concat_ws("/", "log", "__gaps")).select(*schema.names)
    last = rows.groupBy("log").agg(F.max("position").alias("__last"), F.min("position").alias("__first"))
    quarter = F.floor((F.col("position") - F.col("__first")) * 4 / (F.col("__last") - F.col("__first") + 1))
    staged = work_dir(spark, "messages")
    lookup_join(rows, last, ["log"]).withColumn("__q", quarter).select(*schema.names, "__q").write.partitionBy("__q").parquet(staged)
    log = FileLog(spark, f"{root}/log", schema)
    for q in range(4):
        log.append(spark.read.parquet(staged).where(F.col("__q") == q))
        accept_stream(log.stream().select(*schema.names), root)
    return accepted_rows(spark, root, schema).groupBy("log").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last"))


_KEYS, _ORDER = ["user_id"], ["event_id"]


def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot of the first half of all offsets, then the log up to the last one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    end = e.agg(F.max("event_id")).first()[0] or 0
    middle = end // 2
    snapshot = newest(e.where(F.col("event_id") <= middle), _KEYS, _ORDER)
    return replay(snapshot, e, _KEYS, _ORDER, F.lit(middle), F.lit(end)).select("user_id", "event_id", "value")


def compaction_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions, each of them twice, written once each and read back: versions and times of each key."""
    at = work_dir(spark, "compact")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    compact_versions(e.union(e), ["user_id"], ["ts", "event_id"], at)
    return spark.read.parquet(at).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def log_compact_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events appended in six batches to a log that compacts after a third of them, read again
    by a log that is opened anew."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    last, root = (e.agg(F.max("event_id")).first()[0] or 0) + 1, work_dir(spark, "log")
    opened = lambda: CompactedLog(spark, root, e.schema, ["user_id"], ["ts", "event_id"], trigger=max(1, last // 3))
    log = opened()
    for k in range(6):
        log.append(e.where((F.col("event_id") >= last * k // 6) & (F.col("event_id") < last * (k + 1) // 6)))
    again = opened()
    return again.rows().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("value")).withColumn("compacted", F.lit(again.table.version() > 0 and again.behind() < last))


def log_quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are writes, their lines acknowledgements by replicas: when two of them have come,
    and when a read at the order's date is served."""
    acks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("w"), F.col("l_suppkey").alias("replica"), F.col("l_shipdate").alias("at"))
    reads = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("w"), F.col("o_orderdate").alias("asked"))
    return replicated_reads(reads, quorum_times(acks, "w", "at", 2), "w", "asked").select("w", "served")


def kafka_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stored messages as records of a topic and back."""
    m = table(spark, sf_dir, "data_messages")
    back = kafka_messages(kafka_records(m, "log_name"), m.schema, "log_name")
    return back.groupBy("log_name").agg(F.count(F.lit(1)).alias("n"), F.sum("sequence").alias("s"), F.count("operation").alias("ops"), F.max("arrived_at").alias("last"))


def file_log_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of files: appended in batches, read from a position, trimmed to the last batch."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    log = FileLog(spark, work_dir(spark, "log"), n.schema)
    for k in range(3):
        log.append(n.where(F.col("n_nationkey") % 3 == k).coalesce(1))
    after = log.read(after=1).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit("read"))
    after = spark.createDataFrame(after.collect(), after.schema)  # two rows
    log.trim(1)
    left = log.read().groupBy("batch").agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit("trimmed"))
    return after.unionByName(left)


def hlc_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid times of events whose clock stands still for ten minutes at a time."""
    e = table(spark, sf_dir, "events").select("event_id", (F.unix_seconds(F.col("ts").cast("timestamp")) / 600).cast("long").alias("wall"))
    return hybrid_clock(e.withColumn("wall", F.col("wall") - F.col("event_id") % 3), "wall", "event_id").select("event_id", "hlc_wall", "hlc_logical")


def closed_ts_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come late are moved behind the closed time, five seconds after the greatest."""
    e = table(spark, sf_dir, "events")
    late = e.select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) - (F.col("event_id") % 10) * 60_000_000).alias("at"))
    return push_late(late, "at", "event_id", 5_000_000).select("event_id", "closed", "write_ts")


def follower_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a follower serves: read-only ones at or under the closed time."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").isin("view", "click").alias("read_only"))
    return follower_can_read(e, "ts", "read_only", F.expr("timestamp_ntz'2024-01-20 00:00:00'")).select("event_id", "served")


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _drain(stream: DataFrame, root: str, mode: str) -> DataFrame:
    spark = stream.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")


def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day, as a stream that is read to its end."""
    w = _event_stream(spark, sf_dir).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    out = _drain(w, work_dir(spark, "window"), "complete")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "n")


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with a gap of six hours, as a stream: a session is put out once the
    watermark has passed its end, so an empty last batch with a late clock ends them all."""
    root = work_dir(spark, "session")
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    e.write.parquet(f"{root}/in")
    stream = lambda: spark.readStream.schema(e.schema).parquet(f"{root}/in").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour").groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    _drain(stream(), root, "append")
    end = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("user_id"), (F.col("ts") + F.expr("interval 30 days")).alias("ts"))
    end.write.mode("append").parquet(f"{root}/in")
    out = _drain(stream(), root, "append")
    return out.where("user_id >= 0").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("began"), "n")


def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases joined with the user's clicks of the hour before, both as streams with watermarks."""
    def side(kind: str, prefix: str) -> DataFrame:
        e = _event_stream(spark, sf_dir).where(F.col("event_type") == kind)
        return e.select(F.col("user_id").alias(f"{prefix}_user"), F.col("event_id").alias(f"{prefix}_id"), F.col("ts").cast("timestamp").alias(f"{prefix}_at")).withWatermark(f"{prefix}_at", "2 hours")

    on = F.expr("p_user = c_user AND c_at <= p_at AND c_at >= p_at - INTERVAL 1 HOUR")
    return _drain(side("purchase", "p").join(side("click", "c"), on).select("p_id", "c_id"), work_dir(spark, "join"), "append")


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events an hour with a watermark: what comes in a later batch behind it is left out."""
    root = work_dir(spark, "late")
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    hour = lambda: spark.readStream.schema(e.schema).parquet(f"{root}/in").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour").groupBy(F.window("at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    # all events, then all of them again, thirty days late against the watermark, and one to close
    for part in (e, e.withColumn("ts", F.col("ts") + F.expr("interval 90 days")), e):
        part.write.mode("append").parquet(f"{root}/in")
        out = _drain(hour(), root, "append")
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "n").where("hour < timestamp_ntz'2024-03-15 00:00:00'")


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users and kinds of a stream; state is one row a pair."""
    pairs = _event_stream(spark, sf_dir).select("user_id", "event_type").dropDuplicates()
    return _drain(pairs, work_dir(spark, "distinct"), "append")


def pandas_udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vectorised user function for what no built-in gives: texts without their accents."""
    from brindle.functions.udfs import register_udfs

    register_udfs(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("pg_unaccent(text)").alias("plain"))


_ALL = (log_accept, log_dedupe_stream, log_replay, compaction_snapshot, log_compact_restart, log_quorum, kafka_round_trip, file_log_trim, hlc_order, closed_ts_late, follower_read, stream_window, stream_session, stream_join, stream_late, stream_dedupe, pandas_udf_scalar)
QUERIES = {f.__name__: f for f in _ALL}

#: The verdict on each message by windows over whole logs.
_VERDICTS = """WITH l AS (SELECT log_name AS log, log_offset AS position, epoch, sequence FROM data_messages WHERE epoch IS NOT NULL AND sequence IS NOT NULL AND log_offset IS NOT NULL),
      c AS (SELECT *, max(epoch) OVER (PARTITION BY log ORDER BY position, epoch, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur,
        max(sequence) OVER (PARTITION BY log, epoch ORDER BY position, epoch, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM l),
      v AS (SELECT *, CASE WHEN cur IS NULL OR epoch > cur THEN 'accept' WHEN epoch < cur THEN 'skip' WHEN sequence <= prev THEN 'skip' WHEN sequence = prev + 1 THEN 'accept' ELSE 'gap' END AS verdict FROM c)"""

ORACLE = {
    "log_accept": f"""{_VERDICTS} SELECT log, verdict, count(*) AS n FROM v GROUP BY ALL""",
    "log_dedupe_stream": f"""{_VERDICTS}, g AS (SELECT *, sum(CASE WHEN verdict = 'gap' THEN 1 ELSE 0 END) OVER (PARTITION BY log ORDER BY position, epoch, sequence ROWS UNBOUNDED PRECEDING) AS gaps FROM v)
      SELECT log || '/' || CAST(gaps AS bigint) AS log, count(*) AS n, max(position) AS last FROM g WHERE verdict <> 'skip' GROUP BY ALL""",
    "log_replay": "SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "compaction_snapshot": "SELECT user_id, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id",
    "log_compact_restart": "SELECT user_id, count(*) AS n, arg_max(value, (ts, event_id)) AS value, true AS compacted FROM events GROUP BY user_id",
    "log_quorum": """WITH f AS (SELECT l_orderkey AS w, l_suppkey, min(l_shipdate) AS t FROM lineitem GROUP BY ALL), q AS (SELECT w, t FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY t) AS k FROM f) WHERE k = 2)
      SELECT o_orderkey AS w, CASE WHEN q.t IS NOT NULL THEN greatest(o_orderdate, q.t) END AS served FROM orders LEFT JOIN q ON q.w = o_orderkey""",
    "kafka_round_trip": "SELECT log_name, count(*) AS n, CAST(sum(sequence) AS bigint) AS s, count(operation) AS ops, max(arrived_at) AS last FROM data_messages GROUP BY log_name",
    "file_log_trim": "SELECT * FROM (VALUES (2, CAST(8 AS bigint), 'read'), (3, 8, 'read'), (3, 8, 'trimmed')) t(batch, n, stage)",
    "hlc_order": """WITH w AS (SELECT event_id, CAST(floor(epoch(ts) / 600) AS bigint) - event_id % 3 AS wall FROM events), h AS (SELECT event_id, max(wall) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS hlc_wall FROM w)
      SELECT event_id, hlc_wall, row_number() OVER (PARTITION BY hlc_wall ORDER BY event_id) - 1 AS hlc_logical FROM h""",
    "closed_ts_late": """WITH l AS (SELECT event_id, epoch_us(ts) - (event_id % 10) * 60000000 AS tt FROM events), c AS (SELECT *, max(tt) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 5000000 AS closed FROM l)
      SELECT event_id, closed, greatest(tt, coalesce(closed + 1, tt)) AS write_ts FROM c""",
    "follower_read": "SELECT event_id, event_type IN ('view', 'click') AND ts <= TIMESTAMP '2024-01-20 00:00:00' AS served FROM events",
    "stream_window": "SELECT date_trunc('day', ts)::timestamp AS day, count(*) AS n FROM events GROUP BY 1",
    "stream_session": """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
      SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_join": "SELECT p.event_id AS p_id, c.event_id AS c_id FROM events p JOIN events c ON p.user_id = c.user_id AND c.ts <= p.ts AND c.ts >= p.ts - INTERVAL 1 HOUR WHERE p.event_type = 'purchase' AND c.event_type = 'click'",
    "stream_late": "SELECT CAST(date_trunc('hour', ts) AS timestamp) AS hour, count(*) AS n FROM events GROUP BY 1",
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "pandas_udf_scalar": "SELECT doc_id, strip_accents(text) AS plain FROM documents",
}
