"""Registered queries of the general training-data problems (p1 to p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.compaction import Compactor, Plan
from brindle.operators.dedupe import Deduper, Message
from brindle.operators.incremental import IncrementalRun, committed_positions
from brindle.operators.orphans import Reference, orphan_counts, orphans
from brindle.operators.skew import lookup_join
from brindle.operators.versions import HYBRID
from brindle.sources.shared import work_dir
from brindle.sources.tables import table
from brindle.streaming.changefeed import KEYS, ORDER, PAYLOAD, apply_feed, current_table, fold


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identities that the next run of each log's consumer has to process."""
    run = IncrementalRun(spark, work_dir(spark, "p1"))
    pending = run.plan(table(spark, sf_dir, "data_messages"), committed_positions(table(spark, sf_dir, "tablet_watermarks")))
    return run.output(run.commit(pending)).select("tablet_id", "epoch", "sequence")


def p1_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watermark of each log after two runs; the second has nothing left to do."""
    run = IncrementalRun(spark, work_dir(spark, "p1"))
    messages = table(spark, sf_dir, "data_messages")
    run.commit(run.plan(messages, committed_positions(table(spark, sf_dir, "tablet_watermarks"))))
    run.commit(run.plan(messages))
    left = run.output(last_only=True).groupBy("log_name").agg(F.count(F.lit(1)).alias("n_left"))
    return run.committed().select("log_name", F.col("__lower").alias("log_position")).join(left, "log_name", "left").select("log_name", "log_position", F.coalesce("n_left", F.lit(0)).cast("long").alias("n_left"))


def p1_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two runs put out that see the log grow: each record once, and the second run's rows
    read are those of the new files alone."""
    root, messages = work_dir(spark, "p1"), table(spark, sf_dir, "data_messages")
    middle = messages.groupBy("log_name").agg(((F.min("log_offset") + F.max("log_offset")) / 2).alias("__middle"))
    halves = lookup_join(messages, middle, ["log_name"]).withColumn("__late", F.coalesce(F.col("log_offset") > F.col("__middle"), F.lit(False))).drop("__middle")
    run, read = IncrementalRun(spark, f"{root}/run"), []
    for late in (False, True):
        halves.where(F.col("__late") == late).drop("__late").write.mode("append").parquet(f"{root}/log")
        pending = run.plan(spark.read.schema(messages.schema).parquet(f"{root}/log"))
        read.append(set(pending.files))
        run.commit(pending)
    return run.output().groupBy("tablet_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("epoch", "sequence").alias("identities")).withColumn("new_files_only", F.lit(read[0].isdisjoint(read[1])))


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, source = work_dir(spark, "p2"), f"{sf_dir}/timestamped_values.parquet"
    schema = spark.read.parquet(source).schema
    apply_feed(spark, source, schema, root)
    return current_table(spark, root, schema, KEYS, ORDER, PAYLOAD)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of the current version of each live key."""
    return _feed(spark, sf_dir).select("tablet_id", F.lower(F.hex("key")).alias("key_hex"), "epoch", "sequence", "write_no")


def p2_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from four micro-batches in order of arrival, each of which meets the state of
    those before; upserts are folded half way."""
    root, changes = work_dir(spark, "p2"), table(spark, sf_dir, "timestamped_values")
    cuts = changes.agg(F.percentile_approx(F.unix_micros(F.col("arrived_at").cast("timestamp")), [0.25, 0.5, 0.75])).first()[0] or [0, 0, 0]
    at = F.coalesce(F.unix_micros(F.col("arrived_at").cast("timestamp")), F.lit(0))
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = changes.where((at > low if low is not None else F.lit(True)) & (at <= high if high is not None else F.lit(True)))
        part.write.mode("append").parquet(f"{root}/in")
        apply_feed(spark, f"{root}/in", changes.schema, root)
        if k == 1:
            fold(spark, root, changes.schema)
    now = current_table(spark, root, changes.schema)
    return now.select("tablet_id", F.lower(F.hex("key")).alias("key_hex"), "epoch", "sequence", "write_no")


def p2_current_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current table itself: payloads of all live keys."""
    return _feed(spark, sf_dir).select("tablet_id", F.lower(F.hex("key")).alias("key_hex"), "kind", "v_int", "v_float", F.lower(F.hex("v_bytes")).alias("v_bytes_hex"), "v_string")


#: A copy's fetch, arrival and place in the log say how it came; a hybrid time is one value.
_MESSAGE = Message(delivery=("fetch_id", "arrived_at", "log_offset"), together=(HYBRID,))


def _delivered(spark: SparkSession, messages: DataFrame) -> Deduper:
    """The messages in two deliveries; rows of one fetch come together."""
    first = F.coalesce(F.col("fetch_id") % 2 == 0, F.lit(True))
    job = Deduper(spark, work_dir(spark, "p3"), _MESSAGE)
    job.deliver(messages.where(first))
    job.deliver(messages.where(~first))
    return job


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities delivered more than once."""
    return _delivered(spark, table(spark, sf_dir, "data_messages")).repeated()


def p3_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One complete row per message, whichever delivery brought it; malformed ones too."""
    rows = _delivered(spark, table(spark, sf_dir, "data_messages")).complete()
    return rows.select("tablet_id", "epoch", "sequence", F.col("operation").isNotNull().alias("has_operation"), F.col("write_count").isNotNull().alias("has_count"))


def p3_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without their epoch, each delivered again by a later fetch: one copy of each."""
    rows = table(spark, sf_dir, "data_messages").withColumn("epoch", F.lit(None).cast("long"))
    again = rows.withColumns({"fetch_id": F.col("fetch_id") + 1, "arrived_at": F.col("arrived_at") + F.expr("interval 1 hour")})
    kept = _delivered(spark, rows.unionByName(again)).accepted()
    return kept.groupBy("tablet_id").agg(F.count(F.lit(1)).alias("n"))


def p3_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disjoint ranges of sequence numbers seen of each producer."""
    return _delivered(spark, table(spark, sf_dir, "data_messages")).ranges().select("tablet_id", "epoch", "lo", "hi")


def p3_large_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence numbers around 2^53 and 2^62, delivered twice: accepted once each, in exact ranges."""
    base = F.when(F.col("tablet_id") % 2 == 0, F.lit((1 << 53) - 500)).otherwise(F.lit((1 << 62) - 500))
    job = _delivered(spark, table(spark, sf_dir, "data_messages").withColumn("sequence", F.col("sequence") + base))
    n = job.accepted().where("tablet_id IS NOT NULL AND epoch IS NOT NULL AND sequence IS NOT NULL").groupBy("tablet_id", "epoch").agg(F.count(F.lit(1)).alias("n"))
    return n.join(job.ranges().groupBy("tablet_id", "epoch").agg(F.count(F.lit(1)).alias("n_ranges"), F.sum(F.col("hi") - F.col("lo") + 1).alias("covered"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), ["tablet_id", "epoch"], "left")


def _compacted(spark: SparkSession, sf_dir: str) -> tuple[Compactor, Plan]:
    job = Compactor(spark, work_dir(spark, "p4"))
    plan = job.plan(table(spark, sf_dir, "file_metas"))
    job.rewrite(plan, table(spark, sf_dir, "file_entries"))
    return job, plan


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small live files that a compaction has rewritten."""
    return _compacted(spark, sf_dir)[1].files.select("file_uri")


def p4_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compacted table, by shard: files before and after, entries and bytes."""
    job, plan = _compacted(spark, sf_dir)
    after = job.entries().withColumn("__file", F.input_file_name()).groupBy("shard_id").agg(F.countDistinct("__file").alias("n_files"), F.count(F.lit(1)).alias("n_entries"), F.sum("entry_bytes").alias("entry_bytes"))
    before = plan.files.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_small_files"))
    return before.join(after, "shard_id", "left").select(F.col("shard_id").cast("long").alias("shard_id"), "n_small_files", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.coalesce("entry_bytes", F.lit(0)).cast("long").alias("entry_bytes"))


def p4_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries that the snapshot holds or lists, by shard: rewritten and untouched live files."""
    held = _compacted(spark, sf_dir)[0].all_entries(table(spark, sf_dir, "file_entries"))
    return held.groupBy(F.col("shard_id").cast("long").alias("shard_id")).agg(F.countDistinct("file_uri").alias("n_files"), F.count(F.lit(1)).alias("n_entries"), F.sum("entry_bytes").cast("long").alias("entry_bytes"))


def p4_recompacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two compactions, first of the even tablets' files, then of all: shards overlap, and every
    entry of all live files is held or listed once."""
    metas, entries = table(spark, sf_dir, "file_metas"), table(spark, sf_dir, "file_entries")
    job = Compactor(spark, work_dir(spark, "p4"))
    for listings in (metas.where(F.col("tablet_id") % 2 == 0), metas):
        job.rewrite(job.plan(listings), entries)
    held = job.all_entries(entries)
    return held.groupBy(F.col("shard_id").cast("long").alias("shard_id")).agg(F.countDistinct("file_uri").alias("n_files"), F.count(F.lit(1)).alias("n_entries"), F.sum("entry_bytes").cast("long").alias("entry_bytes"))


def _references(spark: SparkSession, sf_dir: str) -> tuple[list[Reference], DataFrame]:
    metas, tables = table(spark, sf_dir, "descriptor_metas"), table(spark, sf_dir, "table_descriptors")
    return [Reference("descriptor_metas", metas, "parent_id"), Reference("descriptor_metas", metas, "database_id"), Reference("table_descriptors", tables, "schema_id")], metas


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reference to a descriptor that is missing, dropped or later."""
    return orphans(*_references(spark, sf_dir)).select("table_name", "id", "field", "period")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table, field, month and reason."""
    return orphan_counts(*_references(spark, sf_dir))


def p5_heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report where every target with more than 20 references counts as heavy."""
    return orphan_counts(*_references(spark, sf_dir), heavy_refs=20)


QUERIES = {f.__name__: f for f in (p1_found, p1_watermark, p1_two_runs, p2_found, p2_batches, p2_current_table, p3_found, p3_unique, p3_malformed, p3_ranges, p3_large_ids, p4_found, p4_compacted, p4_entries, p4_recompacted, p5_found, p5_report, p5_heavy)}

_COMMITTED = """committed AS (
  SELECT log_name, log_position FROM (
    SELECT log_name, log_position, row_number() OVER (PARTITION BY log_name ORDER BY finished_at DESC NULLS LAST, log_position DESC) AS rn
    FROM tablet_watermarks WHERE status = 'succeeded' AND log_position IS NOT NULL AND log_name IS NOT NULL) WHERE rn = 1)"""

_NEWEST = "ORDER BY ts_seconds DESC NULLS LAST, ts_nanos DESC NULLS LAST, ts_logical DESC NULLS LAST"
_CURRENT = """SELECT *, row_number() OVER (PARTITION BY tablet_id, key ORDER BY ts_seconds DESC, ts_nanos DESC NULLS LAST, ts_logical DESC NULLS LAST,
    epoch DESC NULLS LAST, sequence DESC NULLS LAST, write_no DESC NULLS LAST, kind NULLS LAST) AS rn
  FROM timestamped_values WHERE ts_seconds IS NOT NULL"""

_ORPHANS = f"""WITH newest_meta AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id {_NEWEST}) AS rn FROM descriptor_metas WHERE id IS NOT NULL) WHERE rn = 1),
  newest_table AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id {_NEWEST}) AS rn FROM table_descriptors WHERE id IS NOT NULL) WHERE rn = 1),
  oldest AS (
    SELECT id, ts_seconds AS s, ts_nanos AS n, ts_logical AS l FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts_seconds NULLS FIRST, ts_nanos NULLS FIRST, ts_logical NULLS FIRST) AS rn FROM descriptor_metas WHERE id IS NOT NULL) WHERE rn = 1),
  refs AS (
    SELECT 'descriptor_metas' AS table_name, id, 'parent_id' AS field, parent_id AS target, ts_seconds, ts_nanos, ts_logical, dropped FROM newest_meta
    UNION ALL SELECT 'descriptor_metas', id, 'database_id', database_id, ts_seconds, ts_nanos, ts_logical, dropped FROM newest_meta
    UNION ALL SELECT 'table_descriptors', id, 'schema_id', schema_id, ts_seconds, ts_nanos, ts_logical, dropped FROM newest_table),
  bad AS (
    SELECT r.table_name, r.id, r.field, r.target, strftime(make_timestamp(r.ts_seconds * 1000000), '%Y-%m') AS period,
      CASE WHEN t.id IS NULL THEN 'missing' WHEN coalesce(t.dropped, false) THEN 'dropped'
        WHEN (o.s, coalesce(o.n, -1), coalesce(o.l, -1)) > (r.ts_seconds, coalesce(r.ts_nanos, -1), coalesce(r.ts_logical, -1)) THEN 'later' END AS reason
    FROM refs r LEFT JOIN newest_meta t ON t.id = r.target LEFT JOIN oldest o ON o.id = r.target
    WHERE NOT coalesce(r.dropped, false) AND r.target IS NOT NULL AND r.target <> 0)
"""

_SMALL = """latest AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_uri ORDER BY listed_at DESC NULLS LAST) AS rn FROM file_metas WHERE size IS NOT NULL) WHERE rn = 1),
  small AS (
    SELECT * FROM latest WHERE state = 'live' AND size < 1048576 AND shard_id IN (
      SELECT shard_id FROM latest WHERE state = 'live' AND size < 1048576 GROUP BY shard_id HAVING count(*) >= 2))"""

ORACLE = {
    "p1_found": f"""WITH {_COMMITTED}
SELECT tablet_id, epoch, sequence FROM data_messages m LEFT JOIN committed c ON m.log_name = c.log_name
WHERE epoch IS NOT NULL AND sequence IS NOT NULL GROUP BY tablet_id, epoch, sequence
HAVING NOT bool_or(coalesce(m.log_offset <= c.log_position, false))""",
    "p1_watermark": f"""WITH {_COMMITTED},
ends AS (SELECT log_name, max(log_offset) AS last FROM data_messages GROUP BY log_name)
SELECT coalesce(e.log_name, c.log_name) AS log_name, greatest(coalesce(e.last, c.log_position), coalesce(c.log_position, e.last)) AS log_position, CAST(0 AS BIGINT) AS n_left
FROM ends e FULL OUTER JOIN committed c ON e.log_name = c.log_name WHERE coalesce(e.last, c.log_position) IS NOT NULL""",
    "p1_two_runs": """SELECT tablet_id, count(*) AS n, count(*) AS identities, true AS new_files_only FROM
(SELECT DISTINCT tablet_id, epoch, sequence FROM data_messages WHERE epoch IS NOT NULL AND sequence IS NOT NULL) GROUP BY tablet_id""",
    "p2_found": f"""SELECT tablet_id, lower(hex(key)) AS key_hex, epoch, sequence, write_no FROM ({_CURRENT}) WHERE rn = 1 AND kind IS NOT NULL""",
    "p2_current_table": f"""SELECT tablet_id, lower(hex(key)) AS key_hex, kind, v_int, v_float, lower(hex(v_bytes)) AS v_bytes_hex, v_string FROM ({_CURRENT}) WHERE rn = 1 AND kind IS NOT NULL""",
    "p3_found": """SELECT tablet_id, epoch, sequence FROM data_messages
WHERE tablet_id IS NOT NULL AND epoch IS NOT NULL AND sequence IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""",
    "p3_unique": """SELECT tablet_id, epoch, sequence, bool_or(operation IS NOT NULL) AS has_operation, bool_or(write_count IS NOT NULL) AS has_count FROM data_messages
WHERE tablet_id IS NOT NULL AND epoch IS NOT NULL AND sequence IS NOT NULL GROUP BY tablet_id, epoch, sequence
UNION ALL SELECT tablet_id, epoch, sequence, operation IS NOT NULL, write_count IS NOT NULL FROM (
  SELECT DISTINCT * EXCLUDE (fetch_id, arrived_at, log_offset) FROM data_messages WHERE tablet_id IS NULL OR epoch IS NULL OR sequence IS NULL)""",
    "p3_malformed": """SELECT tablet_id, count(*) AS n FROM (SELECT DISTINCT * EXCLUDE (fetch_id, arrived_at, log_offset, epoch) FROM data_messages) GROUP BY tablet_id""",
    "p3_large_ids": """WITH ids AS (SELECT DISTINCT tablet_id, epoch, sequence + CASE WHEN tablet_id % 2 = 0 THEN 9007199254740492 ELSE 4611686018427387404 END AS sequence FROM data_messages
  WHERE tablet_id IS NOT NULL AND epoch IS NOT NULL AND sequence IS NOT NULL),
g AS (SELECT *, sequence - lag(sequence) OVER (PARTITION BY tablet_id, epoch ORDER BY sequence) AS step FROM ids)
SELECT tablet_id, epoch, count(*) AS n, count(*) FILTER (WHERE step IS NULL OR step > 1) AS n_ranges, count(*) AS covered, min(sequence) AS lo, max(sequence) AS hi FROM g GROUP BY tablet_id, epoch""",
    "p3_ranges": """WITH ids AS (SELECT DISTINCT tablet_id, epoch, sequence FROM data_messages
  WHERE tablet_id IS NOT NULL AND epoch IS NOT NULL AND sequence IS NOT NULL)
SELECT tablet_id, epoch, min(sequence) AS lo, max(sequence) AS hi FROM (
  SELECT *, sequence - row_number() OVER (PARTITION BY tablet_id, epoch ORDER BY sequence) AS island FROM ids)
GROUP BY tablet_id, epoch, island""",
    "p4_found": f"""WITH {_SMALL} SELECT file_uri FROM small""",
    "p4_compacted": f"""WITH {_SMALL},
  sized AS (SELECT shard_id, count(*) AS n_small_files FROM small GROUP BY shard_id),
  kept AS (SELECT s.shard_id, count(*) AS n_entries, sum(entry_bytes) AS entry_bytes FROM
    (SELECT file_uri, entry_no, max(entry_bytes) AS entry_bytes FROM file_entries GROUP BY file_uri, entry_no) e JOIN small s ON e.file_uri = s.file_uri GROUP BY s.shard_id)
SELECT z.shard_id, z.n_small_files, CAST(CASE WHEN k.n_entries IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_files,
  CAST(coalesce(k.n_entries, 0) AS BIGINT) AS n_entries, CAST(coalesce(k.entry_bytes, 0) AS BIGINT) AS entry_bytes FROM sized z LEFT JOIN kept k ON z.shard_id = k.shard_id""",
    "p4_entries": f"""WITH {_SMALL}
SELECT shard_id, count(DISTINCT l.file_uri) AS n_files, count(*) AS n_entries, CAST(sum(entry_bytes) AS BIGINT) AS entry_bytes FROM
  (SELECT file_uri, entry_no, max(entry_bytes) AS entry_bytes FROM file_entries WHERE entry_no IS NOT NULL GROUP BY file_uri, entry_no) e
  JOIN latest l ON e.file_uri = l.file_uri WHERE state = 'live' GROUP BY shard_id""",
    "p5_found": f"""{_ORPHANS} SELECT table_name, id, field, period FROM bad WHERE reason IS NOT NULL""",
    "p5_report": f"""{_ORPHANS} SELECT table_name, field, period, reason, count(*) AS n_refs, count(DISTINCT target) AS n_targets FROM bad WHERE reason IS NOT NULL GROUP BY ALL""",
}
ORACLE["p5_heavy"] = ORACLE["p5_report"]
ORACLE["p4_recompacted"] = ORACLE["p4_entries"]
ORACLE["p2_batches"] = ORACLE["p2_found"]
