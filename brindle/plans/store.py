"""Registered queries of the key-value operators and transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.kv.batch import Op, run_batch
from brindle.kv.clock import with_default_time
from brindle.kv.store import Layout, VersionedStore, batch, locate, locate_server, read_your_writes, scoped
from brindle.kv.txn import Txn, deadlocks, expire, lock_queue, push_over_fences, resolve_intents, write_conflicts
from brindle.operators.relational import merge_spans, split_spans
from brindle.sources.manifest import SnapshotTable
from brindle.sources.shared import shared_dir, work_dir
from brindle.sources.tables import table

_AT = "timestamp_ntz'2024-01-15 00:00:00'"
_LAYOUT = Layout(key="user_id", order=("ts", "event_id"), value=("value",), alive="alive")


def _store(spark: SparkSession, sf_dir: str) -> VersionedStore:
    """Events as versions of users: an error deletes."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", (F.col("event_type") != "error").alias("alive"))
    return VersionedStore(e, _LAYOUT)


def kv_snapshot_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).snapshot(F.expr(_AT)).select("user_id", "value")


def kv_get_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).get([3, 5, 8, 13, 21, 10**9], F.expr(_AT)).select("user_id", "value")


def kv_find_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).find(40, F.expr(_AT)).select("user_id", "value")


def kv_find_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every customer the first user id from its own on."""
    return _store(spark, sf_dir).find_each(table(spark, sf_dir, "customer"), "c_custkey")


def kv_scan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pages of a scan, the second from where the first says to go on."""
    store = _store(spark, sf_dir)
    one, then = store.scan_page(10, 100, 12, F.expr(_AT))
    two, _ = store.scan_page(then, 100, 12, F.expr(_AT))
    return one.select("user_id", "value", F.lit(1).alias("page")).unionByName(two.select("user_id", "value", F.lit(2).alias("page")))


def kv_put_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which suppliers' keys are free among the live users."""
    writes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"))
    return _store(spark, sf_dir).put_if_absent(writes).select("user_id", "applied")


def kv_put_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event puts its user's key if it is absent: of one batch the first that finds it free."""
    writes = table(spark, sf_dir, "events").select("user_id", "event_id")
    return _store(spark, sf_dir).put_if_absent(writes, ["event_id"]).select("event_id", "applied")


def kv_find_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every order the first customer's key from its own on, in a line of very many ranges."""
    have = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 3).alias("key"), F.lit(1).alias("ts"), F.lit(True).alias("alive"), "o_orderkey")
    store = VersionedStore(have, Layout("key", ("ts", "o_orderkey"), (), "alive"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        return store.find_each(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey").groupBy("l_orderkey").agg(F.min("found").alias("found"), F.max("found").alias("found_too"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def kv_batch_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request over the suppliers' keys with every kind of operation for each nation."""
    versions = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(1).cast("long").alias("ts"), F.lit(0).alias("seq"), (F.col("s_nationkey") != 3).alias("alive"), F.col("s_nationkey").cast("long").alias("value"))
    nations = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # 25
    ops = [o for n in nations for o in (Op("get", n), Op("increment", n, 5), Op("find", n), Op("delete", n, expect=9), Op("find", n), Op("scan", n, end=n + 40, limit=2), Op("refresh", n, end=n + 3, since=0))]
    answers, written = run_batch(spark, versions, ops, 9)
    rows = [(n, *(str(a) for a in answers[i * 7 : i * 7 + 7])) for i, n in enumerate(nations)]
    out = spark.createDataFrame(rows, "n int, got string, counted string, found string, gone string, found_gone string, page string, fresh string")
    return out.join(written.select(F.col("key").cast("int").alias("n"), "alive"), "n")


def kv_default_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts of the users' first events; those without a time get the batch's."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"))
    return with_default_time(e, "at", 1_800_000_000_000_000)


def kv_put_expect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional puts that expect each user's purchase to be the newest version."""
    store = _store(spark, sf_dir)
    buys = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("expected"))
    writes = buys.withColumn("ts", F.expr("timestamp_ntz'2024-03-01 00:00:00'"))
    return store.put(writes, "expected").select("user_id", "applied")


def kv_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running counter of each user over the month, on top of the supplier's key."""
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(0).cast("bigint").alias("t"), F.lit(True).alias("alive"), F.col("s_suppkey").alias("v_int"))
    store = VersionedStore(base, Layout(key="key", order=("t",), value=("v_int",), alive="alive"))
    deltas = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", (F.col("event_id") % 7).alias("by"))
    return store.increment(deltas, "by", ["ts", "event_id"]).select("event_id", "value_after")


def kv_refresh_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether spans of ten users each are unchanged in the last days."""
    spans = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("span_id"), (F.col("s_suppkey") * 2).alias("s"), (F.col("s_suppkey") * 2 + 1).alias("e"), F.expr("timestamp_ntz'2024-01-30 00:00:00'").alias("since"), F.expr("timestamp_ntz'2024-01-30 06:00:00'").alias("upto"))
    return _store(spark, sf_dir).refresh_read(spans, "s", "e", "since", "upto", 10).select("span_id", "fresh")


def kv_batch_rww(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered operations of each user, each seeing the writes before it."""
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "put").when(F.col("event_type") == "purchase", "increment").otherwise("get")
    ops = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 100).alias("operand"))
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(1000).cast("bigint").alias("v_int"))
    return batch(ops, base).select("seq", "answer")


def kv_read_your_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of orders' lines: a transaction is an order, a key a part, a sequence a line."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("txn_id"), F.col("l_linenumber").alias("sequence"), F.col("l_quantity").alias("value"))
    intents = li.groupBy("key", "txn_id", "sequence").agg(F.max("value").alias("value"))
    committed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_retailprice").alias("value"))
    reads = intents.select("key", "txn_id", (F.col("sequence") - 2).alias("sequence")).union(intents.select("key", "txn_id", F.col("sequence") + 1)).distinct()
    return read_your_writes(committed, intents, reads)


def kv_locate_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the shards that own them; shards grow wider and wider."""
    n = F.col("n_nationkey").cast("long")
    shards = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("shard"), (n * n).alias("s"), ((n + 1) * (n + 1) - F.when(n % 7 == 6, 2).otherwise(0)).alias("e"))
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return locate(users, shards, "user_id", "s", "e").select("user_id", "shard")


def kv_locate_server(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' keys by range (a region), shard (a nation's part of it), tablet and servers."""
    r = F.col("r_regionkey").cast("long")
    ranges = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("range_id"), (r * r * 60).alias("s"), ((r + 1) * (r + 1) * 60).alias("e"))
    n, g = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    shards = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("range_id"), F.col("n_nationkey").alias("shard_id"), (n * 4).alias("tablet_id"), (g * g * 60 + n * 11).alias("s"), (g * g * 60 + n * 11 + 9).alias("e"))
    # shards of a region may overlap: the one that begins last at or before the key decides
    tablets = table(spark, sf_dir, "supplier").groupBy(F.col("s_suppkey").alias("tablet_id")).agg(F.min("s_name").alias("servers"))
    keys = table(spark, sf_dir, "customer").select("c_custkey")
    return locate_server(keys, ranges, shards, tablets, "c_custkey").select("c_custkey", "range_id", "shard_id", "tablet_id", "servers")


def kv_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys below a prefix, with the prefix stripped."""
    return scoped(table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), "c_custkey"), "Customer#").select("key", "c_custkey")


def txn_intent_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are transactions (F commits, O is pending, P aborts), lines their intents."""
    o = table(spark, sf_dir, "orders")
    status = o.select(F.col("o_orderkey").alias("txn_id"), F.when(F.col("o_orderstatus") == "F", "committed").when(F.col("o_orderstatus") == "O", "pending").otherwise("aborted").alias("status"), F.lit(0).alias("epoch"), F.col("o_orderkey").alias("commit_ts"))
    intents = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("txn_id"), F.col("l_partkey").alias("key"), F.col("l_linenumber").alias("sequence")).agg(F.max("l_quantity").alias("value")).withColumn("epoch", F.lit(0))
    back = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("txn_id"), F.lit(3).alias("lo"), F.lit(5).alias("hi"))
    return resolve_intents(intents, status, back)


def txn_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = _store(spark, sf_dir).latest().select(F.col("user_id").alias("key"), F.col("ts").alias("newest"))
    writes = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("key"), "ts", (F.col("event_id") % 2 == 0).alias("txn"), "event_id")
    return write_conflicts(writes, latest).select("event_id", "conflict")


def _waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer waits for another with the key of its next order's customer."""
    n = table(spark, sf_dir, "supplier")
    holder = (F.col("s_suppkey") * 7 + F.col("s_nationkey")) % 97 + 1
    return n.select(F.col("s_suppkey").alias("waiter"), holder.alias("holder"), (F.col("s_suppkey") % 3).alias("priority"), F.col("s_suppkey").alias("start_ts"))


def txn_deadlock(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return deadlocks(_waits(spark, sf_dir)).select("txn", "cycle", "restarts")


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth supplier waits for the next one, the last for the first; some also for the one before."""
    n = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5).alias("ring"))
    line = W.partitionBy("ring").orderBy("s_suppkey")
    first, following = F.min("s_suppkey").over(W.partitionBy("ring")), F.lead("s_suppkey").over(line)
    back = F.when(F.col("s_suppkey") % 11 == 0, F.lag("s_suppkey").over(line))
    n = n.select("s_suppkey", F.array(F.coalesce(following, first), back).alias("holders"))
    return n.select(F.col("s_suppkey").alias("waiter"), F.explode("holders").alias("holder"), (F.col("s_suppkey") % 3).alias("priority"), F.col("s_suppkey").alias("start_ts"))


def txn_deadlock_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadlocks of cycles that grow with the table."""
    shared_dir(spark)
    return deadlocks(_rings(spark, sf_dir)).select("txn", "cycle", "restarts")


def _committed(spark: SparkSession, sf_dir: str) -> SnapshotTable:
    """The nations' keys by name, put in one transaction a region."""
    at = SnapshotTable(spark, work_dir(spark, "txn"))
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25
    for k in sorted({r.n_regionkey for r in rows}):
        txn = Txn(spark, at, 10 * (k + 1))
        for r in rows:
            if r.n_regionkey == k:
                txn.put(r.n_name, r.n_nationkey)
        txn.commit()
    return at


def txn_commit_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions one after another: puts, deletions and increments, and what is left."""
    at = _committed(spark, sf_dir)
    for k, r in enumerate(table(spark, sf_dir, "nation").orderBy("n_nationkey").limit(4).collect()):
        txn = Txn(spark, at, 1000 * (k + 1))
        txn.put(r.n_name, None) if k % 2 else txn.increment(r.n_name, 100)
        txn.increment("all", 1)
        txn.commit()
    return Txn(spark, at, 10**6).scan("A", "zzz")


def txn_scan_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan inside a transaction: what is committed, under the transaction's own writes."""
    txn = Txn(spark, _committed(spark, sf_dir), 1000)
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():  # 25
        if r.n_regionkey == 0:
            txn.put(r.n_name, None)
        elif r.n_regionkey == 1:
            txn.increment(r.n_name, 100)
        elif r.n_regionkey == 2:
            txn.put(r.n_name + "_own", -1)
    return txn.scan("B", "V")


def txn_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers of each level see of a write that comes between their two reads."""
    at = _committed(spark, sf_dir)
    readers = {level: Txn(spark, at, level=level) for level in ("inconsistent", "snapshot")}
    readers["transactional"] = Txn(spark, at, 1000)
    for r in readers.values():
        r.scan("A", "zzz").count()
    late = Txn(spark, at, 2000)
    late.put("LATE", 1)
    late.commit()
    out = None
    for level, r in readers.items():
        n = r.scan("A", "zzz").agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def txn_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction that is aborted leaves nothing; begun again it writes in a later epoch."""
    at = _committed(spark, sf_dir)
    txn = Txn(spark, at, 1000)
    for r in table(spark, sf_dir, "nation").collect():  # 25
        txn.put(r.n_name, -5)
    txn.abort()
    txn.put("AGAIN", txn.epoch)
    txn.commit()
    return Txn(spark, at, 10**6).scan("A", "zzz")


def txn_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' transactions whose last heartbeat (a view or a click) is more than two days old."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    txns = e.groupBy(F.col("user_id").alias("txn_id")).agg(F.min("at").alias("started")).withColumn("status", F.when(F.col("txn_id") % 3 == 0, "committed").otherwise("pending"))
    beats = e.where("event_type IN ('view', 'click')").select(F.col("user_id").alias("txn_id"), "at")
    return expire(txns, beats, 1_706_572_800, 2 * 86400).select("txn_id", "status_now")


def txn_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locks of users' keys: purchases and signups write and hold for minutes, others read."""
    e = table(spark, sf_dir, "events")
    asks = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("txn_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("arrive"), (F.col("event_id") % 50 * 300).alias("hold"), F.col("event_type").isin("purchase", "signup").alias("write"))
    return lock_queue(asks).select("txn_id", "granted", "released", "waited_for")


def span_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of half an hour from each event of a user, merged."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = table(spark, sf_dir, "events").select("user_id", at.alias("s"), (at + 1_800_000_000).alias("e"))
    return merge_spans(spans, ["user_id"], "s", "e")


def span_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping spans of all events, cut into disjoint ones with the latest stamp of each: no key."""
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    spans = table(spark, sf_dir, "events").select(at.alias("s"), (at + F.col("user_id") * 60 + 1).alias("e"), F.pmod(F.col("event_id") * 7919, F.lit(10007)).alias("stamp"))
    return split_spans(spans, [], "s", "e", ["stamp"]).select("s", "e", "stamp")


def fence_push(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes of users' events pushed behind reads of spans around their keys."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    writes = e.where("event_type = 'purchase'").select("event_id", (F.col("event_id") % 5).alias("writer"), F.col("user_id").alias("key"), "at")
    reads = e.where("event_type = 'signup'").select((F.col("event_id") % 5).alias("reader"), F.col("user_id").alias("s"), (F.col("user_id") + 3).alias("e"), F.col("at").alias("read_at"))
    newest = reads.groupBy("reader", "s", "e").agg(F.max("read_at").alias("read_at"))
    return push_over_fences(writes, newest, "key", "at", "s", "e", "read_at", 4).select("event_id", "pushed_ts")


_ALL = (kv_snapshot_get, kv_get_keys, kv_find_ceiling, kv_find_each, kv_scan_page, kv_put_if_absent, kv_put_first, kv_find_all, kv_put_expect, kv_batch_mixed, kv_default_time, kv_increment, kv_refresh_read, kv_batch_rww, kv_read_your_write, kv_locate_shard, kv_locate_server, kv_scoped, txn_intent_resolve, txn_conflicts, txn_deadlock, txn_deadlock_rings, txn_commit_loop, txn_scan_own, txn_levels, txn_abort, txn_expire, txn_locks, span_merge, span_split, fence_push)
QUERIES = {f.__name__: f for f in _ALL}

_SNAP = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events {}) WHERE rn = 1)"
_THEN = _SNAP.format("WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'")
_NOW = _SNAP.format("")
ORACLE = {
    "kv_snapshot_get": f"SELECT user_id, value FROM {_THEN} WHERE event_type <> 'error'",
    "kv_get_keys": f"SELECT user_id, value FROM {_THEN} WHERE event_type <> 'error' AND user_id IN (3, 5, 8, 13, 21)",
    "kv_find_ceiling": f"SELECT user_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM {_THEN} WHERE user_id >= 40 ORDER BY user_id LIMIT 1",
    "kv_find_each": "SELECT c_custkey, (SELECT min(user_id) FROM events WHERE user_id >= c_custkey) AS found FROM customer",
    "kv_scan_page": f"SELECT user_id, value, CAST(CASE WHEN rn2 <= 12 THEN 1 ELSE 2 END AS int) AS page FROM (SELECT user_id, value, row_number() OVER (ORDER BY user_id) AS rn2 FROM {_THEN} WHERE event_type <> 'error' AND user_id >= 10 AND user_id < 100) WHERE rn2 <= 24",
    "kv_put_if_absent": f"SELECT s_suppkey AS user_id, s_suppkey NOT IN (SELECT user_id FROM {_NOW} WHERE event_type <> 'error') AS applied FROM supplier",
    "kv_put_first": f"SELECT e.event_id, n.event_type = 'error' AND e.event_id = min(e.event_id) OVER (PARTITION BY e.user_id) AS applied FROM events e JOIN {_NOW} n ON n.user_id = e.user_id",
    "kv_find_all": "SELECT l_orderkey, key AS found, key AS found_too FROM (SELECT DISTINCT l_orderkey FROM lineitem) ASOF LEFT JOIN (SELECT DISTINCT o_custkey * 3 AS key FROM orders) ON l_orderkey <= key",
    "kv_batch_mixed": """WITH s AS (SELECT s_suppkey AS key, s_nationkey AS value, s_nationkey <> 3 AS alive FROM supplier), n AS (SELECT n_nationkey AS n FROM nation)
      SELECT n, coalesce((SELECT CAST(value AS varchar) FROM s WHERE key = n AND alive), 'None') AS got, CAST(coalesce((SELECT value FROM s WHERE key = n AND alive), 0) + 5 AS varchar) AS counted,
        '(' || n || ', ' || (coalesce((SELECT value FROM s WHERE key = n AND alive), 0) + 5) || ')' AS found, '9' AS gone, '(' || n || ', None)' AS found_gone,
        '([' || coalesce((SELECT string_agg('(' || key || ', ' || value || ')', ', ' ORDER BY key) FROM (SELECT key, value FROM s WHERE key > n AND key < n + 40 AND alive ORDER BY key LIMIT 2)), '') || '], ' ||
          coalesce((SELECT CAST(key AS varchar) FROM s WHERE key > n AND key < n + 40 AND alive ORDER BY key LIMIT 1 OFFSET 2), 'None') || ')' AS page,
        CASE WHEN EXISTS (SELECT 1 FROM s WHERE key >= n AND key < n + 3) THEN 'False' ELSE 'True' END AS fresh, false AS alive FROM n""",
    "kv_default_time": "SELECT event_id, CASE WHEN event_type <> 'view' THEN epoch_us(ts) ELSE 1800000000000000 END AS \"at\" FROM events",
    "kv_put_expect": f"SELECT b.user_id, coalesce(n.event_type <> 'error' AND n.ts = b.expected, false) AS applied FROM (SELECT user_id, max(ts) AS expected FROM events WHERE event_type = 'purchase' GROUP BY user_id) b JOIN {_NOW} n ON n.user_id = b.user_id",
    "kv_increment": "SELECT event_id, CAST(coalesce(s_suppkey, 0) + sum(event_id % 7) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS value_after FROM events LEFT JOIN supplier ON s_suppkey = user_id",
    "kv_refresh_read": "SELECT s_suppkey AS span_id, NOT EXISTS (SELECT 1 FROM events WHERE user_id >= s_suppkey * 2 AND user_id < s_suppkey * 2 + 1 AND ts > TIMESTAMP '2024-01-30 00:00:00' AND ts <= TIMESTAMP '2024-01-30 06:00:00') AS fresh FROM supplier",
    "kv_batch_rww": """WITH o AS (SELECT user_id AS key, event_id AS seq, event_id % 100 AS operand, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'put' WHEN 'purchase' THEN 'increment' ELSE 'get' END AS op FROM events),
      b AS (SELECT *, (SELECT max(s.seq) FROM o s WHERE s.key = o.key AND s.seq <= o.seq AND s.op IN ('put', 'delete')) AS began FROM o),
      c AS (SELECT b.*, CASE WHEN began IS NULL THEN (SELECT 1000 FROM supplier WHERE s_suppkey = b.key) ELSE (SELECT CASE WHEN s.op = 'put' THEN s.operand END FROM o s WHERE s.seq = b.began) END AS origin,
        sum(CASE WHEN op = 'increment' THEN operand END) OVER (PARTITION BY key, began ORDER BY seq) AS added FROM b)
      SELECT seq, CAST(CASE WHEN op = 'delete' THEN NULL WHEN added IS NULL THEN origin ELSE coalesce(origin, 0) + added END AS bigint) AS answer FROM c""",
    "kv_read_your_write": """WITH i AS (SELECT l_partkey AS key, l_orderkey AS txn_id, l_linenumber AS sequence, max(l_quantity) AS value FROM lineitem GROUP BY ALL),
      r AS (SELECT DISTINCT key, txn_id, sequence FROM (SELECT key, txn_id, sequence - 2 AS sequence FROM i UNION ALL SELECT key, txn_id, sequence + 1 FROM i))
      SELECT key, txn_id, sequence, value FROM (SELECT r.key, r.txn_id, r.sequence, coalesce(i.value, p.p_retailprice) AS value, row_number() OVER (PARTITION BY r.key, r.txn_id, r.sequence ORDER BY i.sequence DESC NULLS LAST) AS rn
      FROM r LEFT JOIN i ON i.key = r.key AND i.txn_id = r.txn_id AND i.sequence <= r.sequence LEFT JOIN part p ON p.p_partkey = r.key) WHERE rn = 1""",
    "kv_locate_shard": "SELECT u.user_id, n_nationkey AS shard FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN nation ON u.user_id >= n_nationkey * n_nationkey AND u.user_id < (n_nationkey + 1) * (n_nationkey + 1) - CASE WHEN n_nationkey % 7 = 6 THEN 2 ELSE 0 END",
    "kv_locate_server": """WITH a AS (SELECT c_custkey, r_regionkey AS range_id FROM customer LEFT JOIN region ON c_custkey >= r_regionkey * r_regionkey * 60 AND c_custkey < (r_regionkey + 1) * (r_regionkey + 1) * 60),
      b AS (SELECT a.*, n_nationkey, row_number() OVER (PARTITION BY c_custkey ORDER BY n_nationkey DESC NULLS LAST) AS rn FROM a LEFT JOIN nation ON n_regionkey = range_id AND c_custkey >= n_regionkey * n_regionkey * 60 + n_nationkey * 11),
      c AS (SELECT c_custkey, range_id, CASE WHEN c_custkey < range_id * range_id * 60 + n_nationkey * 11 + 9 THEN n_nationkey END AS shard_id FROM b WHERE rn = 1)
      SELECT c_custkey, range_id, shard_id, CAST(shard_id * 4 AS bigint) AS tablet_id, s_name AS servers FROM c LEFT JOIN supplier ON s_suppkey = shard_id * 4""",
    "kv_scoped": "SELECT substr(c_name, 10) AS key, c_custkey FROM customer WHERE starts_with(c_name, 'Customer#')",
    "txn_intent_resolve": """WITH i AS (SELECT l_orderkey AS txn_id, l_partkey AS key, l_linenumber AS sequence, max(l_quantity) AS value FROM lineitem GROUP BY ALL)
      SELECT key, txn_id, txn_id AS commit_ts, value FROM (SELECT i.*, row_number() OVER (PARTITION BY key, txn_id ORDER BY sequence DESC) AS rn FROM i JOIN orders ON o_orderkey = txn_id
        WHERE o_orderstatus = 'F' AND NOT (txn_id % 5 = 0 AND sequence >= 3 AND sequence < 5)) WHERE rn = 1""",
    "txn_conflicts": f"SELECT e.event_id, CASE WHEN e.event_id % 2 = 0 THEN e.ts <= n.ts ELSE e.ts < n.ts END AS conflict FROM events e JOIN {_NOW} n ON n.user_id = e.user_id WHERE e.event_type = 'view'",
    "txn_deadlock": """WITH RECURSIVE w AS (SELECT s_suppkey AS waiter, (s_suppkey * 7 + s_nationkey) % 97 + 1 AS holder FROM supplier),
      p(a, b) AS (SELECT waiter, holder FROM w UNION SELECT p.a, w.holder FROM p JOIN w ON w.waiter = p.b),
      mates AS (SELECT x.a AS txn, x.b AS mate FROM p x JOIN p y ON x.a = y.b AND x.b = y.a),
      c AS (SELECT txn, min(mate) AS cycle FROM mates GROUP BY txn)
      SELECT txn, cycle, row_number() OVER (PARTITION BY cycle ORDER BY txn % 3 DESC, txn DESC) = 1 AS restarts FROM c""",
    "txn_deadlock_rings": """SELECT s_suppkey AS txn, min(s_suppkey) OVER (PARTITION BY s_suppkey % 5) AS cycle,
      row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey % 3 DESC, s_suppkey DESC) = 1 AS restarts FROM supplier""",
    "txn_commit_loop": """SELECT n_name AS key, CAST(n_nationkey + CASE WHEN n_nationkey IN (0, 2) THEN 100 ELSE 0 END AS bigint) AS value FROM nation WHERE n_nationkey NOT IN (1, 3) UNION ALL SELECT 'all', 4""",
    "txn_scan_own": """SELECT * FROM (SELECT n_name AS key, CAST(n_nationkey + CASE WHEN n_regionkey = 1 THEN 100 ELSE 0 END AS bigint) AS value FROM nation WHERE n_regionkey <> 0
      UNION ALL SELECT n_name || '_own', -1 FROM nation WHERE n_regionkey = 2) WHERE key >= 'B' AND key < 'V'""",
    "txn_levels": "SELECT level, count(*) + CASE WHEN level = 'inconsistent' THEN 1 ELSE 0 END AS n FROM nation, (VALUES ('inconsistent'), ('snapshot'), ('transactional')) l(level) GROUP BY level",
    "txn_abort": "SELECT n_name AS key, CAST(n_nationkey AS bigint) AS value FROM nation UNION ALL SELECT 'AGAIN', 1",
    "txn_expire": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS bigint) AS t, event_type IN ('view', 'click') AS beat FROM events)
      SELECT user_id AS txn_id, CASE WHEN user_id % 3 = 0 THEN 'committed' WHEN greatest(min(t), coalesce(max(CASE WHEN beat THEN t END), min(t))) + 172800 < 1706572800 THEN 'aborted' ELSE 'pending' END AS status_now FROM e GROUP BY user_id""",
    "txn_locks": """WITH RECURSIVE a AS (SELECT user_id AS key, event_id AS txn, CAST(floor(epoch(ts)) AS bigint) AS t, event_id % 50 * 300 AS hold, event_type IN ('purchase', 'signup') AS w FROM events),
      q AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, txn) AS i FROM a),
      r(key, txn, i, granted, waited_for, w, free, last) AS (
        SELECT key, txn, i, t, CAST(NULL AS bigint), w, CASE WHEN w THEN t + hold END, CASE WHEN w THEN txn END FROM q WHERE i = 1
        UNION ALL SELECT q.key, q.txn, q.i, greatest(q.t, coalesce(r.free, q.t)), CASE WHEN r.free > q.t THEN r.last END, q.w,
          CASE WHEN q.w THEN greatest(q.t, coalesce(r.free, q.t)) + q.hold ELSE r.free END, CASE WHEN q.w THEN q.txn ELSE r.last END FROM r JOIN q ON q.key = r.key AND q.i = r.i + 1)
      SELECT txn AS txn_id, granted, CASE WHEN w THEN free END AS released, waited_for FROM r""",
    "span_merge": """WITH s AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 1800000000 AS e FROM events), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
      g AS (SELECT *, sum(CASE WHEN s <= before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, island""",
    "span_split": """WITH sp AS (SELECT CAST(floor(epoch(ts)) AS bigint) AS s, CAST(floor(epoch(ts)) AS bigint) + user_id * 60 + 1 AS e, event_id * 7919 % 10007 AS stamp FROM events),
      c AS (SELECT s AS x FROM sp UNION SELECT e FROM sp), p AS (SELECT x, lead(x) OVER (ORDER BY x) AS y FROM c), h AS (SELECT x, y, max(stamp) AS stamp FROM p JOIN sp ON s <= x AND e >= y GROUP BY x, y),
      g AS (SELECT *, CASE WHEN lag(y) OVER (ORDER BY x) = x AND lag(stamp) OVER (ORDER BY x) = stamp THEN 0 ELSE 1 END AS fresh FROM h), k AS (SELECT *, sum(fresh) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS island FROM g)
      SELECT min(x) AS s, max(y) AS e, max(stamp) AS stamp FROM k GROUP BY island""",
    "fence_push": """WITH w AS (SELECT event_id, event_id % 5 AS writer, user_id AS key, epoch_us(ts) AS tt FROM events WHERE event_type = 'purchase'), r AS (SELECT event_id % 5 AS reader, user_id AS s, user_id + 3 AS e, max(epoch_us(ts)) AS read_at FROM events WHERE event_type = 'signup' GROUP BY ALL)
      SELECT event_id, greatest(max(tt), coalesce(max(read_at) + 1, 0)) AS pushed_ts FROM w LEFT JOIN r ON key >= s AND key < e AND reader <> writer GROUP BY event_id""",
}
