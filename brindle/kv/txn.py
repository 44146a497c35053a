"""Transactions over versions: intents, conflicts, read fences, deadlocks, optimistic commits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.kv.clock import HybridClock
from brindle.operators.relational import range_join
from brindle.operators.skew import Line, lookup_join
from brindle.sources.manifest import ConflictError, SnapshotTable
from brindle.sources.shared import shared_dir, ship_code, work_dir


def resolve_intents(intents: DataFrame, status: DataFrame, rolled_back: DataFrame | None = None) -> DataFrame:
    """The versions that finished transactions leave: key, commit_ts, value.

    ``intents``: txn_id, epoch, sequence, key, value (null deletes). ``status``: txn_id,
    status, epoch, commit_ts. Only committed transactions' intents of their last epoch count;
    of one key the newest sequence that no range of ``rolled_back`` (txn_id, lo, hi: lo <= seq
    < hi) holds. Others leave nothing.
    """
    done = status.where(F.col("status") == "committed").select("txn_id", "epoch", "commit_ts")
    kept = intents.join(done, ["txn_id", "epoch"])
    if rolled_back is not None:
        bad = rolled_back.select(F.col("txn_id").alias("__txn"), "lo", "hi")
        kept = kept.join(bad, (F.col("txn_id") == F.col("__txn")) & (F.col("sequence") >= F.col("lo")) & (F.col("sequence") < F.col("hi")), "left_anti")
    last = kept.groupBy("key", "txn_id", "commit_ts").agg(F.max(F.struct("sequence", "value")).alias("w"))
    return last.select("key", "txn_id", "commit_ts", F.col("w.value").alias("value"))


def write_conflicts(writes: DataFrame, latest: DataFrame) -> DataFrame:
    """Adds ``conflict`` to writes (key, ts, txn): a plain write must not be older than the
    newest version (key, newest), a transactional one must be newer."""
    both = writes.join(latest.select(F.col("key").alias("__key"), "newest"), F.col("key") == F.col("__key"), "left").drop("__key")
    late = F.when(F.col("txn"), F.col("ts") <= F.col("newest")).otherwise(F.col("ts") < F.col("newest"))
    return both.withColumn("conflict", F.coalesce(late, F.lit(False))).drop("newest")


def push_over_fences(writes: DataFrame, reads: DataFrame, key: str, ts: str, start: str, end: str, read_ts: str, width: int) -> DataFrame:
    """Adds ``pushed_ts``: writes under a key that someone else has read later move behind it.

    ``reads``: reader, spans [start, end) and their time; ``writes``: writer, key and time.
    """
    ids = writes.withColumn("__w", F.monotonically_increasing_id())
    hits = range_join(ids.select("__w", "writer", F.col(key).alias("__k")), reads, "__k", start, end, width).where(~F.col("writer").eqNullSafe(F.col("reader")))
    fence = hits.groupBy("__w").agg((F.max(read_ts) + 1).alias("__fence"))
    return ids.join(fence, "__w", "left").withColumn("pushed_ts", F.greatest(ts, "__fence")).drop("__w", "__fence")


#: Layers that are peeled off before chains are contracted; more of them cost rows, not results.
PEEL_ROUNDS = 4
#: Waits between branching transactions that one task walks over; about 350 bytes each.
ONE_TASK_WAITS = 1_000_000


def _strong(waiter: list[int], holder: list[int], n: int) -> list[int]:
    """The number of each node's strongly connected component, -1 off all cycles."""
    begins = [0] * (n + 1)
    for v in waiter:
        begins[v + 1] += 1
    for v in range(n):
        begins[v + 1] += begins[v]
    at, to = begins[:n], [0] * len(holder)
    alone = [True] * n
    for v, w in zip(waiter, holder, strict=True):
        to[at[v]] = w
        at[v] += 1
        if v == w:
            alone[v] = False
    at = begins[:n]
    seen, low, component, open_, clock = [0] * n, [0] * n, [-1] * n, [], 0
    done = bytearray(n)
    for root in range(n):
        if seen[root]:
            continue
        clock += 1
        seen[root] = low[root] = clock
        open_.append(root)
        path = [root]
        while path:
            v = path[-1]
            if at[v] < begins[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not seen[w]:
                    clock += 1
                    seen[w] = low[w] = clock
                    open_.append(w)
                    path.append(w)
                elif not done[w] and seen[w] < low[v]:
                    low[v] = seen[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == seen[v]:
                single = open_[-1] == v and alone[v]
                while True:
                    w = open_.pop()
                    done[w] = 1
                    if not single:
                        component[w] = v
                    if w == v:
                        break
    return component


def _walk(batches: Iterator) -> Iterator:
    """``_strong`` over all batches of one task: waiter and holder in, txn and its component's number out."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    waits = pa.Table.from_batches(held)
    both = pa.chunked_array([*waits["waiter"].chunks, *waits["holder"].chunks]).combine_chunks().dictionary_encode()
    numbers = both.indices.to_pylist()
    component = _strong(numbers[: waits.num_rows], numbers[waits.num_rows :], len(both.dictionary))
    for b in pa.table({"txn": both.dictionary, "number": pa.array(component, pa.int64())}).to_batches(max_chunksize=10_000):
        yield b.filter(pc.greater_equal(b["number"], 0))


def _kept(df: DataFrame) -> DataFrame:
    """Written and read again; after many rounds a checkpoint's plan would still carry all their constraints."""
    path = work_dir(df.sparkSession, "waits")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _greatest(waits: DataFrame, source: str, target: str) -> DataFrame:
    """``v`` and ``top``: the greatest transaction, or ``v`` itself, from which ``v`` is reached.

    Each round goes on over one wait and then as far as the one found so far has come. The
    order is that of a hash, so a line of waits in the order of its numbers takes few rounds.
    """
    ends = waits.select(F.col(source).alias("v")).unionByName(waits.select(F.col(target).alias("v"))).distinct()
    top = _kept(ends.withColumn("top", F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("v"))))
    none = F.lit(None).cast(top.schema["top"].dataType)
    while True:
        step = waits.join(top.select(F.col("v").alias(source), "top"), source).select(F.col(target).alias("v"), "top", none.alias("__was"))
        best = top.withColumn("__was", F.col("top")).unionByName(step).groupBy("v").agg(F.max("top").alias("top"), F.max("__was").alias("__was"))
        far = top.select(F.col("v").alias("__at"), F.col("top").alias("__far"))
        both = lookup_join(best.withColumn("__at", F.col("top.v")), far, ["__at"])
        top = _kept(both.select("v", F.greatest("top", "__far").alias("top"), "__was"))
        moved = top.where("top <> __was").limit(1).count()
        top = top.select("v", "top")
        if not moved:
            return top


def _components(waits: DataFrame) -> DataFrame:
    """``txn`` and ``group`` (the least of all that reach each other) of each one on a cycle.

    Whom the same transaction reaches last can only be on a cycle with each other. Of them,
    those that reach it too are on its cycle, and are done with; what is left of the waits
    between the others is taken apart again, until it fits one task.
    """
    parts, waits = [], _kept(waits)
    while waits.count() > ONE_TASK_WAITS:
        down = _greatest(waits, "waiter", "holder")
        a, b = down.select(F.col("v").alias("waiter"), F.col("top").alias("t1")), down.select(F.col("v").alias("holder"), F.col("top").alias("t2"))
        inner = _kept(waits.join(a, "waiter").join(b, "holder").where("t1 = t2").select("waiter", "holder", F.col("t1").alias("top")))
        up = _greatest(inner.select("waiter", "holder"), "holder", "waiter").withColumnRenamed("top", "up")
        # who reaches the one that reaches it; alone, it has a wait for itself or is on no cycle
        sides = _kept(inner.join(up.select(F.col("v").alias("waiter"), F.col("up").alias("u1")), "waiter").join(up.select(F.col("v").alias("holder"), F.col("up").alias("u2")), "holder").where("u1 = u2"))
        mine = sides.where("u1 = top").select(F.col("waiter").alias("txn"), "top").distinct()
        parts.append(mine.join(mine.groupBy("top").agg(F.min("txn").alias("group")), "top").select("txn", "group"))
        waits = _kept(sides.where("u1 <> top").select("waiter", "holder"))
    kind = waits.schema["waiter"].dataType.simpleString()
    ship_code(waits.sparkSession)
    walked = _kept(waits.repartition(1).mapInArrow(_walk, f"txn {kind}, number bigint"))
    core = walked.join(walked.groupBy("number").agg(F.min("txn").alias("group")), "number").select("txn", "group")
    for p in parts:
        core = core.unionByName(p)
    return core


def deadlocks(waits: DataFrame) -> DataFrame:
    """Transactions that wait for themselves: ``txn``, ``cycle`` (the least of all that wait for
    each other), and ``restarts`` for the cycle's loser.

    ``waits``: waiter, holder and, of the waiter, priority, start_ts. Three steps, each of them
    in rounds whose number grows with the logarithm of a path's length, until nothing changes:

    1. Who doesn't wait, or isn't waited for, is on no cycle and is peeled off, PEEL_ROUNDS times.
       Longer dead ends go on to the next steps, which find no cycle on them.
    2. Whoever waits for one transaction and is waited for by one is a link of a chain. Chains
       are contracted by jumping over twice as many links a round, one row a transaction. A ring
       of links alone is a cycle and is done with.
    3. What is left are the transactions where waits branch. Those that reach each other are on
       one cycle, and so are the links of chains between them. One task finds them in a single
       walk (Tarjan's) over at most ONE_TASK_WAITS waits; while there are more, they are taken
       apart by who is reached from where, in rounds that each read the waits once.

    Of a cycle the greatest (priority, start_ts, txn) restarts: at equal priority the older one
    wins. Each round is cut off from the plan by a checkpoint in the shared folder.
    """
    shared_dir(waits.sparkSession)
    edges = waits.select("waiter", "holder").where(F.col("waiter").isNotNull() & F.col("holder").isNotNull()).distinct().checkpoint()
    size = -1
    for _ in range(PEEL_ROUNDS):
        if (now := edges.count()) == size:
            break
        size = now
        edges = edges.join(edges.select(F.col("waiter").alias("holder")).distinct(), "holder", "left_semi").join(edges.select(F.col("holder").alias("waiter")).distinct(), "waiter", "left_semi").checkpoint()
    into = edges.groupBy(F.col("holder").alias("v")).agg(F.count(F.lit(1)).alias("n_in"))
    out = edges.groupBy(F.col("waiter").alias("v")).agg(F.count(F.lit(1)).alias("n_out"), F.min("holder").alias("next"))
    links = into.join(out, "v").where("n_in = 1 AND n_out = 1").select("v", "next").checkpoint()
    # jump: v to the first that is no link, or on around a ring; least: of all that v has passed
    jump, moved = links.select("v", "next", F.least("v", "next").alias("least")), True
    total = links.count()
    reach = 1
    while moved and total:
        ahead = jump.select(F.col("v").alias("next"), F.col("next").alias("n2"), F.col("least").alias("l2"))
        jump = jump.join(ahead, "next", "left").select("v", F.coalesce("n2", "next").alias("next"), F.least("least", F.coalesce("l2", "least")).alias("least"), F.col("n2").isNotNull().alias("on")).checkpoint()
        reach *= 2
        moved = reach <= 2 * total and bool(jump.where("on").limit(1).count())
    # after more steps than there are links, who still stands on a link goes round a ring
    rings = jump.join(links.select(F.col("v").alias("next")), "next", "left_semi").select(F.col("v").alias("txn"), F.col("least").alias("cycle"))
    chains = jump.join(links.select(F.col("v").alias("next")), "next", "left_anti").select("v", F.col("next").alias("end"))
    branching = edges.join(links.select(F.col("v").alias("waiter")), "waiter", "left_anti")
    short = branching.join(chains.select(F.col("v").alias("holder"), "end"), "holder", "left").select("waiter", F.coalesce("end", "holder").alias("holder"), F.when(F.col("end").isNotNull(), F.col("holder")).alias("via")).checkpoint()
    core = _components(short.select("waiter", "holder").distinct())
    # a chain lies on a cycle if the two that it joins do
    owner = core.select(F.col("txn").alias("waiter"), F.col("group").alias("g1")).join(short.where("via IS NOT NULL"), "waiter").join(core.select(F.col("txn").alias("holder"), F.col("group").alias("g2")), "holder").where("g1 = g2").select(F.col("via").alias("first"), F.col("g1").alias("group"))
    # every link of a chain goes to the chain's end, and so does its first one: they share it
    first = chains.select(F.col("v").alias("first"), "end")
    heads = owner.join(first, "first").select("first", "end", "group")
    # links of one chain are found from its first by doubling, as pairs (first, link)
    walk = heads.select("first", F.col("first").alias("at"), "group")
    found, hops = walk.checkpoint(), links.select(F.col("v").alias("at"), "next")
    size = -1
    while (now := found.count()) != size:
        size = now
        step = found.join(hops, "at").select("first", F.col("next").alias("at"), "group")
        step = step.join(links.select(F.col("v").alias("at")), "at", "left_semi").select("first", "at", "group")
        found = found.unionByName(step).distinct().checkpoint()
        hops = hops.join(hops.select(F.col("at").alias("next"), F.col("next").alias("n2")), "next").select("at", F.col("n2").alias("next")).checkpoint()
    members = core.unionByName(found.select(F.col("at").alias("txn"), "group"))
    named = members.join(members.groupBy("group").agg(F.min("txn").alias("cycle")), "group").select("txn", "cycle").unionByName(rings)
    rank = waits.where(F.col("waiter").isNotNull()).groupBy(F.col("waiter").alias("txn")).agg(F.max(F.struct("priority", "start_ts")).alias("r"))
    ranked = named.join(rank, "txn")
    loser = ranked.groupBy("cycle").agg(F.max(F.struct("r", "txn")).alias("l")).select("cycle", F.col("l.txn").alias("loser"))
    return ranked.join(loser, "cycle").select("txn", "cycle", (F.col("txn") == F.col("loser")).alias("restarts"))


def lock_queue(requests: DataFrame, key: str = "key", txn: str = "txn_id", arrive: str = "arrive", hold: str = "hold", write: str = "write") -> DataFrame:
    """Adds ``granted``, ``released`` and ``waited_for`` to requests for keys' locks.

    Writers of a key take its lock one after another, in order of arrival (then of ``txn``),
    and keep it for ``hold``; a reader takes none and waits for the writers that came before
    it. ``waited_for`` is the writer that has the lock until the request is granted, null if it
    was free. A transaction's later requests of a key that it asked for as a writer find its
    own lock: they are granted with the first or on arrival, whichever is later.

    A lock is free for a writer at the latest, over all writers j before it, of j's arrival and
    what the writers from j on hold it; that is a running maximum of arrivals less the sums of
    holds so far. So a key with a third of all requests is the work of many tasks.
    """
    own = requests.where(F.col(write)).groupBy(key, txn).agg(F.min(F.struct(arrive, hold)).alias("__o")).select(key, txn, F.col(f"__o.{arrive}").alias("__at"), F.col(f"__o.{hold}").alias("__hold"))
    others = lookup_join(requests, own.select(key, txn, F.col("__at").alias("__mine")), [key, txn]).where(F.col("__mine").isNull() | ~F.col(write) & (F.col(arrive) < F.col("__mine")))
    asks = others.select(key, txn, F.col(arrive).alias("__at"), F.lit(None).cast("long").alias("__hold")).distinct()
    line = Line(own.unionByName(asks), [key], ["__at", txn])
    # the holds before each row; a reader adds nothing
    rows = line.running(line.rows, F.coalesce("__hold", F.lit(0)).cast("long"), "sum", "__before", inclusive=False)
    rows = rows.withColumn("__before", F.coalesce("__before", F.lit(0)))
    rows = line.running(rows, F.when(F.col("__hold").isNotNull(), F.col("__at") - F.col("__before")), "max", "__slack", inclusive=False)
    rows = line.running(rows, F.when(F.col("__hold").isNotNull(), F.col(txn)), "last", "__last", inclusive=False)
    free = F.coalesce(F.col("__slack") + F.col("__before"), F.col("__at"))
    done = rows.select(key, txn, "__at", F.col("__hold").isNotNull().alias("__w"), F.greatest("__at", free).alias("__granted"), F.when(free > F.col("__at"), F.col("__last")).alias("__for"), "__hold")
    mine = done.where("__w").select(key, txn, F.col("__at").alias("__first"), F.col("__granted").alias("__g1"), F.col("__for").alias("__f1"), (F.col("__granted") + F.col("__hold")).alias("__r1"))
    read = done.where("NOT __w").select(key, txn, F.col("__at").alias(arrive), F.col("__granted").alias("__g2"), F.col("__for").alias("__f2"))
    both = lookup_join(lookup_join(requests, mine, [key, txn]), read, [key, txn, arrive])
    under = F.col("__g1").isNotNull() & F.col("__g2").isNull()
    granted = F.when(under, F.greatest(F.col(arrive), F.col("__g1"))).otherwise(F.col("__g2"))
    return both.select(*requests.columns, granted.alias("granted"), F.when(under & F.col(write), F.col("__r1")).alias("released"), F.when(under, F.when(F.col("__g1") > F.col(arrive), F.col("__f1"))).otherwise(F.col("__f2")).alias("waited_for"))


def expire(txns: DataFrame, heartbeats: DataFrame, now: int, interval: int) -> DataFrame:
    """Adds ``status_now``: a pending transaction without a heartbeat for ``interval`` is aborted.

    ``txns``: txn_id, status, started. ``heartbeats``: txn_id, at; many rows each.
    """
    last = heartbeats.groupBy("txn_id").agg(F.max("at").alias("__last"))
    dead = (F.col("status") == "pending") & (F.greatest("started", "__last") + interval < F.lit(now))
    return txns.join(last, "txn_id", "left").withColumn("status_now", F.when(dead, "aborted").otherwise(F.col("status"))).drop("__last")


class TxnAborted(RuntimeError):
    """A transaction whose reads were overtaken, or that was aborted."""


@dataclass
class Txn:
    """An optimistic transaction over a table of versions kept in a SnapshotTable.

    Rows are ``key string, ts bigint, txn_seq int, alive boolean, value bigint``. Reads are at
    the start time and are remembered; at commit all of them are validated against versions
    published since, then the writes are appended and published in one new manifest version.
    A commit that loses the race validates again on the newer version; reads that were
    overtaken raise TxnAborted.

    ``level`` is transactional (as above), snapshot (reads at one time, the start or, without
    one, that of the first read; nothing is validated and nothing can be written) or
    inconsistent (each read is at the newest time; no writes). Without ``start_ts`` the clock
    gives one.
    """

    spark: SparkSession
    table: SnapshotTable
    start_ts: int | None = None
    reads: list[tuple[str, str]] = field(default_factory=list)
    writes: dict[str, int | None] = field(default_factory=dict)
    epoch: int = 0
    level: str = "transactional"

    CLOCK = HybridClock()
    SCHEMA = "key string, ts bigint, txn_seq int, alive boolean, value bigint"

    def __post_init__(self) -> None:
        if self.level not in ("transactional", "snapshot", "inconsistent"):
            raise ValueError(f"no semantics {self.level}")
        if self.start_ts is None and self.level == "transactional":
            self.start_ts = self.CLOCK.now()

    def versions(self, version: int | None = None) -> DataFrame:
        parts = self.table.read(version).get("parts", [])
        return self.spark.read.schema(self.SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], self.SCHEMA)

    def _read(self, start: str, end: str) -> DataFrame:
        """Versions of a span that this transaction may see; the span is remembered."""
        if self.level == "inconsistent":
            return self.versions().where((F.col("key") >= start) & (F.col("key") < end))
        if self.start_ts is None:
            self.start_ts = self.table.read().get("last_ts", 0)
        if self.level == "transactional":
            self.reads.append((start, end))
        return self.versions().where((F.col("key") >= start) & (F.col("key") < end) & (F.col("ts") <= self.start_ts))

    def get(self, key: str) -> int | None:
        if key in self.writes:
            return self.writes[key]
        row = self._read(key, key + "\0").agg(F.max(F.struct("ts", "txn_seq", "alive", "value")).alias("v")).first()["v"]
        return row["value"] if row and row["alive"] else None

    def scan(self, start: str, end: str) -> DataFrame:
        """The live rows of a span, with this transaction's own writes over them."""
        last = self._read(start, end).groupBy("key").agg(F.max(F.struct("ts", "txn_seq", "alive", "value")).alias("v"))
        there = last.where("v.alive").select("key", F.col("v.value").alias("value"))
        own = {k: v for k, v in self.writes.items() if start <= k < end}
        if not own:
            return there
        new = self.spark.createDataFrame([(k, v) for k, v in sorted(own.items()) if v is not None], "key string, value bigint")
        return there.where(~F.col("key").isin(list(own))).unionByName(new)

    def put(self, key: str, value: int | None) -> None:
        if self.level != "transactional":
            raise TxnAborted(f"{self.level} reads can't write")
        self.writes[key] = value

    def increment(self, key: str, by: int) -> int:
        self.put(key, (self.get(key) or 0) + by)
        return self.writes[key]

    def abort(self) -> None:
        """Forgets everything and begins a new epoch."""
        self.reads, self.writes, self.epoch = [], {}, self.epoch + 1

    restart = abort

    def commit(self, retries: int = 10) -> int:
        """Publishes and returns the commit time: behind the start and every version so far."""
        for _ in range(retries):
            base = self.table.version()
            manifest = self.table.read(base)
            at = max(self.start_ts, manifest.get("last_ts", 0)) + 1
            if self.reads and manifest.get("last_ts", 0) > self.start_ts:
                spans = None
                for a, b in merge(self.reads):
                    hit = (F.col("key") >= a) & (F.col("key") < b)
                    spans = hit if spans is None else spans | hit
                if self.versions(base).where((F.col("ts") > self.start_ts) & spans).limit(1).count():
                    raise TxnAborted("a read was overtaken")
            if not self.writes:
                return at
            path = self.table.data_path("part")
            rows = [(k, at, i, v is not None, v) for i, (k, v) in enumerate(sorted(self.writes.items()))]
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.parquet(path)
            try:
                self.table.publish(base, {"parts": [*manifest.get("parts", []), path], "last_ts": at})
                return at
            except ConflictError:
                self.table.delete(path)
        raise ConflictError("too many writers")


def merge(spans: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Disjoint spans over the same keys, in order (a driver-side read set)."""
    out: list[tuple[str, str]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out
