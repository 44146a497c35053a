"""Versioned rows, transactions, spans and logs against brute force."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.kv import txn
from brindle.kv.batch import BatchRefused, Op, run_batch
from brindle.kv.clock import HybridClock
from brindle.kv.store import Layout, VersionedStore, batch
from brindle.kv.txn import Txn, TxnAborted, deadlocks, expire, lock_queue, merge, push_over_fences, resolve_intents
from brindle.operators import relational
from brindle.operators.relational import asof_join, merge_spans, range_join, split_spans
from brindle.operators.skew import lookup_join
from brindle.sources.manifest import SnapshotTable
from brindle.sources.shared import shared_dir, work_dir
from brindle.streaming.logs import FileLog, GapError, accept, accept_stream, accepted_rows, hybrid_clock, kafka_log, kafka_messages, kafka_records, push_late, quorum_times, replicated_reads

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
V = "key string, ts bigint, seq bigint, alive boolean, v_int bigint"
LAYOUT = Layout("key", ("ts", "seq"), ("v_int",), "alive")


def store(spark, rows):
    return VersionedStore(spark.createDataFrame(rows, V), LAYOUT)


VERSIONS = [("count0", 1, 1, True, 5), ("count1", 2, 2, True, 10), ("count2", 3, 3, True, 15), ("count1", 5, 4, False, None), ("gone", 1, 5, False, None), ("count0", 4, 6, True, 6), ("count0", 4, 7, True, 7), (None, 1, 8, True, 1)]


def test_get_find_scan(spark):
    s = store(spark, VERSIONS)
    assert {(r.key, r.v_int) for r in s.get(["count0", "count1", "x"]).collect()} == {("count0", 7)}
    assert {(r.key, r.v_int) for r in s.get(["count0", "count1"], F.lit(3)).collect()} == {("count0", 5), ("count1", 10)}
    assert [(r.key, r.v_int) for r in s.find("count", F.lit(3)).collect()] == [("count0", 5)]
    assert [(r.key, r.v_int) for r in s.find("count01").collect()] == [("count1", None)]  # a tombstone is found
    assert s.find("zz").count() == 0
    assert [r.key for r in s.scan("count", "counu", 2, F.lit(3)).collect()] == ["count0", "count1"]
    page, then = s.scan_page("count", "counu", 1)
    assert [r.key for r in page.collect()] == ["count0"] and then == "count0\0"
    page, then = s.scan_page(then, "counu", 1)
    assert [r.key for r in page.collect()] == ["count2"] and then is None


def test_find_each_is_the_ceiling(spark):
    s = store(spark, [(f"k{i:02d}", 1, i, True, i) for i in range(0, 60, 7)])
    wanted = spark.createDataFrame([(f"k{i:02d}",) for i in range(0, 70, 3)], "w string")
    have = [f"k{i:02d}" for i in range(0, 60, 7)]
    for r in s.find_each(wanted, "w").collect():
        assert r.found == min((h for h in have if h >= r.w), default=None)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_find_each_of_many_keys_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("brindle.kv.store.lookup_join", lambda *a: lookup_join(*a, max_rows=0))
    s = store(spark, [(f"k{i:02d}", 1, i, True, i) for i in range(0, 60, 7)])
    found = s.find_each(spark.createDataFrame([(f"k{i:02d}",) for i in range(0, 70, 3)] * 2, "w string"), "w")
    # the only broadcast side is the one row a task
    plan = plan_of(found)
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(f"k{i:02d}", f"k{-(-i // 7) * 7:02d}" if i <= 56 else None) for i in range(0, 70, 3)] * 2, key=str)


def test_find_all_beyond_the_bound_is_not_broadcast(spark, sf, monkeypatch):
    from brindle.plans.store import kv_find_all

    want = sorted(map(tuple, kv_find_all(spark, sf).collect()))
    monkeypatch.setattr("brindle.kv.store.lookup_join", lambda *a: lookup_join(*a, max_rows=0))
    beyond = kv_find_all(spark, sf)
    # the only broadcast side is the one row a range
    assert plan_of(beyond).count("BroadcastHashJoin") == 1 and "SortMergeJoin" in plan_of(beyond)
    assert sorted(map(tuple, beyond.collect())) == want


def test_puts_if_absent_in_one_batch(spark):
    s = store(spark, VERSIONS)
    writes = spark.createDataFrame([("new", 2, 5), ("new", 1, 6), ("new", 3, 7), ("count0", 1, 8), ("count1", 1, 9), ("same", 1, 1), ("same", 1, 1), (None, 1, 1)], "key string, n int, v int")
    got = sorted((str(r.key), r.n, r.applied) for r in s.put_if_absent(writes, ["n"]).collect())
    assert got == [("None", 1, False), ("count0", 1, False), ("count1", 1, True), ("new", 1, True), ("new", 2, False), ("new", 3, False), ("same", 1, False), ("same", 1, True)]


def test_batch_of_all_kinds(spark):
    rows = spark.createDataFrame([("a", 1, 1, True, 5), ("c", 2, 1, True, 7), ("d", 3, 1, False, None)], "key string, ts bigint, seq int, alive boolean, value bigint")
    ops = [Op("get", "a"), Op("put", "b", 3, expect=0), Op("find", "aa"), Op("increment", "b", 4), Op("scan", "a", end="z", limit=2), Op("delete", "a", expect=1), Op("scan", "a", end="z", limit=9), Op("find", "cc"), Op("refresh", "a", end="z", since=3), Op("put", "d", 1, expect=0)]
    answers, written = run_batch(spark, rows, ops, 9)
    assert answers == [5, 9, ("b", 3), 7, ([("a", 5), ("b", 7)], "c"), 9, ([("b", 7), ("c", 7)], None), ("d", None), True, 9]
    assert {(r.key, r.alive, r.value) for r in written.collect()} == {("a", False, None), ("b", True, 7), ("d", True, 1)}
    for bad in (Op("put", "a", 1, expect=2), Op("put", "a", 1, expect=0), Op("scan", "a", end="z")):
        with pytest.raises(BatchRefused):
            run_batch(spark, rows, [bad], 9)
    with pytest.raises(BatchRefused):
        run_batch(spark, rows, [Op("put", "c", 1)], 1)


def test_clock_never_stands_still():
    wall = iter([5, 5, 3, 9])
    clock = HybridClock(lambda: next(wall))
    assert [clock.now(), clock.now()] == [5, 6]
    clock.update(20)
    assert [clock.now(), clock.now()] == [21, 22]


def test_own_locks_do_not_block(spark):
    asks = spark.createDataFrame([("k", "a", 0, 10, True), ("k", "a", 4, 3, True), ("k", "a", 5, 0, False), ("k", "b", 2, 5, True), ("k", "r", 3, 0, False), ("k", "r", 30, 0, False), ("k", "b", 1, 0, False)], "key string, txn_id string, arrive bigint, hold bigint, write boolean")
    got = sorted((r.txn_id, r.arrive, r.granted, r.released, r.waited_for) for r in lock_queue(asks).collect())
    assert got == [("a", 0, 0, 10, None), ("a", 4, 4, 10, None), ("a", 5, 5, None, None), ("b", 1, 10, None, "a"), ("b", 2, 10, 15, "a"), ("r", 3, 15, None, "b"), ("r", 30, 30, None, None)]


def test_conditional_puts(spark):
    s = store(spark, VERSIONS)
    writes = spark.createDataFrame([("count0", 9, 4), ("count0", 9, 3), ("count0", 9, 0), ("count1", 9, 0), ("count1", 9, 5), ("new", 9, 0), ("new", 9, None), ("count0", 3, None), ("count0", 4, None)], "key string, ts bigint, expect bigint")
    got = [(r.key, r.ts, r.expect, r.applied) for r in s.put(writes, "expect").collect()]
    assert sorted(got, key=str) == sorted([("count0", 9, 4, True), ("count0", 9, 3, False), ("count0", 9, 0, False), ("count1", 9, 0, True), ("count1", 9, 5, False), ("new", 9, 0, True), ("new", 9, None, True), ("count0", 3, None, False), ("count0", 4, None, True)], key=str)


def test_increment_needs_a_number(spark):
    s = store(spark, [("a", 1, 1, True, None), ("b", 1, 1, True, 5)])
    ok = s.increment(spark.createDataFrame([("b", 5, 1), ("b", 5, 2), ("c", 10, 1)], "key string, by bigint, n int"), "by", ["n"])
    assert sorted(r.value_after for r in ok.collect()) == [10, 10, 15]
    with pytest.raises(Exception, match="whole number"):
        s.increment(spark.createDataFrame([("a", 5, 1)], "key string, by bigint, n int"), "by", ["n"]).collect()


@SLOW
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from(["get", "put", "delete", "increment"]), st.integers(-3, 9)), max_size=25))
def test_batch_is_a_fold(spark, ops):
    base = {"a": 100}
    rows = [(k, i, op, n) for i, (k, op, n) in enumerate(ops)]
    want, state = {}, dict(base)
    for k, i, op, n in rows:
        if op == "put":
            state[k] = n
        elif op == "delete":
            state[k] = None
        elif op == "increment":
            state[k] = (state.get(k) or 0) + n
        want[i] = state.get(k)
    df = spark.createDataFrame(rows, "key string, seq int, op string, operand bigint")
    got = batch(df, spark.createDataFrame(list(base.items()), "key string, v_int bigint"))
    assert {r.seq: r.answer for r in got.collect()} == want


def test_intents(spark):
    intents = spark.createDataFrame([("t1", 0, 1, "k", 1), ("t1", 0, 2, "k", 2), ("t1", 0, 3, "k", 3), ("t2", 0, 1, "k", 9), ("t3", 0, 1, "z", 5), ("t3", 1, 1, "y", 6), ("t1", 0, 4, "d", None)], "txn_id string, epoch int, sequence int, key string, value bigint")
    status = spark.createDataFrame([("t1", "committed", 0, 50), ("t2", "aborted", 0, 60), ("t3", "committed", 1, 70)], "txn_id string, status string, epoch int, commit_ts bigint")
    back = spark.createDataFrame([("t1", 3, 4)], "txn_id string, lo int, hi int")
    assert {(r.key, r.commit_ts, r.value) for r in resolve_intents(intents, status, back).collect()} == {("k", 50, 2), ("d", 50, None), ("y", 70, 6)}


def test_deadlock_loser(spark):
    shared_dir(spark)
    waits = spark.createDataFrame([("a", "b", 1, 10), ("b", "a", 1, 20), ("c", "a", 1, 5), ("d", "e", 2, 1), ("e", "f", 1, 1), ("f", "d", 1, 1), ("g", "h", 1, 1)], "waiter string, holder string, priority int, start_ts bigint")
    got = {(r.txn, r.restarts) for r in deadlocks(waits).collect()}
    assert got == {("a", False), ("b", True), ("d", True), ("e", False), ("f", False)}


def test_deadlock_on_a_long_cycle(spark):
    shared_dir(spark)
    rows = [(i, (i + 1) % 150, 1, i) for i in range(150)] + [(200 + i, 201 + i, 1, i) for i in range(40)] + [(240, 0, 1, 0)]
    got = {(r.txn, r.cycle, r.restarts) for r in deadlocks(spark.createDataFrame(rows, "waiter int, holder int, priority int, start_ts bigint")).collect()}
    assert got == {(i, 0, i == 149) for i in range(150)}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=14))
def test_deadlocks_are_the_components(spark, edges):
    reach = {(a, b) for a, b in edges}
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    want = {(a, min(b for b in range(8) if (a, b) in reach and (b, a) in reach)) for a in range(8) if (a, a) in reach}
    rows = spark.createDataFrame([(a, b, 1, a) for a, b in edges], "waiter int, holder int, priority int, start_ts bigint")
    assert {(r.txn, r.cycle) for r in deadlocks(rows).collect()} == want


@pytest.mark.parametrize("bound", [0, 3, 1_000_000])
def test_deadlock_components_walked_or_taken_apart(spark, monkeypatch, bound):
    monkeypatch.setattr(txn, "ONE_TASK_WAITS", bound)
    # a ring with waits backwards, one for itself, two cycles in a line, a dead end that branches
    edges = {(i, (i + 1) % 12) for i in range(12)} | {(i, i - 1) for i in (3, 4, 8)} | {(20, 20), (20, 21), (21, 22), (22, 21), (22, 23), (23, 24), (24, 23), (23, 30), (30, 31), (30, 32), (31, 33), (32, 33)}
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    want = {(str(a), min(str(b) for a2, b in reach if a2 == a and (b, a) in reach)) for a, b in reach if a == b}
    got = txn._components(spark.createDataFrame([(str(a), str(b)) for a, b in edges], "waiter string, holder string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_deadlocks_of_branching_waits_are_not_paired(spark, monkeypatch):
    n, seen = 3000, []
    checkpoint = type(spark.range(1)).checkpoint

    def kept(df, *a):
        out = checkpoint(df, *a)
        seen.append(out.count())
        return out

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", kept)
    rows = spark.range(n).selectExpr("id AS waiter", f"explode(array((id + 1) % {n}, if(id % 11 = 5, id - 1, NULL))) AS holder", "1 AS priority", "id AS start_ts")
    got = deadlocks(rows).agg(F.count("*"), F.max("cycle"), F.sum(F.col("restarts").cast("int"))).first()
    # pairs of the branching ones alone would be nearly 300,000
    assert tuple(got) == (n, 0, 1) and max(seen) < 2 * n


def test_optimistic_transactions(spark):
    at = SnapshotTable(spark, work_dir(spark, "txn"))
    one = Txn(spark, at, 10)
    one.put("a", 1)
    assert one.commit() == 11
    reader, writer = Txn(spark, at, 20), Txn(spark, at, 21)
    assert reader.get("a") == 1
    reader.put("b", 5)
    writer.increment("a", 4)
    assert writer.commit() > 21
    with pytest.raises(TxnAborted):
        reader.commit()
    reader.restart()
    assert reader.epoch == 1 and not reader.writes
    again = Txn(spark, at, 100)
    assert {(r.key, r.value) for r in again.scan("a", "c").collect()} == {("a", 5)}
    again.put("b", 6)
    blind = Txn(spark, at, 50)
    blind.put("zz", 1)
    assert blind.commit() > 21
    assert again.commit() > 100
    gone = Txn(spark, at, 300)
    gone.put("a", None)
    gone.commit()
    assert Txn(spark, at, 400).get("a") is None
    assert merge([("b", "d"), ("a", "c"), ("x", "y")]) == [("a", "d"), ("x", "y")]


def test_fences(spark):
    writes = spark.createDataFrame([(1, "w", 5, 10), (2, "r", 5, 10), (3, "w", 5, 99), (4, "w", 50, 1)], "id int, writer string, key bigint, ts bigint")
    reads = spark.createDataFrame([("r", 3, 8, 40), (None, 0, 6, 20)], "reader string, s bigint, e bigint, read_ts bigint")
    got = {r.id: r.pushed_ts for r in push_over_fences(writes, reads, "key", "ts", "s", "e", "read_ts", 4).collect()}
    assert got == {1: 41, 2: 21, 3: 99, 4: 1}


@SLOW
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 12), st.integers(0, 5)), max_size=12))
def test_spans(spark, raw):
    rows = [("k", s, s + n, t) for s, n, t in raw]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint, t bigint")
    points = {}
    for _, s, e, t in rows:
        for x in range(s, e):
            points[x] = max(points.get(x, -1), t)
    merged = merge_spans(df, ["k"], "s", "e").collect()
    assert sorted(x for r in merged for x in range(r.s, r.e)) == sorted(points)
    split = split_spans(df, ["k"], "s", "e", ["t"]).collect()
    assert sorted((x, r.t) for r in split for x in range(r.s, r.e)) == sorted(points.items())
    hits = range_join(spark.createDataFrame([(x,) for x in range(-1, 45)], "x bigint"), df, "x", "s", "e", 5)
    assert sorted(r.x for r in hits.collect()) == sorted(x for _, s, e, _t in rows for x in range(s, e))


def test_split_spans_broadcasts_no_repeated_rows(spark, monkeypatch):
    plans, line = [], relational.Line
    monkeypatch.setattr(relational, "Line", lambda df, *a: (plans.append(plan_of(df)), line(df, *a))[1])
    spans = spark.range(40).selectExpr("id % 2 AS k", "id AS s", "id + id % 5 + 1 AS e", "id % 7 AS t")
    split = split_spans(spans, ["k"], "s", "e", ["t"]).collect()
    assert len(plans) == 2 and plans[1].count("SortMergeJoin") == 4 and "Broadcast" not in plans[1]
    want = {(i % 2, x): max(j % 7 for j in range(i % 2, 40, 2) if j <= x <= j + j % 5) for i in range(40) for x in range(i, i + i % 5 + 1)}
    assert {(r.k, x): r.t for r in split for x in range(r.s, r.e)} == want


def test_asof(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), (None, 9, 4), ("a", None, 5), ("a", 5, 6)], "k string, t bigint, id int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 5, "z"), ("a", 7, "w"), (None, 1, "n")], "k string, t2 bigint, v string")
    assert {r.id: r.v for r in asof_join(left, right, "t", "t2", ["k"], ["v"]).collect()} == {1: "z", 2: None, 3: None, 4: None, 5: None, 6: "z"}


def by_hand(rows):
    last, out = {}, []
    for log, pos, e, s in sorted(rows, key=lambda r: (r[0], r[1])):
        cur = last.get(log)
        verdict = "accept" if cur is None or e > cur[0] else "skip" if e < cur[0] or s <= cur[1] else "accept" if s == cur[1] + 1 else "gap"
        if verdict == "accept":
            last[log] = (e, s)
        out.append((log, pos, verdict))
        if verdict == "gap":
            break
    return out


@SLOW
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(1, 4)), max_size=20))
def test_log_acceptance(spark, raw):
    rows = [("l", i, e, s) for i, (e, s) in enumerate(raw)]
    want = by_hand(rows)
    got = {(r.log, r.position): r.verdict for r in accept(spark.createDataFrame(rows, "log string, position bigint, epoch bigint, sequence bigint")).collect()}
    for log, pos, verdict in want:  # up to the first gap, where reading ends
        assert got[log, pos] == verdict


def test_stream_fails_on_a_gap(spark):
    root = work_dir(spark, "gap")
    schema = spark.createDataFrame([], "log string, position bigint, epoch bigint, sequence bigint").schema
    log = FileLog(spark, f"{root}/log", schema)
    log.append(spark.createDataFrame([("a", 1, 1, 1), ("a", 2, 1, 3)], schema).coalesce(1))
    with pytest.raises(Exception, match="sequence 3 at 2 leaves a gap"):
        accept_stream(log.stream().select(*schema.names), root)
    assert issubclass(GapError, RuntimeError)


def test_stream_takes_up_where_it_stopped(spark):
    root = work_dir(spark, "go")
    schema = spark.createDataFrame([], "log string, position bigint, epoch bigint, sequence bigint").schema
    log = FileLog(spark, f"{root}/log", schema)
    for rows in ([("a", 1, 1, 1), ("a", 2, 1, 2), ("b", 1, 5, 7)], [("a", 3, 1, 2), ("a", 4, 2, 1), ("b", 2, 5, 8)], [("a", 5, 1, 3), ("a", 6, 2, 2), ("b", 3, 6, 1)]):
        log.append(spark.createDataFrame(rows, schema))
        accept_stream(log.stream().select(*schema.names), root)
    got = sorted(map(tuple, accepted_rows(spark, root, schema).collect()))
    assert got == [("a", 1, 1, 1), ("a", 2, 1, 2), ("a", 4, 2, 1), ("a", 6, 2, 2), ("b", 1, 5, 7), ("b", 2, 5, 8), ("b", 3, 6, 1)]


def test_clock_and_late_writes(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate([5, 5, 4, 6, 6, 3])], "n bigint, wall bigint")
    got = [(r.hlc_wall, r.hlc_logical) for r in hybrid_clock(df, "wall", "n").orderBy("n").collect()]
    assert got == [(5, 0), (5, 1), (5, 2), (6, 0), (6, 1), (6, 2)]
    late = [(r.n, r.write_ts) for r in push_late(df, "wall", "n", 1).orderBy("n").collect()]
    assert late == [(0, 5), (1, 5), (2, 5), (3, 6), (4, 6), (5, 6)]


def test_expired_transactions(spark):
    txns = spark.createDataFrame([("a", "pending", 0), ("b", "pending", 0), ("c", "committed", 0), ("d", "pending", 96)], "txn_id string, status string, started bigint")
    beats = spark.createDataFrame([("a", 90), ("a", 97), ("b", 50), ("x", 99)], "txn_id string, at bigint")
    assert {r.txn_id: r.status_now for r in expire(txns, beats, 100, 5).collect()} == {"a": "pending", "b": "aborted", "c": "committed", "d": "pending"}


def test_kafka_records_keep_every_kind(spark):
    import datetime

    schema = "log string, n bigint, d double, b binary, t timestamp_ntz, s string"
    rows = [("a", 1, 0.1, b"\x00\xff", datetime.datetime(2024, 1, 1, 0, 0, 0, 7), "ü\n"), ("b", None, None, None, None, None), (None, 2, 1e300, b"", datetime.datetime(1960, 1, 1), "")]
    df = spark.createDataFrame(rows, schema)
    back = kafka_messages(kafka_records(df), df.schema)
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(map(str, map(tuple, df.collect())))
    with pytest.raises(RuntimeError, match="connector"):
        kafka_log(spark, "localhost:1", "t")


def test_quorum_and_waiting_reads(spark):
    acks = spark.createDataFrame([("w", "r1", 5), ("w", "r1", 9), ("w", "r2", 7), ("w", "r3", 8), ("v", "r1", 1)], "w string, replica string, at bigint")
    times = {r.w: r.replicated for r in quorum_times(acks, "w", "at", 2).collect()}
    assert times == {"w": 7, "v": None}
    reads = spark.createDataFrame([("w", 3), ("w", 12), ("v", 3), (None, 4)], "w string, at bigint")
    got = sorted((str(r.w), r["at"], r.served) for r in replicated_reads(reads, quorum_times(acks, "w", "at", 2), "w", "at").collect())
    assert got == [("None", 4, 4), ("v", 3, None), ("w", 3, 7), ("w", 12, 12)]
