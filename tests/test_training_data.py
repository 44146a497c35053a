"""Operators of problems 1 to 5: nulls, ties, repeats, empty tables, skew, clashing names."""

from __future__ import annotations

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle.operators.compaction import Compactor, current_files, pack, small_files
from brindle.operators.dedupe import BLOCK, MERGE_EVERY, Deduper, Message, covered, dedupe, merge_ranges
from brindle.operators.incremental import IncrementalRun, committed_positions
from brindle.operators.orphans import Reference, month, orphan_counts, orphans
from brindle.operators.skew import lookup_join, running_max_before
from brindle.operators.versions import newest
from brindle.sources.manifest import ConflictError, SnapshotTable
from brindle.sources.shared import work_dir
from brindle.streaming.changefeed import apply_feed, current_table, fold, latest_state

MSG = "log_name string, log_offset bigint, tablet_id bigint, epoch bigint, sequence bigint, operation string, txn_id string"
RUNS = "run_id bigint, log_name string, finished_at timestamp_ntz, status string, log_position bigint"


def ts(text):
    import datetime

    return datetime.datetime.fromisoformat(text)


# -- 1 incremental --------------------------------------------------------------------------


def test_committed_position_is_that_of_the_latest_end(spark):
    runs = spark.createDataFrame(
        [(1, "a", ts("2024-01-02"), "succeeded", 5), (2, "a", ts("2024-01-03"), "failed", 9), (3, "a", ts("2024-01-04"), "succeeded", None), (4, "a", ts("2024-01-01"), "succeeded", 7), (5, "b", None, "succeeded", 3), (6, None, ts("2024-01-01"), "succeeded", 3), (1, "a", ts("2024-01-02"), "succeeded", 5)],
        RUNS,
    )
    assert sorted(map(tuple, committed_positions(runs).collect())) == [("a", 5), ("b", 3)]


def test_pending_leaves_out_what_was_read_and_keeps_nulls_and_gaps(spark):
    rows = [
        ("a", 4, 1, 1, 1, "write", None), ("a", 9, 1, 1, 1, "write", None),  # an early copy: done
        ("a", 6, 1, 1, 2, "write", None), ("a", 6, 1, 1, 2, "write", None),  # repeated: once
        ("a", None, 1, 1, 3, None, None), (None, 1, 1, 1, 4, None, None),  # no place: pending
        ("a", 7, 1, None, 5, None, None), ("a", 7, 1, 1, None, None, None),  # no identity
        ("z", 1, None, 1, 1, "write", None),  # a log without runs, a null tablet
    ]
    run = IncrementalRun(spark, work_dir(spark, "t1"))
    positions = spark.createDataFrame([("a", 5)], "log_name string, log_position bigint")
    pending = run.plan(spark.createDataFrame(rows, MSG), positions)
    got = sorted(((r.tablet_id, r.epoch, r.sequence) for r in pending.rows.collect()), key=str)
    assert got == sorted([(1, 1, 2), (1, 1, 3), (1, 1, 4), (None, 1, 1)], key=str)


def test_runs_take_each_record_once_and_survive_a_crash(spark):
    root = work_dir(spark, "t1")
    first = [("a", i, 1, 1, i, "write", None) for i in range(5)]
    run = IncrementalRun(spark, root)
    messages = spark.createDataFrame(first, MSG)
    run.plan(messages).rows.count()  # a run that dies before its commit
    assert IncrementalRun(spark, root).output() is None
    run.commit(run.plan(messages))
    more = spark.createDataFrame(first + [("a", i, 1, 1, i, "write", None) for i in range(5, 8)] + [("b", 0, 2, 1, 0, "write", None)], MSG)
    run.commit(run.plan(more))
    ids = [(r.tablet_id, r.sequence) for r in run.output().collect()]
    assert sorted(ids) == [(1, i) for i in range(8)] + [(2, 0)]
    assert run.plan(more).rows.count() == 0
    assert dict(map(tuple, run.committed().collect())) == {"a": 7, "b": 0}


def test_rows_without_a_place_are_taken_once(spark):
    rows = [("a", None, 1, 1, 1, "write", None), (None, 4, 1, 1, 2, "write", None), (None, None, None, 1, 3, "write", None), ("a", 1, 1, 1, 4, "write", None)]
    run = IncrementalRun(spark, work_dir(spark, "t1"))
    messages = spark.createDataFrame(rows, MSG)
    run.commit(run.plan(messages))
    assert run.plan(messages).rows.count() == 0
    run.commit(run.plan(messages))
    # copies with a place, later ones too, and one more row without
    more = spark.createDataFrame([*rows, ("a", 7, 1, 1, 1, "write", None), ("b", 1, None, 1, 3, "write", None), ("a", None, 1, 1, 5, "write", None)], MSG)
    for _ in range(2):
        run.commit(run.plan(more))
    assert sorted(r.sequence for r in run.output().collect()) == [1, 2, 3, 4, 5]


def test_upper_limit_is_fixed_when_a_run_starts(spark, tmp_path):
    at = str(tmp_path / "log")
    spark.createDataFrame([("a", 1, 1, 1, 1, "write", None)], MSG).write.parquet(at)
    run = IncrementalRun(spark, work_dir(spark, "t1"))
    pending = run.plan(spark.read.schema(MSG).parquet(at))
    upper = {r["log_name"]: r["__upper"] for r in pending.upper.collect()}
    assert upper == {"a": 1}


def test_a_second_run_reads_the_new_files_only(spark, tmp_path):
    at, run = str(tmp_path / "log"), IncrementalRun(spark, work_dir(spark, "t1"))
    old = [("a", i, 1, 1, i, "write", None) for i in range(300)] + [("b", None, 2, 1, 7, "write", None), ("b", 3, None, 1, 9, "write", None)]
    spark.createDataFrame(old, MSG).coalesce(1).write.parquet(at)
    run.commit(run.plan(spark.read.schema(MSG).parquet(at)))
    # two new records, copies of old ones at later places, and an old place that comes late
    news = [("a", 300, 1, 1, 300, "write", None), ("a", 301, 1, 1, 5, "write", None), ("b", 4, None, 1, 9, "write", None), ("b", 9, 2, 1, 7, "write", None), ("c", 1, 3, 1, 1, "write", None), ("a", 2, 1, 1, 777, "write", None)]
    spark.createDataFrame(news, MSG).coalesce(1).write.mode("append").parquet(at)
    whole = spark.read.schema(MSG).parquet(at)
    pending = run.plan(whole)
    assert len(whole.inputFiles()) == 2 and len(pending.files) == 1
    assert run._unread(whole, run.table.read())[0].count() == len(news)
    assert sorted((r.tablet_id, r.sequence) for r in pending.rows.collect()) == [(1, 300), (3, 1)]
    run.commit(pending)
    again = run.plan(spark.read.schema(MSG).parquet(at))
    assert again.files == {} and again.rows.count() == 0
    assert dict(map(tuple, run.committed().collect())) == {"a": 301, "b": 9, "c": 1}


def test_two_runs_at_once_conflict(spark):
    run = IncrementalRun(spark, work_dir(spark, "t1"))
    messages = spark.createDataFrame([("a", 1, 1, 1, 1, "write", None)], MSG)
    one, two = run.plan(messages), run.plan(messages)
    run.commit(one)
    with pytest.raises(ConflictError):
        run.commit(two)
    assert run.output().count() == 1


def test_incremental_on_empty_tables(spark):
    run = IncrementalRun(spark, work_dir(spark, "t1"))
    run.commit(run.plan(spark.createDataFrame([], MSG), committed_positions(spark.createDataFrame([], RUNS))))
    assert run.output().count() == 0


# -- 2 change feed --------------------------------------------------------------------------

FEED = "tablet_id bigint, key binary, ts_seconds bigint, ts_nanos int, ts_logical int, epoch bigint, sequence bigint, write_no int, operation string, kind string, v_int bigint, v_float double, v_bytes binary, v_string string, extra string"


def change(key, sec, value, seq=1, no=0, nanos=0, tablet=1):
    return (tablet, key, sec, nanos, 0, 1, seq, no, "write", None if value is None else "int", value, None, None, None, "x")


def final(df):
    return {(r.tablet_id, None if r.key is None else bytes(r.key)): r.v_int for r in df.collect()}


def test_latest_state_orders_and_drops(spark):
    rows = [change(b"a", 1, 1), change(b"a", 3, 3), change(b"a", 2, None), change(b"b", 1, 5), change(b"b", 2, None), change(b"c", None, 9), change(b"d", 1, 1, no=0), change(b"d", 1, 2, no=1), change(None, 1, 7), change(b"a", 3, 3)]
    state = latest_state(spark.createDataFrame(rows, FEED))
    assert final(state.where(~F.col("deleted"))) == {(1, b"a"): 3, (1, b"d"): 2, (1, None): 7}
    assert state.where("deleted").count() == 1


def test_feed_in_batches_equals_one_batch_and_keeps_tombstones(spark, tmp_path):
    rng = random.Random(3)
    rows = [change(bytes([rng.randrange(12)]), rng.randrange(30), rng.choice([None, 1, 2, 3]), seq=i) for i in range(300)]
    want = final(latest_state(spark.createDataFrame(rows, FEED)).where(~F.col("deleted")))
    source, root = str(tmp_path / "in"), work_dir(spark, "t2")
    schema = spark.createDataFrame([], FEED).schema
    for k in range(3):
        part = rows[k::3] + rows[:20]  # out of order and repeated
        spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(source)
        apply_feed(spark, source, schema, root)
    assert final(current_table(spark, root, schema)) == want
    again = apply_feed(spark, source, schema, root)  # nothing new: nothing changes
    assert again >= -1 and final(current_table(spark, root, schema)) == want


def test_folding_keeps_the_table_and_drops_old_tombstones(spark, tmp_path):
    source, root, schema = str(tmp_path / "in"), work_dir(spark, "t2"), spark.createDataFrame([], FEED).schema
    batches = [[change(b"a", 1, 1), change(b"b", 2, 2), change(b"c", 3, 3)], [change(b"a", 4, None), change(b"b", 5, 5)], [change(b"a", 2, 9), change(b"c", 6, None), change(b"d", 7, 7)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(source)
        apply_feed(spark, source, schema, root)
        if k == 1:
            assert fold(spark, root, schema, expire_before=5) == 1
            assert final(current_table(spark, root, schema, with_deleted=True)) == {(1, b"b"): 5, (1, b"c"): 3}
    # the older change of a came after its tombstone was left out, and is still refused
    assert final(current_table(spark, root, schema)) == {(1, b"b"): 5, (1, b"d"): 7}
    assert fold(spark, root, schema) == 2 and final(current_table(spark, root, schema)) == {(1, b"b"): 5, (1, b"d"): 7}
    assert fold(spark, root, schema) == 2


def test_feed_of_nothing(spark, tmp_path):
    schema = spark.createDataFrame([], FEED).schema
    assert current_table(spark, str(tmp_path / "none"), schema).count() == 0
    assert latest_state(spark.createDataFrame([], FEED)).count() == 0


# -- 3 dedupe -------------------------------------------------------------------------------

ID = "tablet_id bigint, epoch bigint, sequence bigint, operation string, copies string"


def test_dedupe_takes_the_complete_copy(spark):
    rows = [(1, 1, 1, None, None), (1, 1, 1, "write", None), (1, 1, 2, "batch", "x"), (1, None, 3, "write", None), (1, None, 3, "write", None), (1, None, 3, "batch", None), (None, 1, 1, None, None)]
    out = dedupe(spark.createDataFrame(rows, ID))
    kept = sorted(map(str, (tuple(r) for r in out.accepted.collect())))
    assert kept == sorted(map(str, [(1, 1, 1, "write", None), (1, 1, 2, "batch", "x"), (1, None, 3, "write", None), (1, None, 3, "batch", None), (None, 1, 1, None, None)]))
    assert [tuple(r) for r in out.repeated.select("tablet_id", "epoch", "sequence").collect()] == [(1, 1, 1)]


def test_what_the_best_copy_lacks_comes_from_the_others(spark):
    rows = [(1, 1, 1, "write", None), (1, 1, 1, None, "x"), (1, 1, 1, None, None)]
    assert [tuple(r) for r in dedupe(spark.createDataFrame(rows, ID)).accepted.collect()] == [(1, 1, 1, "write", "x")]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.tuples(st.integers(1, 2), st.integers(1, 2), st.integers(-3, 12)), max_size=15), min_size=1, max_size=3))
def test_dedupe_over_deliveries(spark, deliveries):
    seen = exact = None
    accepted, truth = [], set()
    for d in deliveries:
        out = dedupe(spark.createDataFrame([(*r, "write", None) for r in d], ID), seen=seen, seen_exact=exact)
        accepted += [(r.tablet_id, r.epoch, r.sequence) for r in out.accepted.collect()]
        seen = spark.createDataFrame(out.ranges.collect(), out.ranges.schema)
        exact = spark.createDataFrame(out.exact.collect(), out.exact.schema)
        truth |= set(d)
        covers = [(r.tablet_id, r.epoch, n) for r in seen.collect() for n in range(r.lo, r.hi + 1)]
        assert sorted(covers) == sorted(truth)
    assert sorted(accepted) == sorted(truth)


def test_malformed_rows_are_looked_up_exactly(spark):
    rows = spark.createDataFrame([(None, 1, 1, "write", None), (None, 1, 2, "write", None)], ID)
    one = dedupe(rows)
    two = dedupe(rows.limit(1).unionByName(spark.createDataFrame([(None, 1, 3, "write", None)], ID)), seen=one.ranges, seen_exact=one.exact)
    assert [r.sequence for r in two.accepted.collect()] == [3]


def test_ranges_across_blocks(spark):
    df = spark.createDataFrame([(1, BLOCK - 3, BLOCK + 2), (1, BLOCK + 3, 3 * BLOCK), (1, 3 * BLOCK + 2, 3 * BLOCK + 2), (2, 5, 4), (2, None, 3), (None, 1, 1), (None, 2, 2)], "p bigint, lo bigint, hi bigint")
    merged = merge_ranges(df, ["p"])
    assert sorted(map(tuple, merged.collect()), key=str) == sorted([(1, BLOCK - 3, 3 * BLOCK), (1, 3 * BLOCK + 2, 3 * BLOCK + 2), (None, 1, 2)], key=str)
    rows = spark.createDataFrame([(1, 2 * BLOCK), (1, 3 * BLOCK + 1), (None, 2), (2, 5)], "p bigint, n bigint")
    assert sorted((r.p, r.n) for r in covered(rows, merged, ["p"], "n").collect() if r.p) == [(1, 2 * BLOCK)]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(-4, 4), st.integers(0, 3 * BLOCK)), max_size=10))
def test_ranges_near_block_edges(spark, raw):
    rows = [(1, b * BLOCK + n, b * BLOCK + n + w) for b, n, w in raw]
    want = []
    for _, lo, hi in sorted(rows):
        if want and lo <= want[-1][1] + 1:
            want[-1][1] = max(want[-1][1], hi)
        else:
            want.append([lo, hi])
    got = merge_ranges(spark.createDataFrame(rows, "p bigint, lo bigint, hi bigint"), ["p"])
    assert sorted([r.lo, r.hi] for r in got.collect()) == want


def test_deliveries_with_kept_state(spark):
    job = Deduper(spark, work_dir(spark, "t3"))
    one = spark.createDataFrame([(1, 1, n, "write", None) for n in (1, 2, 3, 3, 9)] + [(None, 1, 1, "write", None)], ID)
    two = spark.createDataFrame([(1, 1, n, "write", "late") for n in (2, 4, 8)] + [(None, 1, 1, "write", None), (1, 2, 1, None, None)], ID)
    job.deliver(one)
    job.deliver(two)
    job.deliver(two)  # given again: everything repeats, nothing is new
    assert sorted((r.epoch, r.sequence) for r in job.accepted().where("tablet_id IS NOT NULL").collect()) == [(1, 1), (1, 2), (1, 3), (1, 4), (1, 8), (1, 9), (2, 1)]
    assert job.accepted().where("tablet_id IS NULL").count() == 1
    assert job.accepted().where("copies = 'late' AND sequence = 2").count() == 0
    assert sorted((r.epoch, r.lo, r.hi) for r in job.ranges().collect()) == [(1, 1, 4), (1, 8, 9), (2, 1, 1)]
    assert sorted((r.epoch, r.sequence) for r in job.repeated().collect()) == [(1, 2), (1, 3), (1, 4), (1, 8), (2, 1)]
    job.deliver(spark.createDataFrame([], ID))
    assert job.accepted().count() == 8 == job.complete().count()
    assert [r.copies for r in job.complete().where("epoch = 1 AND sequence = 2").collect()] == ["late"]  # the fuller copy


def test_numbers_of_all_64_bits_are_exact(spark):
    ids = [(1 << 62) - 2, (1 << 62) - 1, 1 << 62, (1 << 53) - 1, (1 << 53) + 1, (1 << 63) - 1, -(1 << 63), -1]
    got = merge_ranges(spark.createDataFrame([(1, n, n) for n in ids], "p bigint, lo bigint, hi bigint"), ["p"])
    assert sorted((r.lo, r.hi) for r in got.collect()) == sorted([((1 << 62) - 2, 1 << 62), ((1 << 53) - 1, (1 << 53) - 1), ((1 << 53) + 1, (1 << 53) + 1), ((1 << 63) - 1, (1 << 63) - 1), (-(1 << 63), -(1 << 63)), (-1, -1)])
    job = Deduper(spark, work_dir(spark, "t3"))
    rows = spark.createDataFrame([(1, 1, n, "write", None) for n in ids], ID)
    job.deliver(rows)
    job.deliver(rows)
    assert job.accepted().count() == len(ids) == job.repeated().count()


def test_malformed_rows_of_another_fetch_are_the_same(spark):
    schema = ID + ", fetch_id bigint, arrived_at bigint"
    m = Message(delivery=("fetch_id", "arrived_at"))
    job = Deduper(spark, work_dir(spark, "t3"), m)
    job.deliver(spark.createDataFrame([(None, 1, 1, "write", "x", 1, 10), (None, 1, 1, "write", "x", 1, 11), (1, 1, 7, None, None, 1, 12)], schema))
    job.deliver(spark.createDataFrame([(None, 1, 1, "write", "x", 2, 20), (None, 1, 1, "batch", "x", 2, 20), (1, 1, 7, "write", None, 2, 21)], schema))
    kept = job.accepted().collect()
    assert sorted(r.operation or "" for r in kept if r.tablet_id is None) == ["batch", "write"] and len(kept) == 3
    assert [r.operation for r in job.complete().where("sequence = 7").collect()] == ["write"]


def test_columns_that_belong_together_come_from_one_copy(spark):
    rows = spark.createDataFrame([(1, 1, 1, None, 5, 6), (1, 1, 1, "a", None, None), (1, 1, 1, "b", 9, None)], "tablet_id bigint, epoch bigint, sequence bigint, v string, s bigint, n int")
    one = dedupe(rows, Message(together=(("s", "n"),))).accepted.first()
    assert (one.s, one.n) in ((5, 6), (9, None)) and one.v == "b"


def test_many_deliveries_merge_their_state(spark):
    job = Deduper(spark, work_dir(spark, "t3"))
    for k in range(MERGE_EVERY + 2):
        job.deliver(spark.createDataFrame([(1, 1, n, "write", None) for n in (k, 2 * k, 100)] + [(None, k % 2, 1, "write", None)], ID))
    seen = {n for k in range(MERGE_EVERY + 2) for n in (k, 2 * k)} | {100}
    assert sorted(r.sequence for r in job.accepted().where("tablet_id = 1").collect()) == sorted(seen)
    assert sorted(n for r in job.ranges().collect() for n in range(r.lo, r.hi + 1)) == sorted(seen)
    assert job.accepted().where("tablet_id IS NULL").count() == 2
    assert len(job.table.read()["ranges"]) < MERGE_EVERY


def test_dedupe_of_nothing(spark):
    out = dedupe(spark.createDataFrame([], ID))
    assert out.accepted.count() == out.repeated.count() == out.ranges.count() == 0


# -- 4 compaction ---------------------------------------------------------------------------

META = "file_uri string, shard_id bigint, tablet_id bigint, size bigint, last_modified timestamp_ntz, state string, listed_at timestamp_ntz, bin string"
ENTRY = "file_uri string, entry_no int, entry_key string, entry_bytes bigint, size string"


def listing(uri, shard, size, state="live", at="2024-01-02"):
    return (uri, shard, 1, size, None, state, ts(at), "clash")


def test_small_files_by_latest_complete_listing(spark):
    rows = [listing("a", 1, 10), listing("b", 1, 20), listing("b", 1, 20), listing("c", 1, 2 << 20), listing("d", 2, 5), listing("e", 1, 5, "obsoleted", "2024-01-03"), listing("e", 1, 5), listing("f", 1, None, None, "2024-01-09"), listing("f", 1, 7), listing("g", None, 7), listing(None, 1, 7)]
    got = sorted(r.file_uri for r in small_files(spark.createDataFrame(rows, META)).collect())
    assert got == ["a", "b", "f"]
    assert current_files(spark.createDataFrame([], META)).count() == 0


def test_bins_hold_about_the_target_and_all_files(spark):
    rows = [listing(f"f{i}", i % 2, 100 + i) for i in range(500)]
    files = small_files(spark.createDataFrame(rows, META))
    bins = pack(files, 5000).groupBy("grp", "bin").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(b.n for b in bins) == 500
    assert max(b.s for b in bins) < 2 * 5000 and len(bins) <= sum(b.s for b in bins) // 5000 + 4
    # shards far below the target share files
    many = small_files(spark.createDataFrame([listing(f"f{i}", i % 200, 100) for i in range(400)], META))
    packed = pack(many, 5000)
    assert packed.select("grp", "bin").distinct().count() <= 400 * 100 // 5000 + 1
    assert packed.groupBy("shard_id").agg(F.countDistinct("grp", "bin").alias("n")).where("n > 1").count() == 0


def test_rewrite_keeps_every_entry_once_and_detects_conflicts(spark):
    meta = spark.createDataFrame([listing(f"f{i}", 1, 16 + 10) for i in range(6)] + [listing("big", 1, 9 << 20), listing("lone", 7, 20)], META)
    entries = spark.createDataFrame([(f"f{i}", n, f"k{n}", 5, None) for i in range(5) for n in (0, 1)] * 2 + [("big", 0, "k", 5, None), ("f0", None, "k", 1, None)], ENTRY)
    job = Compactor(spark, work_dir(spark, "t4"), target_bytes=60)
    one, two = job.plan(meta), job.plan(meta)
    job.rewrite(one, entries)
    out = job.entries().collect()
    assert sorted((r.file_uri, r.entry_no) for r in out) == [(f"f{i}", n) for i in range(5) for n in (0, 1)]
    with pytest.raises(ConflictError):
        job.rewrite(two, entries)
    assert job.entries().count() == 10


def test_snapshot_holds_or_lists_every_entry_of_all_live_files(spark):
    meta = spark.createDataFrame([listing("a", 1, 20), listing("b", 1, 20), listing("big", 1, 9 << 20), listing("lone", 7, 20), listing("none", None, 20), listing("gone", 1, 20, "obsoleted")], META)
    entries = spark.createDataFrame([(u, n, f"k{n}", 5, None) for u in ("a", "b", "big", "lone", "none", "gone") for n in (0, 1)] * 2, ENTRY)
    job = Compactor(spark, work_dir(spark, "t4"))
    job.rewrite(job.plan(meta), entries)
    got = sorted((r.file_uri, r.entry_no) for r in job.all_entries(entries).collect())
    assert got == [(u, n) for u in ("a", "b", "big", "lone", "none") for n in (0, 1)]
    assert sorted(r.file_uri for r in job.untouched().collect()) == ["big", "lone", "none"]
    # listings of new files only: what was listed before stays listed, or is packed with them
    job.rewrite(job.plan(spark.createDataFrame([listing("new", 7, 20, at="2024-02-01")], META)), entries)
    assert [r.file_uri for r in job.untouched().orderBy("file_uri").collect()] == ["big", "none"]


def test_second_rewrite_replaces_its_shards_and_repeats_nothing(spark):
    old = [listing(u, s, 20) for u, s in (("a", 1), ("b", 1), ("c", 2), ("d", 2), ("lone", 3))]
    both = [*old, *(listing(u, s, 20, at="2024-02-01") for u, s in (("e", 1), ("f", 1), ("alone", 2)))]
    rows = [(r[0], n, f"k{n}", 5, None) for r in both for n in (0, 1)]
    entries, packed = spark.createDataFrame(rows * 2, ENTRY), lambda: sorted((r.shard_id, r.file_uri, r.entry_no) for r in job.entries().collect())
    of = lambda files: sorted((r[1], r[0], n) for r in both if r[0] in files for n in (0, 1))
    job = Compactor(spark, work_dir(spark, "t4"))
    first = job.rewrite(job.plan(spark.createDataFrame(old, META)), entries)
    # what is packed already comes from the snapshot, not from the entries given
    second = job.rewrite(job.plan(spark.createDataFrame(both, META)), entries.where("file_uri NOT IN ('a', 'b', 'c', 'd')"))
    assert packed() == of("abcdef")
    assert sorted(r.file_uri for r in job.untouched().collect()) == ["alone", "lone"]
    owners = spark.read.parquet(job.table.read()["owners"]).collect()
    # both shards lay in the one group that shard 1 touched: it was replaced whole
    assert sorted(r.shard_id for r in owners) == [1, 2] and len({r.part for r in owners}) == 1
    assert sorted({r.file_uri for r in job.entries(first).collect()}) == list("abcd")
    # nothing new: an empty plan, the same entries
    again = job.plan(spark.createDataFrame(both, META))
    assert again.files.count() == 0 and job.rewrite(again, entries) == second + 1
    assert packed() == of("abcdef") and job.all_entries(entries).count() == len(rows)


def test_only_touched_groups_are_replaced(spark):
    old = [listing(f"{s}{k}", s, 40) for s in range(8) for k in range(2)]
    more = [listing(f"n{k}", 3, 40, at="2024-02-01") for k in range(2)]
    entries = spark.createDataFrame([(r[0], n, f"k{n}", 5, None) for r in [*old, *more] for n in (0, 1)], ENTRY)
    job = Compactor(spark, work_dir(spark, "t4"), target_bytes=160)
    job.rewrite(job.plan(spark.createDataFrame(old, META)), entries)
    before = {r.shard_id: (r.part, r.grp) for r in spark.read.parquet(job.table.read()["owners"]).collect()}
    job.rewrite(job.plan(spark.createDataFrame([*old, *more], META)), entries)
    after = {r.shard_id: (r.part, r.grp) for r in spark.read.parquet(job.table.read()["owners"]).collect()}
    assert {s for s in after if after[s] != before[s]} == {s for s in before if before[s] == before[3]}
    assert job.table.read()["parts"][before[3][0]] == [before[3][1]]
    assert sorted((r.file_uri, r.entry_no) for r in job.entries().collect()) == sorted((r[0], n) for r in [*old, *more] for n in (0, 1))


# -- 5 orphans ------------------------------------------------------------------------------

DESC = "id bigint, name string, kind string, database_id bigint, parent_id bigint, ts_seconds bigint, ts_nanos int, ts_logical int, dropped boolean, target string"


def desc(i, parent, db, sec, dropped=False):
    return (i, f"n{i}", "table", db, parent, sec, 0, 0, dropped, "clash")


ROWS = [
    desc(1, 0, 0, 100), desc(2, 1, 99, 200), desc(3, 1, 1, 50), desc(4, 5, None, 300), desc(5, 1, 1, 250, True), desc(6, 1, 1, 100), desc(6, 99, 99, 10),
    desc(7, 98, 98, 100, True), desc(8, 1, 0, None), desc(2, 1, 99, 200), desc(None, 97, 97, 100), desc(9, 1, 1, 2678400, None),
]


@pytest.mark.parametrize("heavy", [0, 1, 10_000])
def test_orphans_by_reason_whatever_is_heavy(spark, heavy):
    metas = spark.createDataFrame(ROWS, DESC)
    refs = [Reference("m", metas, "parent_id"), Reference("m", metas, "database_id")]
    got = sorted((r.id, r.field, r.target, r.period, r.reason) for r in orphans(refs, metas, heavy_refs=heavy).collect() if r.id != 8)
    assert got == [(2, "database_id", 99, "1970-01", "missing"), (3, "database_id", 1, "1970-01", "later"), (3, "parent_id", 1, "1970-01", "later"), (4, "parent_id", 5, "1970-01", "dropped")]


def test_orphan_counts_and_empty(spark):
    metas = spark.createDataFrame(ROWS, DESC)
    counts = orphan_counts([Reference("m", metas, "parent_id")], metas)
    assert {(r.reason, r.n_refs) for r in counts.where("period IS NOT NULL").collect()} == {("later", 1), ("dropped", 1)}
    none = spark.createDataFrame([], DESC)
    assert orphans([Reference("m", none, "parent_id")], none).count() == 0


@pytest.mark.parametrize("heavy", [0, 10_000])
def test_a_month_of_which_a_part_is_later(spark, heavy):
    rows = [desc(1, 0, 0, 1000)] + [desc(i, 1, None, 990 + i) for i in range(2, 30)] + [desc(50, 1, None, 40 * 86400), desc(60, 77, None, None), desc(61, 77, None, None)]
    metas = spark.createDataFrame(rows, DESC)
    refs = [Reference("m", metas, "parent_id")]
    assert sorted(r.id for r in orphans(refs, metas, heavy).where("reason = 'later'").collect()) == list(range(2, 10))
    got = {(r.period, r.reason, r.n_refs, r.n_targets) for r in orphan_counts(refs, metas, heavy).collect()}
    assert got == {("1970-01", "later", 8, 1), (None, "missing", 2, 1)}


def test_month_of_negative_and_large_seconds(spark):
    got = spark.createDataFrame([(-1,), (0,), (1709321620,), (None,)], "s bigint").select(month(F.col("s")).alias("m")).collect()
    assert [r.m for r in got] == ["1969-12", "1970-01", "2024-03", None]


# -- shared parts ---------------------------------------------------------------------------


def test_newest_breaks_ties_by_value_and_groups_null_keys(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (None, 1, "x"), (None, 2, None), (2, None, "q")], "k bigint, t bigint, v string")
    assert sorted(map(tuple, newest(df, ["k"], ["t"]).collect()), key=str) == sorted([(1, 5, "b"), (None, 2, None), (2, None, "q")], key=str)
    assert newest(df, ["k"], ["t"], oldest=True).where("k = 1").first().v == "a"


@pytest.mark.parametrize("bound", [0, 100])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_is_the_same_salted(spark, bound, how):
    big = spark.createDataFrame([(1, "a")] * 40 + [(2, "b"), (None, "c"), (3, "d")], "k bigint, v string")
    small = spark.createDataFrame([(1, "x"), (3, "y")], "k bigint, w string")
    got = sorted(map(str, lookup_join(big, small, ["k"], how, max_rows=bound).collect()))
    assert got == sorted(map(str, big.join(small, ["k"], how).collect()))


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_rows_are_not_broadcast(spark, how):
    big, small = spark.range(1000).withColumn("k", F.col("id") % 7), spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    joined = lookup_join(big, small, ["k"], how, max_rows=0)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert joined.count() == big.join(small, ["k"], how).count()


def test_running_max_over_chunks(spark):
    rows = [(k, i, (i * 7) % 23) for k in (1, None) for i in range(60)]
    df = spark.createDataFrame(rows, "k bigint, at bigint, v bigint")
    got = {(r.k, r.at): r.m for r in running_max_before(df, ["k"], "at", "v", "m").collect()}
    for k, i, _ in rows:
        before = [v for k2, j, v in rows if k2 == k and j < i]
        assert got[k, i] == (max(before) if before else None)


def test_manifest_versions_and_conflicts(spark):
    at = SnapshotTable(spark, work_dir(spark, "m"))
    assert at.version() == 0 and at.read() == {}
    assert at.publish(0, {"a": 1}) == 1 and at.publish(1, {"a": 2}) == 2
    with pytest.raises(ConflictError):
        at.publish(1, {"a": 3})
    assert at.read() == {"a": 2} and at.read(1) == {"a": 1}
