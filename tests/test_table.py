"""Stored tables: the visible view stays as it is under every rewrite."""

from datetime import datetime, time, timedelta, timezone

import pytest
from pyspark.sql import types as T

from tidelog.errors import CommitConflictError, CorruptTableError, InvalidMergeRangeError, ReadOnlyTableError, SpecMismatchError, TableExistsError, TableNotFoundError
from tidelog.operators.txn import State, Transactions
from tidelog.errors import TransactionAbortedError, TransactionAlreadyCommittedError, TransactionNotFoundError
from tidelog.sources.backup import Backup, Schedule
from tidelog.sources.table import KeyedTable
from tidelog.spec import DELETED, OP, KeySpec, Options
from tidelog.streaming.replicate import apply_batch, replicate

KEY = KeySpec.of("key")
SCHEMA = T.StructType([T.StructField("key", T.IntegerType()), T.StructField("value", T.IntegerType())])
SMALL = Options(mutable_max=10_000, disk_max=10, part_min=5, part_max=20, unsafe=True)


def batch(spark, pairs):
    return spark.createDataFrame([(k, v, v is None) for k, v in pairs], f"key int, value int, {DELETED} boolean")


def seen(table, **what):
    return sorted((r["key"], r["value"]) for r in table.view(**what).collect())


def test_life_of_a_table(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", KEY, SCHEMA, Options(part_min=10, part_max=100, disk_max=100_000, unsafe=True))
    assert seen(t) == [] and not t.seal() and t.merge() == "nothing_to_merge"
    assert t.append(batch(spark, [(i, 2 * i) for i in range(250)])) == 250
    t.evict()
    t.delete(spark.createDataFrame([(k,) for k in (127, 19, 20, 21, 9999)], "key int"))
    t.append(batch(spark, [(i, 2 * i) for i in range(250, 500)]))
    want = [(i, 2 * i) for i in range(500) if i not in (19, 20, 21, 127)]
    assert seen(t) == want and t.count() == 496
    pinned = t.snapshot()
    t.append(batch(spark, [(0, None), (1, 7)]))
    assert seen(t, version=pinned) == want and len(seen(t)) == 495 and t.count() == 495
    assert t.evict() == "success"
    m = t.manifest()
    assert m.disk.rows == 495 and not m.disk.tombstones and t.count() == 495 and m.max_op == 250 + 4 + 250 + 2
    files = {p.path for p in m.disk.parts}
    t.append(batch(spark, [(499, 0)]))
    t.evict()  # touches the last part only
    assert len(files & {p.path for p in t.manifest().disk.parts}) >= len(files) - 2 and dict(seen(t))[499] == 0
    again = KeyedTable.open(spark, f"{tmp_path}/t", KEY, SCHEMA)
    assert seen(again) == seen(t)
    before = seen(t)
    assert t.vacuum() > 0 and seen(t) == before
    with pytest.raises(TableNotFoundError):
        t.manifest(pinned)
    with pytest.raises(TableExistsError):
        KeyedTable.create(spark, f"{tmp_path}/t", KEY, SCHEMA)
    with pytest.raises(SpecMismatchError):
        KeyedTable.open(spark, f"{tmp_path}/t", KeySpec.of("value"))
    locked = KeyedTable.open(spark, f"{tmp_path}/t", options=Options(read_only=True))
    with pytest.raises(ReadOnlyTableError):
        locked.append(batch(spark, [(1, 1)]))
    t.drop()
    with pytest.raises(TableNotFoundError):
        KeyedTable.open(spark, f"{tmp_path}/t")


def test_one_writer_wins(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", KEY, SCHEMA)
    a, b = t.manifest(), t.manifest()
    t._publish(a)
    with pytest.raises(CommitConflictError):
        t._publish(b)


def test_missing_file_is_corruption(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", KEY, SCHEMA)
    t.append(batch(spark, [(1, 1)]))
    t.files.delete(f"{t.path}/{t.manifest().open[0].parts[0].path}")
    with pytest.raises(CorruptTableError):
        t.view()


def test_bottom_segments(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", KEY, SCHEMA, SMALL)
    key, sizes = 0, [11, 13, 15, 17, 19, 21]
    for n in sizes:
        t.append(batch(spark, [(key + i, key + i) for i in range(n)]))
        key += n
        t.evict()
    assert [s.rows for s in t.manifest().bottom] == [21, 19, 17, 15, 13, 11] and t.manifest().disk is None
    before = seen(t)
    assert t.merge_bottom(1, 3) == "success"
    assert [s.rows for s in t.manifest().bottom] == [21, 51, 13, 11] and seen(t) == before and t.count() == 96
    with pytest.raises(InvalidMergeRangeError):
        t.merge_bottom(3, 9)


def test_partial_bottom_merge_keeps_tombstones(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", KEY, SCHEMA, SMALL.clone(disk_max=0))
    for pairs in ([(42, 420), (60, 60)], [(50, 50)], [(42, None)]):
        t.append(batch(spark, pairs))
        t.evict()
    assert [s.rows for s in t.manifest().bottom] == [1, 1, 2]
    t.merge_bottom(0, 1)
    assert seen(t) == [(50, 50), (60, 60)] and [s.tombstones for s in t.manifest().bottom] == [1, 0]
    t.merge_bottom(0, 1)
    assert seen(t) == [(50, 50), (60, 60)] and [s.rows for s in t.manifest().bottom] == [2]


def test_garbage_collection_of_one_delta(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", KEY, SCHEMA)
    for pairs in ([(1, 1), (2, 2), (3, 3)], [(2, None), (4, 4)], [(3, 33)]):
        t.append(batch(spark, pairs))
    assert t.record_counts()["open"] == 6
    assert t.collect_garbage() and t.record_counts()["open"] == 3 and seen(t) == [(1, 1), (3, 33), (4, 4)]
    t.append(batch(spark, [(9, 9)]))
    assert t.manifest().max_op == 7


def test_backup_and_restore(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", KEY, SCHEMA, SMALL)
    t.append(batch(spark, [(i, i) for i in range(8)]))
    t.evict()
    t.append(batch(spark, [(1, None), (9, 9)]))
    b = Backup(t, f"{tmp_path}/b", keep=2)
    first, want = b.take(), seen(t)
    t.append(batch(spark, [(100, 100)]))
    second = b.take()
    r = b.restore(f"{tmp_path}/r1", first)
    assert seen(r) == want and seen(b.restore(f"{tmp_path}/r2")) == seen(t)
    r.append(batch(spark, [(5, 55)]))
    assert r.manifest().max_op == 11
    with pytest.raises(TableExistsError):
        b.restore(f"{tmp_path}/r1")
    third = b.take()
    assert b.generations() == [second, third]
    assert seen(b.restore(f"{tmp_path}/r3", third)) == seen(t)


def test_schedules():
    now = datetime(2024, 5, 15, 10, tzinfo=timezone.utc)  # a Wednesday
    assert Schedule().next_after(now) is None
    assert Schedule("every", every=timedelta(hours=2)).next_after(now) == now + timedelta(hours=2)
    assert Schedule("daily", at=time(9)).next_after(now) == datetime(2024, 5, 16, 9, tzinfo=timezone.utc)
    assert Schedule("weekly", at=time(11), weekday=2).next_after(now) == datetime(2024, 5, 15, 11, tzinfo=timezone.utc)
    assert Schedule("weekly", at=time(9), weekday=2).next_after(now) == datetime(2024, 5, 22, 9, tzinfo=timezone.utc)


def test_replica_of_shuffled_operations(spark, tmp_path, sf_dir):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ops = events.select(F.col("user_id").cast("int").alias("key"), F.col("event_id").cast("int").alias("value"), (F.col("event_id") + 1).alias(OP))
    t = KeyedTable.create(spark, f"{tmp_path}/t", KEY, SCHEMA)
    halves = [ops.where("value % 2 = 1"), ops.where("value % 2 = 0"), ops.where("value % 2 = 0")]
    for part in halves:
        apply_batch(t, part)
    want = sorted((r[0], r[1]) for r in ops.groupBy("key").agg(F.max("value")).collect())
    assert seen(t) == want

    ops.repartition(3).write.parquet(f"{tmp_path}/in")
    live = KeyedTable.create(spark, f"{tmp_path}/live", KEY, SCHEMA)
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    replicate(stream, live, f"{tmp_path}/cp").awaitTermination(120)
    assert seen(live) == want


def test_transactions_abort_cascade_and_commit():
    t = Transactions()
    a = t.begin()
    t.put(a, 3, 9)
    assert t.commit(a).state == "committed"
    b, c = t.begin(), t.begin()
    t.put(b, 3, 10)
    assert t.get(c, 3) == 10
    with pytest.raises(TransactionAbortedError):
        t.put(b, 3, 6)
    assert t.read_committed(3) == 9 and t.values[3] == 9
    with pytest.raises(TransactionAbortedError):
        t.commit(c)
    assert t.state(b) is t.state(c) is State.ABORTED
    with pytest.raises(TransactionAlreadyCommittedError):
        t.commit(a)
    with pytest.raises(TransactionNotFoundError):
        t.get(99, 1)


def test_transactions_read_committed():
    t = Transactions()
    t.put_committed(3, 5)
    a = t.begin()
    t.put(a, 3, 9)
    t.put(a, 7, 21)
    assert (t.read_committed(3), t.read_committed(7), t.read_committed(3, a)) == (5, None, 9)
    t.commit(a)
    b = t.begin()
    t.delete(b, 7)
    assert t.read_committed(7) == 21
    t.commit(b)
    assert t.read_committed(7) is None


def test_transactions_write_rule_and_rollback():
    t = Transactions()
    a, b = t.begin(), t.begin()
    assert t.put(b, 5, 12)
    t.commit(b)
    assert not t.put(a, 5, 13) and t.commit(a).state == "committed" and t.values[5] == 12
    t.put_committed(7, 10)
    c = t.begin()
    t.put(c, 7, 11)
    t.put(c, 7, 12)
    t.rollback(c)
    assert t.values[7] == 10


def test_transactions_isolation_pending_and_retry():
    t = Transactions()
    a, b = t.begin(), t.begin()
    t.put(a, 9, 21)
    t.put(b, 5, 12)
    assert t.get(b, 9) == 21
    assert t.prepare(b).pending == [a]
    with pytest.raises(TransactionAbortedError):
        t.get(a, 5)
    with pytest.raises(TransactionAbortedError):
        t.commit(b)
    assert t.values.get(9) is None and t.values.get(5) is None
    assert t.run(lambda tx: t.put(tx, 1, 1)) is True
    assert t.compact() == 3 and t.uncommitted() == []
    d = t.begin()
    t.put(d, 1, 2)
    assert t.rollback_all() == [d] and t.values[1] == 1


def test_transactions_flush_to_a_table(spark, tmp_path):
    table = KeyedTable.create(spark, f"{tmp_path}/t", KEY, SCHEMA)
    t = Transactions()
    t.put_committed(1, 10)
    t.put_committed(2, 20)
    t.put_committed(2, None)
    a = t.begin()
    t.put(a, 3, 30)
    t.flush(table, lambda k, v: (k, v))
    assert seen(table) == [(1, 10)]
    t.commit(a)
    t.flush(table, lambda k, v: (k, v))
    assert seen(table) == [(1, 10), (3, 30)]


def test_two_keys_rewrite_two_files(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", KEY, SCHEMA, Options(part_min=5, part_max=10, disk_max=100_000, unsafe=True))
    t.append(spark.range(100).selectExpr("cast(id as int) AS key", "cast(id as int) AS value"))
    t.evict()
    before = {p.path for p in t.manifest().disk.parts}
    assert len(before) >= 10
    t.append(batch(spark, [(0, -1), (99, -2)]))
    t.evict()
    parts = t.manifest().disk.parts
    assert len(before & {p.path for p in parts}) == len(before) - 2
    assert seen(t) == [(0, -1), *((i, i) for i in range(1, 99)), (99, -2)] and t.count() == 100
    assert all(p.high - p.low <= 20 for p in parts)  # no file reaches over those carried


@pytest.mark.parametrize("kind", ["string", "timestamp", "date", "double"])
def test_merges_of_other_keys(spark, tmp_path, kind):
    make = {"string": "lpad(string(id), 3, '0')", "timestamp": "timestamp_seconds(id * 86400)", "date": "date_add(date'2020-01-01', cast(id as int))", "double": "cast(id as double)"}[kind]
    rows = spark.range(60).selectExpr(f"{make} AS key", "cast(id as int) AS value")
    t = KeyedTable.create(spark, f"{tmp_path}/t", KEY, rows.schema, Options(part_min=5, part_max=10, disk_max=100_000, unsafe=True))
    t.append(rows)
    t.evict()
    before = {p.path for p in t.manifest().disk.parts}
    t.append(rows.where("value = 5").selectExpr("key", "-1 AS value"))
    t.append(spark.createDataFrame([(None, 7)], f"key {kind}, value int"))
    t.evict()
    assert sorted(r["value"] for r in t.view().collect()) == sorted([-1, 7, *(i for i in range(60) if i != 5)])
    assert kind == "double" or len(before & {p.path for p in t.manifest().disk.parts}) >= len(before) - 3


def test_tombstones_of_carried_files_are_counted(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", KEY, SCHEMA, SMALL)
    t.append(batch(spark, [(i, i) for i in range(12)]))
    t.evict()  # above disk_max: to the bottom
    t.append(batch(spark, [(i, None) for i in range(4)]))
    t.evict()
    t.append(batch(spark, [(i, None) for i in range(4, 12)] + [(50, 1)]))
    t.evict()
    while len(t.manifest().bottom) > 1:
        t.merge_bottom(0, len(t.manifest().bottom) - 1)
    t.append(batch(spark, [(60, 1)]))
    assert t.count() == t.view().count()
    t.evict()
    assert t.count() == t.view().count() == 2


def test_bottom_merge_carries_files_apart(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", KEY, SCHEMA, SMALL)
    for low in (0, 100, 5):
        t.append(batch(spark, [(low + i, low) for i in range(12)]))
        t.evict()
    apart = {p.path for s in t.manifest().bottom for p in s.parts if p.low >= 100}
    want = seen(t)
    assert len(t.manifest().bottom) == 3 and t.merge_bottom(0, 2) == "success"
    m = t.manifest()
    assert len(m.bottom) == 1 and apart <= {p.path for p in m.bottom[0].parts} and seen(t) == want


def test_nothing_is_lost_in_large_appends(spark, tmp_path):
    n = 2_000_000
    rows = spark.range(n).selectExpr("cast(id * 7919 % 1000003 as int) AS key", "concat(repeat('x', 60), id) AS value")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        t = KeyedTable.create(spark, f"{tmp_path}/t", KEY, rows.schema)
        assert t.append(rows) == n
        r = t.log().selectExpr("count(*)", f"count(distinct {OP})", f"min({OP})", f"max({OP})").first()
        assert tuple(r) == (n, n, 1, n) and t.view().count() == 1000003
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_a_version_is_published_once(spark, tmp_path):
    from tidelog.sources.files import Files

    files = Files(spark, str(tmp_path))
    for path in (f"{tmp_path}/m/v1.json", f"file://{tmp_path}/m/v2.json"):
        files.write_new(path, "one")
        with pytest.raises(CommitConflictError):
            files.write_new(path, "two")
        assert files.read(path) == "one"
    assert files.names(f"{tmp_path}/m") == ["v1.json", "v2.json"]


def test_small_parts_share_files(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", KEY, SCHEMA, SMALL)
    for low, high in ((0, 6000), (3000, 3100), (20_000, 26_000)):
        t.append(spark.range(low, high).selectExpr("cast(id as int) AS key", f"cast(id + {low} as int) AS value"))
        t.evict()
    m, want = t.manifest(), seen(t)
    assert len({p.path for s in m.bottom for p in s.parts}) <= 40 and max(p.rows for s in m.bottom for p in s.parts) <= 20
    apart = {(p.path, p.start) for s in m.bottom for p in s.parts if p.high < 3000 or p.low >= 3100}
    assert t.merge_bottom(0, 2) == "success"
    (bottom,) = t.manifest().bottom
    # parts apart are carried, though their files have others that are not
    assert apart <= {(p.path, p.start) for p in bottom.parts} and bottom.rows == 12_000 and seen(t) == want
    assert max(p.rows for p in bottom.parts) <= 20
    assert [x for x in seen(t, low=2990, high=3110) if 2990 <= x[0] <= 3110] == [x for x in want if 2990 <= x[0] <= 3110]
    b = Backup(t, f"{tmp_path}/b")
    b.take()
    t.vacuum()
    assert seen(t) == want == seen(b.restore(f"{tmp_path}/r"))


def test_files_mostly_dead_are_rewritten():
    from tidelog.sources.table import Part, _not_worn

    a, b, c = Part("a", 4, 0, 3, 0, 0, 10), Part("b", 5, 4, 8, 0, 0, 10), Part("c", 3, 9, 9)
    assert _not_worn([a, b, c]) == [b, c]


def test_parts_apart_are_found_by_one_sort():
    import random

    from tidelog.sources.table import Part, _apart

    draw = random.Random(1)
    for n in range(300):
        parts = []
        for k in range(draw.randrange(1, 12)):
            low = draw.randrange(60)
            bare = n % 5 == 0 and draw.random() < 0.1
            parts.append((draw.randrange(4), Part(str(k), 1) if bare else Part(str(k), 1, low, low + draw.randrange(4))))
        want = [p for i, p in parts if p.low is not None and not any(j != i and p.overlaps(q.low, q.high) for j, q in parts)]
        assert _apart(parts) == want
    from time import process_time

    start = process_time()
    many = [(k % 3, Part(str(k), 1, 2 * k, 2 * k + k % 7)) for k in range(100_000)]
    assert _apart(many) and process_time() - start < 20


def test_merges_of_many_small_parts(spark, tmp_path):
    t = KeyedTable.create(spark, f"{tmp_path}/t", KEY, SCHEMA, SMALL.clone(disk_max=100_000))
    want = {}
    for step, low in ((1, 0), (3, 1), (4000, 7), (2, 0)):
        rows = spark.range(low, 8000, step).selectExpr("cast(id as int) AS key", f"cast(id + {step} as int) AS value", f"id % 50 = 0 AS {DELETED}")
        before = t.manifest().disk
        t.append(rows)
        t.evict()
        for i in range(low, 8000, step):
            want.pop(i, None)
            if i % 50:
                want[i] = i + step
        parts = t.manifest().disk.parts
        assert len({p.path for p in parts}) <= 12 and max(p.rows for p in parts) <= 20 and seen(t) == sorted(want.items()) and t.count() == len(want)
        if step == 4000:  # two keys: all parts but two are carried, and none of them is reached over
            assert len({(p.path, p.start) for p in before.parts} - {(p.path, p.start) for p in parts}) == 2
            ends = sorted((p.low, p.high) for p in parts)
            assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_many_cuts_are_not_copied_into_rows(spark):
    from tidelog.operators.ranks import Cuts

    for kind, make in ((T.LongType(), int), (T.StringType(), lambda i: f'é"{i:04}')):
        cuts = Cuts.of([make(i) for i in range(0, 900, 3)], kind)
        rows = [(i, make(i)) for i in range(-2, 905)] + [(None, None)]
        df = spark.createDataFrame(rows, T.StructType([T.StructField("i", T.LongType()), T.StructField("k", kind)]))
        out = cuts.numbered(df, [(df["k"], True)], "n")
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
        keys = sorted(cuts.rows)
        assert {r["i"]: r["n"] for r in out.collect()} == {i: 0 if k is None else sum(c[0] <= k for c in keys) for i, k in rows}
