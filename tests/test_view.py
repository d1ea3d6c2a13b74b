"""Views and reads against a dictionary that replays the log."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.errors import NotPositionedError
from tidelog.operators import read as R
from tidelog.operators import write as X
from tidelog.operators.cursor import Cursor
from tidelog.plans.view import last_write_wins, visible
from tidelog.spec import DELETED, LAYER, OP, KeyColumn, KeySpec, Options, empty_binary, never_deleted, sentinel

KEY = KeySpec.of("key")
DDL = f"key int, value int, {OP} long, {DELETED} boolean"


def log_of(spark, ops):
    return spark.createDataFrame([(k, v, i + 1, v is None) for i, (k, v) in enumerate(ops)], DDL)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


@pytest.fixture(scope="module")
def iterated(spark):
    """Keys 0..499 in two halves, four of them deleted in between."""
    ops = [(i, 2 * i) for i in range(250)] + [(k, None) for k in (127, 19, 20, 21)] + [(i, 2 * i) for i in range(250, 500)]
    return visible(log_of(spark, ops), KEY)


def test_forward_and_reverse_scan(iterated):
    want = [(i, 2 * i) for i in range(500) if i not in (19, 20, 21, 127)]
    assert rows(R.scan(iterated, KEY), "key", "value") == want and len(want) == 496
    assert rows(R.scan(iterated, KEY, reverse=True), "key", "value") == want[::-1]


def test_seeks(iterated):
    assert R.ceiling(iterated, KEY, [13]).first()["key"] == 13
    assert R.ceiling(iterated, KEY, [20]).first()["key"] == 22
    assert R.floor(iterated, KEY, [20]).first()["key"] == 18
    assert R.seek(iterated, KEY, [451], reverse=True).first()["key"] == 451
    assert rows(R.first(iterated, KEY, 2), "key") == [(0,), (1,)]
    assert rows(R.first(iterated, KEY, 2, reverse=True), "key") == [(499,), (498,)]
    assert R.floor(iterated, KEY, [-1]).count() == 0


def test_cursor(iterated):
    c = Cursor(lambda: iterated, KEY)
    with pytest.raises(NotPositionedError):
        _ = c.current
    c.seek([20])
    assert not c.has_current
    assert c.next() and c.current_key() == [22]
    c.refresh()
    assert c.next() and c.current_key() == [23]


def test_random_logs_match_a_dictionary(spark):
    rng = random.Random(5)
    for _ in range(3):
        ops = [(rng.randrange(40), rng.choice([None, rng.randrange(1000)])) for _ in range(400)]
        state = {}
        for k, v in ops:
            state[k] = v
        want = sorted((k, v) for k, v in state.items() if v is not None)
        log = log_of(spark, ops)
        assert rows(R.scan(visible(log, KEY), KEY), "key", "value") == want
        assert last_write_wins(log, KEY).count() == len(state)


def test_layers_beat_operation_indexes(spark):
    log = spark.createDataFrame([(1, 10, 9, False, 1), (1, 20, 3, False, 0), (2, 1, 5, True, 0), (2, 2, 4, False, 1)], f"{DDL}, {LAYER} int")
    assert rows(visible(log, KEY, by_layer=True), "key", "value") == [(1, 20)]
    assert rows(visible(log, KEY), "key", "value") == [(1, 10)]


def test_a_sentinel_is_deleted_only_where_asked(spark):
    log = log_of(spark, [(1, 5), (1, -1), (2, 0)])
    assert rows(visible(log, KEY, is_deleted=sentinel("value", -1)), "key") == [(2,)]
    assert visible(log, KEY, is_deleted=never_deleted).count() == 2


def test_empty_binary_and_null_sentinel(spark):
    df = spark.createDataFrame([(1, bytearray(b"")), (2, bytearray(b"x")), (3, None)], "key int, value binary")
    assert rows(df.where(~empty_binary("value")(df)), "key") == [(2,)]


def test_key_orders(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "key double")
    got = rows(df.orderBy(*KeySpec.of(KeyColumn("key", nan_first=True)).order()), "key")
    assert got[0] == (None,) and got[-1] == (1.0,)
    b = spark.createDataFrame([(bytearray(b"\x00"),), (bytearray(b"\x01\x02"),), (bytearray(b"\x01"),)], "key binary")
    got = [bytes(r[0]) for r in b.orderBy(*KeySpec.of(KeyColumn("key", longer_first=True)).order()).collect()]
    assert got == [b"\x00", b"\x01\x02", b"\x01"]
    s = spark.createDataFrame([("\U0001f600",), ("￮",)], "key string")
    assert rows(s.orderBy(*KeySpec.of(KeyColumn("key", utf16=True)).order()), "key")[0] == ("\U0001f600",)
    assert rows(s.orderBy(*KeySpec.of("key").order()), "key")[0] == ("￮",)
    d = KeySpec.of(KeyColumn("a", ascending=False), "b")
    t = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "a int, b int")
    assert rows(R.seek(t, d, [1, 1]), "a", "b") == [(1, 1), (1, 2), (0, 0), (0, 1), (0, 2)]
    assert rows(R.after(t, d, [1, 1], reverse=True), "a", "b") == [(1, 0), (2, 2), (2, 1), (2, 0)]
    assert KeySpec.from_json(d.to_json()) == d


def test_null_keys_come_first(spark):
    df = spark.createDataFrame([("Abc",), (None,), ("",), ("Cbc",)], "key string")
    assert rows(df.orderBy(*KEY.order()), "key") == [(None,), ("",), ("Abc",), ("Cbc",)]


def test_prefix(spark):
    df = spark.createDataFrame([(f"{i // 10}-{i}", i) for i in range(250, 501)], "key string, value int")
    assert rows(R.scan(R.with_prefix(df, "key", "41-"), KEY), "value") == [(i,) for i in range(410, 420)]
    assert R.seek(df, KEY, ["41-"]).first()["value"] == 410
    assert R.seek(df, KEY, ["41-"], reverse=True).first()["value"] == 409
    assert R.successor("a\U0010ffff") == "b" and R.successor("\U0010ffff") is None and R.successor("퟿") == ""


def test_as_of_joins_in_bands(spark):
    rng = random.Random(2)
    keys, probes = sorted(rng.sample(range(1000), 60)), [rng.randrange(-20, 1020) for _ in range(200)]
    k, p = spark.createDataFrame([(x,) for x in keys], "k long"), spark.createDataFrame([(x,) for x in [*probes, None]], "p long")
    for bands in (1, 4, 9):
        low = {r["p"]: r["floor_key"] for r in R.floor_join(k, p, key="k", probe="p", bands=bands).collect()}
        high = {r["p"]: r["ceiling_key"] for r in R.ceiling_join(k, p, key="k", probe="p", bands=bands).collect()}
        for x in probes:
            assert low[x] == max((y for y in keys if y <= x), default=None)
            assert high[x] == min((y for y in keys if y >= x), default=None)
        assert low[None] is None


def test_ordinals_and_dense_operation_indexes(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5003).alias("key"))
    got = R.ordinals(df, KEY).orderBy("key").collect()
    assert [r["ordinal"] for r in got] == list(range(5000))
    ops = X.assign_ops(df, 11, "key").orderBy("key").collect()
    assert [r[OP] for r in ops] == list(range(11, 5011))


def test_add_update_delete(spark):
    view = visible(log_of(spark, [(1, 10), (2, 20)]), KEY)
    batch = spark.createDataFrame([(2, 21, 3, False), (3, 30, 4, False), (3, 31, 5, False)], DDL)
    assert rows(X.try_add(view, batch, KEY), "key", "value") == [(3, 30)]
    assert rows(X.try_update(view, batch, KEY), "key", "value") == [(2, 21)]
    gone = X.try_delete(view, batch.select("key", OP), KEY)
    assert rows(visible(X.upsert(view, gone), KEY), "key") == [(1,)]
    feed = X.results(view, batch, KEY, cancelled=F.col("value") == 30).orderBy(OP)
    assert rows(feed, "key", "result", "returned") == [(2, "Updated", False), (3, "Cancelled", False), (3, "Added", True)]


def test_ordered_fold_of_a_log(spark):
    log = log_of(spark, [(1, 2), (1, 3), (2, 7), (1, 4)])
    out = X.fold(log, KEY, start=F.lit(1), step=lambda acc, r: acc * 10 + r["value"])
    assert sorted(rows(out, "key", "value")) == [(1, 1234), (2, 17)]


def test_options_are_checked():
    from tidelog.errors import InvalidOptionError

    for bad in ({"mutable_max": 10}, {"disk_max": 10}, {"part_min": 5, "part_max": 5}, {"compression": "x"}):
        with pytest.raises(InvalidOptionError):
            Options(**bad).checked()
    assert Options(mutable_max=10, unsafe=True).checked().clone(mutable_max=11).mutable_max == 11


def test_ordinals_over_many_ranges(spark, monkeypatch):
    from tidelog.operators import ranks

    monkeypatch.setattr(ranks, "PART_ROWS", 500)
    df = spark.range(20_000).selectExpr("if(id % 17 = 0, null, id * 31 % 997) AS key", "string(id % 5) AS s", "id AS __part")
    for key in (KeySpec.of("key", "s"), KeySpec.of(KeyColumn("key", ascending=False), "s"), KeySpec.of("s", KeyColumn("key", ascending=False))):
        got = R.ordinals(df, key).orderBy("ordinal").collect()
        assert [r["ordinal"] for r in got] == list(range(20_000))
        assert [(r["key"], r["s"]) for r in got] == [(r["key"], r["s"]) for r in df.orderBy(*key.order()).collect()]
    ops = X.assign_ops(df, 100, (F.col("key"), False), "s").collect()
    assert sorted(r[OP] for r in ops) == list(range(100, 20_100))
    hot = spark.range(5000).selectExpr("1 AS key", "id")
    assert sorted(r["ordinal"] for r in R.ordinals(hot, KEY).collect()) == list(range(5000))


def test_seeks_follow_the_keys_order(spark):
    nan = float("nan")
    cases = [
        ("key double", [nan, 1.0, 2.0, None, -1.0, float("inf")], KeyColumn("key", nan_first=True)),
        ("key double", [nan, 1.0, 2.0, None, -1.0], KeyColumn("key")),
        ("key double", [nan, 1.0, 2.0, None, -1.0], KeyColumn("key", ascending=False, nan_first=True)),
        ("key string", ["", "\U00010000", "a", "", None], KeyColumn("key", utf16=True)),
        ("key string", ["", "\U00010000", "a", "", None], KeyColumn("key", ascending=False)),
        ("key binary", [b"a", b"ab", b"abc", b"b", b"", None], KeyColumn("key", longer_first=True)),
        ("key binary", [b"a", b"ab", b"abc", b"b", b"", None], KeyColumn("key", ascending=False, longer_first=True)),
        ("key string", ["b", "A", "c", None], KeyColumn("key", collation="UTF8_LCASE")),
    ]
    same = lambda a, b: a == b or (a != a and b != b)
    for schema, values, column in cases:
        key, df = KeySpec.of(column), spark.createDataFrame([(v,) for v in values], schema)
        forward, back = ([r[0] for r in R.scan(df, key, reverse=x).collect()] for x in (False, True))
        assert all(same(a, b) for a, b in zip(forward, reversed(back), strict=True)), column
        for order, reverse in ((forward, False), (back, True)):
            for i, v in enumerate(order):
                got = [r[0] for r in R.seek(df, key, [v], reverse=reverse).collect()]
                assert len(got) == len(order) - i and all(same(a, b) for a, b in zip(got, order[i:], strict=True)), (column, v, got)
                assert len(R.after(df, key, [v], reverse=reverse).collect()) == len(order) - i - 1
                assert R.one(df, key, [v]).count() == 1


def test_as_of_joins_in_key_order(spark):
    import datetime

    day = lambda i: datetime.datetime(2020, 1, 1) + datetime.timedelta(hours=i)
    kinds = [("string", lambda i: f"k{i:04d}"), ("timestamp", day), ("double", lambda i: float(i) if i % 50 else float("nan")), ("decimal(9,2)", lambda i: __import__("decimal").Decimal(i))]
    for kind, make in kinds:
        keys = spark.createDataFrame([(make(i),) for i in range(0, 600, 3)] + [(None,)], f"v {kind}")
        probes = spark.createDataFrame([(make(i), i) for i in range(1, 300, 7)] + [(None, -1)], f"v {kind}, found int")
        for column in (KeyColumn("v"), KeyColumn("v", ascending=False)):
            order = [r[0] for r in keys.where("v is not null").distinct().orderBy(*KeySpec.of(column).order()).collect()]
            rank = {r["v"]: r["ordinal"] for r in R.ordinals(keys.union(probes.select("v")).where("v is not null").distinct(), KeySpec.of(column)).collect()}
            for bands in (1, 7, 90):
                low = {r["found"]: r["floor_key"] for r in R.floor_join(keys, probes, key=column, probe="v", bands=bands).collect()}
                high = {r["found"]: r["ceiling_key"] for r in R.ceiling_join(keys, probes, key=column, probe="v", bands=bands).collect()}
                assert len(low) == probes.count() and low[-1] is None and high[-1] is None
                if kind == "double":
                    continue  # NaN is no key of a dictionary
                for r in probes.where("v is not null").collect():
                    before = [k for k in order if rank[k] <= rank[r["v"]]]
                    after = [k for k in order if rank[k] >= rank[r["v"]]]
                    assert low[r["found"]] == (before[-1] if before else None) and high[r["found"]] == (after[0] if after else None)


def test_updates_see_earlier_ones(spark):
    view = spark.createDataFrame([(1, 10), (None, 3)], "key int, value int")
    batch = spark.createDataFrame([(1, 5, 1), (1, 7, 2), (2, 1, 3), (None, 4, 4), (2, 2, 5)], f"key int, gain int, {OP} long")
    gain = lambda old, r: {"value": old["value"] + r["gain"]}
    got = sorted((r[OP], r["old_value"], r["value"]) for r in X.get_and_update(view, batch, KEY, gain).collect())
    assert got == [(1, 10, 15), (2, 15, 22), (4, 3, 7)]
    both = {r[OP]: r for r in X.apply_in_order(view, batch, KEY, gain, add=lambda r: {"value": 100}).collect()}
    assert [both[i]["result"] for i in range(1, 6)] == ["Updated", "Updated", "Added", "Updated", "Updated"]
    assert both[5]["value"] == 102 and both[3]["returned"] and X.get_and_update(view, batch.limit(0), KEY, gain).count() == 0


def test_multi_get_keeps_both_of_equal_names(spark):
    view = spark.createDataFrame([(1, "v")], "key int, value string")
    keys = spark.createDataFrame([(1, "k", True), (2, "l", False)], "key int, value string, found boolean")
    got = sorted(R.multi_get(view, keys, KEY).collect())
    assert [(r["key"], r["value"], r["view_value"], r["found"]) for r in got] == [(1, "k", "v", True), (2, "l", None, False)]


@pytest.mark.parametrize("ascending", [True, False])
def test_skip_ranks_only_rows_near_its_place(spark, monkeypatch, ascending):
    from tidelog.operators import ranks

    monkeypatch.setattr(ranks, "NEAR_ROWS", 100)
    key = KeySpec.of(KeyColumn("key", ascending=ascending))
    # every key thrice, one key 700 times, some nulls
    rows = [(i * 7919 % 1001, j, "x") for i in range(1001) for j in range(3)] + [(500, j, "y") for j in range(700)] + [(None, j, "z") for j in range(9)]
    df = spark.createDataFrame(rows, "key int, value int, kind string").repartition(5)
    df.cache()
    places = sorted((r["ordinal"], (r["key"], r["value"], r["kind"])) for r in R.ordinals(df, key).collect())
    for n in (0, 1, 4, 700, 1800, 2000, len(rows) - 1, len(rows), len(rows) + 5):
        out = R.skip(df, key, n)
        got = [tuple(r) for r in out.collect()]
        want = [r for at, r in places if at >= n]
        assert sorted(map(str, got)) == sorted(map(str, want)) and [r[0] for r in got] == [r[0] for r in want]
        assert "Limit" not in out._jdf.queryExecution().executedPlan().toString()
    assert R.skip(df, key, 0).count() == len(rows)
