"""The query catalogue over the driver tables: one entry for each operator that a query can show."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators import read as R
from tidelog.operators import recipes as C
from tidelog.operators import write as X
from tidelog.plans import view as V
from tidelog.sources.backup import Backup
from tidelog.sources.files import scratch_root
from tidelog.sources.table import KeyedTable, merge_layers
from tidelog.spec import DELETED, LAYER, OP, KeyColumn, KeySpec, Options, deleted_flag, either, expired, sentinel
from tidelog.streaming.replicate import accepted, apply_batch

Query = Callable[[SparkSession, str], DataFrame]
USER = KeySpec.of("user_id")
ORDER = KeySpec.of("o_orderkey")
CUSTOMER = KeySpec.of("c_custkey")
PART = KeySpec.of("p_name", "p_partkey")
TURN = KeySpec.of("conv_id", "turn")
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# Building blocks of the oracle SQL.
LOG = "SELECT user_id, event_type, value, event_id + 1 AS op, event_type = 'error' AS del FROM events"
LWW = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY op DESC) AS rn FROM ({LOG})) WHERE rn = 1"
HALF = "(SELECT count(*) // 2 FROM events)"
BASE = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY op DESC) AS rn FROM ({LOG}) WHERE op <= {HALF}) WHERE rn = 1 AND NOT del"
BATCH = f"SELECT * FROM ({LOG}) WHERE op > {HALF}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as an operation log: keyed by user, errors are tombstones."""
    events = table(spark, sf_dir, "events")
    log = V.log_of(events, op=F.col("event_id") + 1, deleted=F.col("event_type") == "error")
    return log.select("user_id", "event_type", "value", OP, DELETED)


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in four layers by age, 0 the newest."""
    log = event_log(spark, sf_dir)
    n = log.agg(F.max(OP)).first()[0] or 1
    return log.withColumn(LAYER, (3 - F.floor((F.col(OP) - 1) * 4 / F.lit(n))).cast("int"))


LAYERS = f"SELECT *, CAST(3 - floor((op - 1) * 4 / (SELECT max(event_id) + 1 FROM events)) AS INTEGER) AS layer FROM ({LOG})"


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The view of the first half of the log, and the second half as a batch."""
    log = event_log(spark, sf_dir)
    n = log.count() // 2
    return V.visible(log.where(F.col(OP) <= n), USER), log.where(F.col(OP) > n)


def shown(df: DataFrame) -> DataFrame:
    names = {OP: "op", DELETED: "del", LAYER: "layer"}
    return df.select(*(F.col(c).alias(names.get(c, c)) for c in df.columns))


@query(f"SELECT user_id, event_type, value, op, del FROM ({LWW}) WHERE NOT del ORDER BY user_id")
def merged_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.scan(V.visible(event_log(spark, sf_dir), USER), USER))


@query(f"SELECT user_id, event_type, value, op, del FROM ({LWW})")
def merged_view_with_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(V.visible(event_log(spark, sf_dir), USER, include_deleted=True))


@query(f"SELECT user_id, event_type, value, op, del FROM ({LWW}) WHERE NOT del ORDER BY user_id DESC")
def reverse_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.scan(V.visible(event_log(spark, sf_dir), USER), USER, reverse=True))


@query(f"SELECT user_id, event_type, value, op, del FROM ({LWW}) WHERE NOT del AND user_id >= 20 ORDER BY user_id")
def seek_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.seek(V.visible(event_log(spark, sf_dir), USER), USER, [20]))


@query(f"SELECT user_id, event_type, value, op, del FROM ({LWW}) WHERE NOT del AND user_id > 20 ORDER BY user_id")
def resume_after_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.after(V.visible(event_log(spark, sf_dir), USER), USER, [20]))


@query(f"SELECT user_id, event_type, value, op, del FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY op DESC) AS rn FROM ({LOG}) WHERE op <= 500) WHERE rn = 1 AND NOT del")
def snapshot_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(V.visible(event_log(spark, sf_dir).where(F.col(OP) <= 500), USER))


@query(f"SELECT user_id, event_type, value, op, del FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY layer, op DESC) AS rn FROM ({LAYERS})) WHERE rn = 1 AND NOT del")
def layered_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(V.visible(quarters(spark, sf_dir), USER, by_layer=True)).drop("layer")


@query(f"SELECT user_id, event_type, value, op, del FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY layer, op DESC) AS rn FROM ({LAYERS}) WHERE layer IN (1, 2)) WHERE rn = 1 AND NOT del")
def sealed_layers_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(V.visible(V.of_layers(quarters(spark, sf_dir), [1, 2]), USER, by_layer=True)).drop("layer")


@query(f"SELECT count(*) AS n FROM ({LWW}) WHERE NOT del")
def count_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.count_full_scan(V.visible(event_log(spark, sf_dir), USER))


@query(f"SELECT count(*) AS n FROM ({LWW}) WHERE NOT del")
def count_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, batch = halves(spark, sf_dir)
    return R.count_fast(base, V.last_write_wins(batch, USER), USER)


@query(f"SELECT layer, count(*) AS n_records, CAST(sum(del::BIGINT) AS BIGINT) AS n_tombstones FROM ({LAYERS}) GROUP BY layer")
def physical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.physical_counts(quarters(spark, sf_dir))


@query("SELECT max(event_id) + 1 AS max_op FROM events")
def max_op_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.max_op(event_log(spark, sf_dir))


@query("SELECT c_custkey * 7 AS o_orderkey, o_custkey, o_totalprice, o_orderkey IS NOT NULL AS found FROM customer LEFT JOIN orders ON o_orderkey = c_custkey * 7 AND o_orderstatus <> 'F'")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).alias("o_orderkey"))
    view = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey", "o_totalprice")
    return R.multi_get(view, keys, ORDER)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def contains_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return R.contains(view, table(spark, sf_dir, "customer").select("c_custkey"), CUSTOMER)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def missing_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.missing(view, table(spark, sf_dir, "customer").select("c_custkey"), CUSTOMER)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.one(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ORDER, [42])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900 ORDER BY o_orderkey")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scan(R.between(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ORDER, [100], [900]), ORDER)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25")
def reverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ORDER, 25, reverse=True)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 1000")
def skip_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.skip(table(spark, sf_dir, "orders").select("o_orderkey"), ORDER, 1000)


@query("SELECT p_name, p_partkey, p_brand FROM part WHERE p_name >= 'red ' AND p_name < 'red!' ORDER BY p_name, p_partkey")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scan(R.with_prefix(table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand"), "p_name", "red "), PART)


THIN = "(SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 = 0)"


@query(f"SELECT c_custkey, max(k) AS floor_key FROM customer LEFT JOIN {THIN} ON k <= c_custkey GROUP BY c_custkey")
def floor_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select("o_orderkey")
    return R.floor_join(view, table(spark, sf_dir, "customer").select("c_custkey"), key="o_orderkey", probe="c_custkey")


@query(f"SELECT c_custkey, min(k) AS ceiling_key FROM customer LEFT JOIN {THIN} ON k >= c_custkey GROUP BY c_custkey")
def ceiling_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select("o_orderkey")
    return R.ceiling_join(view, table(spark, sf_dir, "customer").select("c_custkey"), key="o_orderkey", probe="c_custkey")


@query("SELECT DISTINCT user_id, (SELECT max(o_orderdate) FROM orders WHERE o_orderdate <= day) AS floor_day FROM (SELECT user_id, max(ts) AS day FROM events GROUP BY user_id)")
def floor_seek_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("day"))
    return R.floor_join(table(spark, sf_dir, "orders"), probes, key="o_orderdate", probe="day", out="floor_day", bands=100).drop("day")


@query("SELECT c_name AS v, (SELECT min(p_name) FROM part WHERE p_name >= lower(c_name)) AS found, lower(c_name) AS low FROM customer")
def ceiling_seek_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    probes = table(spark, sf_dir, "customer").select(F.col("c_name").alias("v"), F.lower("c_name").alias("low"))
    return R.ceiling_join(table(spark, sf_dir, "part"), probes, key="p_name", probe="low", out="found", bands=16)


@query("SELECT c_custkey, (SELECT min(o_orderkey) FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey >= c_custkey) AS floor_key FROM customer")
def floor_seek_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a descending key the last key at or before a probe is the least one that is not smaller."""
    view = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select("o_orderkey")
    return R.floor_join(view, table(spark, sf_dir, "customer").select("c_custkey"), key=KeyColumn("o_orderkey", ascending=False), probe="c_custkey", bands=9)


@query("SELECT user_id, event_type, value, op, del FROM (" + LWW + ") WHERE NOT del AND (user_id <= 20 OR user_id IS NULL) ORDER BY user_id DESC")
def seek_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(R.seek(V.visible(event_log(spark, sf_dir), USER), USER, [20], reverse=True))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal FROM orders")
def ordinal_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ordinals(table(spark, sf_dir, "orders").select("o_orderkey"), ORDER)


@query("SELECT o_orderkey, ordinal FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS ordinal, count(*) OVER () AS n FROM orders) WHERE ordinal % 1024 = 0 OR ordinal = n - 1")
def sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sparse_index(table(spark, sf_dir, "orders").select("o_orderkey"), ORDER)


@query("SELECT CAST(o_orderkey // 500 AS BIGINT) AS part, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS n_rows, arg_max(o_totalprice, o_orderkey) AS last_value FROM orders GROUP BY 1")
def part_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.boundaries(table(spark, sf_dir, "orders"), F.floor(F.col("o_orderkey") / 500), "o_orderkey", "o_totalprice")


ADDED = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY op) AS r2 FROM ({BATCH}) WHERE user_id NOT IN (SELECT user_id FROM ({BASE}))) WHERE r2 = 1"


@query(f"SELECT user_id, event_type, value, op, del FROM ({ADDED})")
def try_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.try_add(*halves(spark, sf_dir), USER)).select("user_id", "event_type", "value", "op", "del")


@query(f"SELECT user_id, event_type, value, op, del FROM ({BATCH}) WHERE user_id IN (SELECT user_id FROM ({BASE}))")
def atomic_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.try_update(*halves(spark, sf_dir), USER)).select("user_id", "event_type", "value", "op", "del")


@query(f"SELECT user_id, min(op) AS op, true AS del FROM ({BATCH}) WHERE user_id IN (SELECT user_id FROM ({BASE})) GROUP BY user_id")
def try_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    view, batch = halves(spark, sf_dir)
    return shown(X.try_delete(view, batch.select("user_id", OP), USER)).select("user_id", "op", "del")


@query(f"SELECT user_id, event_type, value, op, del FROM ({BASE}) WHERE user_id NOT IN (SELECT user_id FROM ({BATCH}) WHERE op % 50 = 0)")
def force_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    view, batch = halves(spark, sf_dir)
    log = X.upsert(view, X.force_delete(batch.where(F.col(OP) % 50 == 0).select("user_id", OP), view))
    return shown(V.visible(log, USER))


@query(f"SELECT user_id, event_type, value, op, del FROM ({LWW}) WHERE NOT del")
def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    n = log.count() // 2
    old = V.last_write_wins(log.where(F.col(OP) <= n), USER)
    return shown(V.visible(X.upsert(old, log.where(F.col(OP) > n)), USER))


@query("SELECT user_id, event_id + 1 AS op, value + (event_id + 1) AS value FROM events")
def upsert_with_op_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    numbered = X.assign_ops(batch, 1, "event_id")
    return shown(X.upsert_with_op(numbered, value=lambda op: F.col("value") + op).select("user_id", OP, "value"))


# Updaters one after the other, as the operations are defined: each sees what the one before it left. Amounts are whole numbers.
AMOUNT = "CAST(floor(value) AS BIGINT)"
STATE = f"SELECT b.user_id, b.op, b.amount, v.amount AS base, b.op % 2 = 0 AS acts, row_number() OVER (PARTITION BY b.user_id ORDER BY b.op) AS n FROM (SELECT user_id, op, {AMOUNT} AS amount FROM ({BATCH})) b LEFT JOIN (SELECT user_id, {AMOUNT} AS amount FROM ({BASE})) v USING (user_id)"


def steps(found: str, add: str, adder: str, update: str, declines: str) -> str:
    """SQL that goes through each key's records one by one: the value is null as long as the key is not there."""
    start = f"CASE WHEN base IS NOT NULL THEN ({update.format(v='base')}) WHEN {adder} THEN {add} END"
    there = "base IS NOT NULL"
    first = f"SELECT user_id, op, n, base AS old, CASE WHEN {there} AND {declines} THEN base ELSE {start} END AS now, {there} AS was, ({there} AND NOT {declines}) OR (NOT {there} AND {adder}) AS wrote FROM s WHERE n = 1"
    then = f"SELECT s.user_id, s.op, s.n, r.now AS old, CASE WHEN r.now IS NULL THEN CASE WHEN {adder} THEN {add} END WHEN {declines} THEN r.now ELSE {update.format(v='r.now')} END AS now, r.now IS NOT NULL AS was, (r.now IS NOT NULL AND NOT {declines}) OR (r.now IS NULL AND {adder}) AS wrote FROM r JOIN s ON s.user_id = r.user_id AND s.n = r.n + 1"
    return f"WITH RECURSIVE s AS ({STATE}), r AS ({first} UNION ALL {then}) SELECT {found} FROM r"


RESULT = "CASE WHEN NOT wrote THEN 'Cancelled' WHEN was THEN 'Updated' ELSE 'Added' END AS result"
COMMON = f"user_id, old AS old_amount, now AS amount, CASE WHEN wrote THEN op ELSE 0 END AS op, {RESULT}, wrote AND NOT was AS returned"


def amounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    view, batch = halves(spark, sf_dir)
    amount = F.floor("value").cast("long").alias("amount")
    return view.select("user_id", amount, OP, DELETED), batch.select("user_id", amount, OP)


def _gain(old: dict, record: dict) -> dict:
    return {"amount": old["amount"] + record["amount"]}


@query(steps("user_id, old AS old_amount, now AS amount, CASE WHEN wrote THEN op ELSE 0 END AS op, wrote AS written", "NULL", "false", "{v} + amount", "false") + " WHERE was")
def get_and_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of a key adds to what the one before it left."""
    return shown(X.get_and_update(*amounts(spark, sf_dir), USER, _gain).drop(DELETED))


@query(steps("user_id, old AS old_amount, now AS amount, CASE WHEN wrote THEN op ELSE 0 END AS op, wrote AS written", "NULL", "false", "2 * {v} + 1", "old_parity") .replace("old_parity", "s.amount % 3 = 0").replace("FROM s WHERE n = 1", "FROM s WHERE s.n = 1") + " WHERE was")
def atomic_get_and_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An updater that declines some records, and whose order matters; amounts are kept small."""
    view, batch = amounts(spark, sf_dir)
    return shown(X.get_and_update(view, batch, USER, lambda old, r: None if r["amount"] % 3 == 0 else {"amount": 2 * old["amount"] + 1}).drop(DELETED))


@query(steps(COMMON, "s.amount", "true", "{v} + s.amount", "s.op % 2 = 1"))
def add_or_update_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add the record's value, or update by it; the updater cancels at odd operations."""
    view, batch = amounts(spark, sf_dir)
    batch = batch.withColumn("acts", F.col(OP) % 2 == 0)
    return shown(X.apply_in_order(view, batch, USER, lambda old, r: _gain(old, r) if r["acts"] else None, add=lambda r: {"amount": r["amount"]}).drop(DELETED))


@query(steps(COMMON, "1000 + s.amount", "s.op % 3 = 0", "{v} + s.amount", "false"))
def add_or_update_adder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An adder that makes the first value, or cancels; the key is added by a later record then."""
    view, batch = amounts(spark, sf_dir)
    batch = batch.withColumn("third", F.col(OP) % 3 == 0)
    return shown(X.apply_in_order(view, batch, USER, _gain, add=lambda r: {"amount": 1000 + r["amount"]} if r["third"] else None).drop(DELETED))


@query("SELECT user_id, count(*) - 1 AS value FROM events GROUP BY user_id")
def atomic_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.counter(event_log(spark, sf_dir), USER)


@query("SELECT user_id, string_agg(left(event_type, 1), '' ORDER BY event_id) AS value, max(event_id) + 1 AS op FROM events GROUP BY user_id")
def ordered_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).select("user_id", "event_type", OP)
    return shown(X.fold(log, USER, start=F.lit(""), step=lambda acc, r: F.concat(acc, F.substr(r["event_type"], F.lit(1), F.lit(1)))))


@query("SELECT event_id + 1 AS op, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 'Added' ELSE 'Updated' END AS result, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS returned FROM events")
def operation_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = X.results(None, event_log(spark, sf_dir), USER)
    return shown(out.select(OP, "user_id", "result", "returned"))


@query(f"SELECT user_id, event_type, value, op, del FROM ({LWW}) WHERE NOT del")
def seal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(merge_layers(quarters(spark, sf_dir), USER, [0, 1, 2, 3], older_remain=False)).drop("layer")


@query(f"SELECT user_id, event_type, value, op, del FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY layer, op DESC) AS rn FROM ({LAYERS}) WHERE layer <= 2) WHERE rn = 1")
def bottom_merge_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(merge_layers(quarters(spark, sf_dir), USER, [0, 1, 2], older_remain=True)).drop("layer")


ARRIVAL = "SELECT user_id, value, event_id + 1 AS op, (event_id * 7919) % 104729 AS arrival, event_id FROM events"


@query(f"SELECT user_id, value, op, arrival FROM (SELECT *, max(op) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING) AS m FROM ({ARRIVAL})) WHERE op >= m")
def replica_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    e = e.select("user_id", "value", (F.col("event_id") + 1).alias(OP), ((F.col("event_id") * 7919) % 104729).alias("arrival"), "event_id")
    return shown(accepted(e, USER, "arrival", "event_id").drop("event_id"))


@query("SELECT user_id, arg_max(value, event_id) AS value, max(event_id) + 1 AS op FROM events GROUP BY user_id")
def replica_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).select("user_id", "value", OP)
    return shown(V.last_write_wins(log, USER))


@query("SELECT user_id, event_type, value, event_id + 1 AS op, event_type = 'error' AS del FROM events ORDER BY op")
def replay_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(event_log(spark, sf_dir).orderBy(OP))


@query(f"SELECT user_id, event_type, value, op, del FROM ({LWW})")
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(X.compact_log(event_log(spark, sf_dir), USER))


TTL = "SELECT user_id, value, event_id + 1 AS op, ts + INTERVAL 1 DAY AS expiration FROM events"
NOW = "(SELECT max(ts) FROM events)"


def ttl_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    log = e.select("user_id", "value", (F.col("event_id") + 1).alias(OP), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expiration"))
    return log, e.agg(F.max("ts").alias("__now"))


@query(f"SELECT user_id, value, op, expiration FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY op DESC) AS rn FROM ({TTL})) WHERE rn = 1 AND expiration > {NOW}")
def ttl_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, now = ttl_log(spark, sf_dir)
    newest = V.last_write_wins(log, USER).join(F.broadcast(now))
    return shown(newest.where(~expired("expiration", F.col("__now"))(newest)).drop("__now"))


@query(f"SELECT user_id, op, greatest(expiration, {NOW} - INTERVAL 6 HOUR + INTERVAL 1 DAY) AS expiration FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY op DESC) AS rn FROM ({TTL})) WHERE rn = 1")
def ttl_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, now = ttl_log(spark, sf_dir)
    newest = V.last_write_wins(log, USER).join(F.broadcast(now))
    new = X.slide_expiration(F.col("expiration"), F.col("__now") - F.expr("INTERVAL 6 HOURS"), F.expr("INTERVAL 1 DAY"))
    return shown(newest.withColumn("expiration", new).select("user_id", OP, "expiration"))


@query(f"SELECT user_id, event_type, value, op FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY op DESC) AS rn FROM ({LOG})) WHERE rn = 1 AND NOT del AND event_type <> 'view'")
def custom_delete_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(V.visible(event_log(spark, sf_dir), USER, is_deleted=either(deleted_flag, sentinel("event_type", "view"))).drop(DELETED))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events")
def stream_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stream_versions(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("SELECT conv_id, turn, role FROM conversations WHERE turn > 2")
def append_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return C.append_if_absent(conv.where("turn <= 2"), conv.withColumn(OP, F.col("turn")), TURN).drop(OP)


@query("SELECT user_id AS queue, event_id AS seq FROM events JOIN (SELECT user_id AS u, max(event_id) // 2 AS c FROM events GROUP BY user_id) ON u = user_id WHERE event_id > c AND event_id % 5 <> 0")
def queue_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "events").select(F.col("user_id").alias("queue"), F.col("event_id").alias("seq"))
    offsets = queue.groupBy("queue").agg(F.floor(F.max("seq") / 2).alias("committed"))
    return C.queue_pending(queue, queue.where("seq % 5 = 0"), offsets)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def secondary_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    index = customer.select("c_mktsegment", F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return C.index_lookup(index, orders, F.col("c_mktsegment") == "BUILDING", KeySpec.of("o_custkey")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_mktsegment, c_nationkey, c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 5")
def covering_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = C.secondary_index(table(spark, sf_dir, "customer"), ["c_mktsegment", "c_nationkey"], CUSTOMER, ["c_acctbal"])
    return index.where("c_mktsegment = 'BUILDING' AND c_nationkey < 5")


@query("SELECT user_id, date_trunc('day', ts) AS bucket, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
def rollup_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.rollup(table(spark, sf_dir, "events"), "user_id", "ts", "day", n=F.count("*"), top=F.max("value"))
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn <= 3")
def latest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", 3)


@query("SELECT user_id, event_id, ts FROM events WHERE user_id = 7 AND ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND ts < (SELECT min(ts) FROM events) + INTERVAL 20 DAY")
def series_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    low = events.agg((F.min("ts") + F.expr("INTERVAL 1 DAY")).alias("a"), (F.min("ts") + F.expr("INTERVAL 20 DAYS")).alias("b")).first()
    return C.series_range(events, "user_id", "ts", 7, low["a"], low["b"])


@query("SELECT conv_id, turn, role FROM conversations WHERE (conv_id > 5 OR conv_id = 5 AND turn >= 2) AND (conv_id < 20 OR conv_id = 20 AND turn < 1) ORDER BY conv_id, turn")
def composite_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return R.scan(R.between(view, TURN, [5, 2], [20, 1]), TURN)


@query("SELECT conv_id, turn FROM conversations WHERE conv_id < 20 OR conv_id = 20 AND turn > 1 ORDER BY conv_id DESC, turn")
def descending_key_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = KeySpec.of(KeyColumn("conv_id", ascending=False), "turn")
    return R.after(table(spark, sf_dir, "conversations").select("conv_id", "turn"), key, [20, 1])


@query("SELECT min(p_name) AS first_name, lower(p_name) AS name, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name FROM part) GROUP BY lower(p_name)")
def collated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"))
    key = KeyColumn("p_name", collation="UTF8_LCASE")
    return part.groupBy(key.identity().alias("k")).agg(F.min(F.col("p_name")).alias("first_name"), F.count("*").alias("n")).select(
        F.collate("first_name", "UTF8_BINARY").alias("first_name"), F.lower(F.collate("k", "UTF8_BINARY")).alias("name"), "n"
    )


@query(f"SELECT * FROM (SELECT user_id, op, 'left' AS side FROM (SELECT user_id, op FROM ({BASE}) EXCEPT SELECT user_id, op FROM ({LWW}) WHERE NOT del)) UNION ALL (SELECT user_id, op, 'right' AS side FROM (SELECT user_id, op FROM ({LWW}) WHERE NOT del EXCEPT SELECT user_id, op FROM ({BASE})))")
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, _ = halves(spark, sf_dir)
    now = V.visible(event_log(spark, sf_dir), USER)
    return R.difference(shown(base).select("user_id", "op"), shown(now).select("user_id", "op"))


# Stored tables, through their whole life. Each query makes a table of its own in the shared folder, which goes when the driver ends.


def new_table(spark: SparkSession, log: DataFrame, **options: object) -> KeyedTable:
    path = f"{scratch_root(spark)}/tables/{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    schema = log.drop(OP, DELETED).schema
    return KeyedTable.create(spark, f"{path}/t", USER, T.StructType([T.StructField(f.name, f.dataType) for f in schema]), Options(**({"unsafe": True} | options)))


def in_batches(log: DataFrame, n: int) -> list[DataFrame]:
    top = log.agg(F.max(OP)).first()[0] or 0
    return [log.where((F.col(OP) > top * i // n) & (F.col(OP) <= top * (i + 1) // n)) for i in range(n)]


NEWEST = f"SELECT user_id, event_type, value, op, del FROM ({LWW}) WHERE NOT del"


@query(NEWEST)
def stored_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table itself gives the operation indexes, in the order of events."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", (F.col("event_type") == "error").alias(DELETED))
    t = new_table(spark, events.drop("event_id"))
    t.append(events, "event_id")
    return shown(t.view())


@query(NEWEST)
def stored_seal_and_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six batches, each merged into the disk slot in parts of a few keys; parts that a batch does not touch are carried over."""
    log = event_log(spark, sf_dir)
    t = new_table(spark, log, part_min=5, part_max=20)
    for b in in_batches(log, 6):
        t.append(b, keep_ops=True)
        t.evict()
    return shown(t.view())


@query(f"SELECT user_id, event_type, value, op, del FROM ({LWW}) WHERE NOT del AND user_id % 7 <> 0")
def stored_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    t = new_table(spark, log)
    t.append(log, keep_ops=True)
    t.evict()
    t.delete(log.where("user_id % 7 = 0").select("user_id"))
    return shown(t.view())


@query(f"SELECT count(*) AS n FROM ({LWW}) WHERE NOT del")
def stored_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the manifest and the delta alone."""
    log = event_log(spark, sf_dir)
    t = new_table(spark, log)
    first, *rest = in_batches(log, 3)
    t.append(first, keep_ops=True)
    t.evict()
    for b in rest:
        t.append(b, keep_ops=True)
    return spark.createDataFrame([(t.count(),)], "n long")


@query(NEWEST)
def stored_bottom_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch moves to the bottom; the two newest bottom segments but one are merged, tombstones kept."""
    log = event_log(spark, sf_dir)
    t = new_table(spark, log, disk_max=1, part_min=5, part_max=50)
    for b in in_batches(log, 4):
        t.append(b, keep_ops=True)
        t.evict()
    t.merge_bottom(1, 2)
    return shown(t.view())


@query(NEWEST)
def backup_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live backup after a merge and an open delta, restored as a table of its own."""
    log = event_log(spark, sf_dir)
    t = new_table(spark, log)
    first, second = in_batches(log, 2)
    t.append(first, keep_ops=True)
    t.evict()
    t.append(second, keep_ops=True)
    backup = Backup(t, t.path.removesuffix("/t") + "/backup", mode="live")
    backup.take()
    return shown(backup.restore(t.path.removesuffix("/t") + "/restored").view())


@query("SELECT user_id, event_type, value, op, del FROM (" + LWW + ")")
def replica_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations delivered out of order, in three batches, into a stored replica: its newest records, tombstones too."""
    log = event_log(spark, sf_dir)
    t = new_table(spark, log)
    for i in range(3):
        apply_batch(t, log.where((F.col(OP) * 7919) % 3 == i))
    return shown(t.view(include_deleted=True))


@query(f"SELECT user_id, event_type, value, op, del FROM ({LWW}) WHERE NOT del AND user_id % 5 = 0")
def stored_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    t = new_table(spark, log)
    t.append(log, keep_ops=True)
    return shown(t.get(log.where("user_id % 5 = 0").select("user_id")))
