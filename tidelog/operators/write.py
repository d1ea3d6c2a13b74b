"""Writes as plans: a view and a batch in, new log records or a change feed out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.operators.ranks import unused, with_places
from tidelog.spec import DELETED, LAYER, OP, IsDeleted, KeySpec, SortKey, deleted_flag

#: Present values and a record, or a record alone, to the values to write; None writes nothing.
Change = Callable[..., dict | None]


def assign_ops(batch: DataFrame, start: int, *order: Column | str | SortKey, out: str = OP) -> DataFrame:
    """Dense operation indexes from ``start`` on, in the given order: ascending, or as ``(column, ascending)`` says."""
    keys = [o if isinstance(o, tuple) else (F.col(o) if isinstance(o, str) else o, True) for o in order]
    return with_places(batch, keys, start=start, out=out)


def upsert(log: DataFrame, batch: DataFrame) -> DataFrame:
    """Append; the newest record wins at the next read."""
    batch = batch if DELETED in batch.columns else batch.withColumn(DELETED, F.lit(False))
    return log.unionByName(batch.select(*log.columns))


def upsert_with_op(batch: DataFrame, **values: Callable[[Column], Column]) -> DataFrame:
    """Values that depend on the operation index that the record got."""
    return batch.withColumns({name: f(F.col(OP)) for name, f in values.items()})


def _first_per_key(batch: DataFrame, key: KeySpec) -> DataFrame:
    by = W.partitionBy(*key.group()).orderBy(F.col(OP))
    return batch.withColumn("__rn", F.row_number().over(by)).where("__rn = 1").drop("__rn")


def try_add(view: DataFrame, batch: DataFrame, key: KeySpec) -> DataFrame:
    """Records of keys that are not there, each key's first one."""
    return _first_per_key(batch.join(view.select(*key.names), key.names, "left_anti"), key)


def try_update(view: DataFrame, batch: DataFrame, key: KeySpec) -> DataFrame:
    """Records of keys that are there."""
    return batch.join(view.select(*key.names), key.names, "left_semi")


def try_delete(view: DataFrame, keys: DataFrame, key: KeySpec) -> DataFrame:
    """Tombstones for keys that are there, each key once, at its first operation."""
    return force_delete(_first_per_key(keys.join(view.select(*key.names), key.names, "left_semi"), key), view)


def force_delete(keys: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Tombstones whether or not the keys are there; value columns that ``keys`` lacks are null."""
    out = keys.withColumn(DELETED, F.lit(True))
    for f in like.schema if like is not None else []:
        if f.name not in out.columns:
            out = out.withColumn(f.name, F.lit(None).cast(f.dataType))
    return out.select(*like.columns) if like is not None else out


def apply_in_order(view: DataFrame, batch: DataFrame, key: KeySpec, update: Change, *, add: Change | None = None) -> DataFrame:
    """Read-modify-write of ``batch`` against ``view``, each key's records one after the other in order of operation.

    ``update(values, record)`` gets the key's present values, those that earlier records of the batch left, and returns the
    values to change, or None to write nothing. ``add(record)`` gives the values of a key that is not there, or None; without
    it such keys are left alone. A row per record: key, the values before as ``old_*`` and after, ``result`` (``Added``,
    ``Updated``, ``Cancelled``, ``NotFound``), ``returned`` (true for ``Added``), and the operation, 0 if nothing was written.

    A key's records lie in one partition, sorted, and pass one by one: what is held is one record, however many there are.
    Updates that commute belong in ``accumulate``, which sums up before the shuffle.
    """
    values = [c for c in view.columns if c not in (*key.names, OP, DELETED, LAYER)]
    fields = [c for c in batch.columns if c not in (*key.names, OP, DELETED, LAYER)]
    old = unused(view.select(*(F.lit(None).alias(f"old_{c}") for c in values), *values), "old") if any(f"old_{c}" in values for c in values) else "old"
    v = view.select(*(F.col(k).alias(f"v{i}") for i, k in enumerate(key.names)), F.struct(*values).alias("__old"))
    b = batch.select(*key.names, OP, F.struct(*fields, F.lit(True).alias("__record")).alias("__rec"))
    on = [F.col(k).eqNullSafe(F.col(f"v{i}")) for i, k in enumerate(key.names)]
    rows = b.join(v, on, "left").select(*key.names, OP, "__rec", "__old").repartition(*key.names).sortWithinPartitions(*key.names, OP)
    names = key.names
    schema = T.StructType([batch.schema[k] for k in names] + [T.StructField(f"{old}_{c}", view.schema[c].dataType) for c in values] + [T.StructField(c, view.schema[c].dataType) for c in values])
    schema = schema.add("result", "string").add("returned", "boolean").add(OP, "long").add(DELETED, "boolean")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = None, None
        for part in batches:
            out = []
            for r in part.to_pylist():
                k = tuple("nan" if r[x] != r[x] else (r[x],) for x in names)
                if k != held:
                    held, now = k, r["__old"]
                before = now or dict.fromkeys(values)
                if now is None:
                    new = add(r["__rec"]) if add else None
                    result = "Added" if new is not None else "Cancelled" if add else "NotFound"
                else:
                    new = update(dict(now), r["__rec"])
                    result = "Updated" if new is not None else "Cancelled"
                if new is not None:
                    now = before | new
                row = {x: r[x] for x in names} | {f"{old}_{c}": before[c] for c in values} | (now or before)
                out.append(row | {"result": result, "returned": result == "Added", OP: r[OP] if new is not None else 0, DELETED: False})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def get_and_update(view: DataFrame, batch: DataFrame, key: KeySpec, update: Change) -> DataFrame:
    """For keys that are there: old values as ``old_*``, whether a record is ``written``, and its values; in order, so that a
    key's second update sees what its first one wrote. Where ``update`` declines, nothing is written, at operation 0."""
    found = apply_in_order(view, batch, key, update).where("result <> 'NotFound'")
    return found.withColumn("written", F.col("result") == "Updated").drop("result", "returned")


def fold(log: DataFrame, key: KeySpec, *, start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None, out: str = "value") -> DataFrame:
    """Ordered read-modify-write of each key: its records in order of operation through ``step(acc, record)``.

    A key's records meet in one row, so this is for histories that fit there; ``apply_in_order`` has no such bound, and sums,
    counts and extremes belong in ``accumulate``.
    """
    rest = [c for c in log.columns if c not in key.names and c != OP]
    ordered = F.sort_array(F.collect_list(F.struct(F.col(OP), *(F.col(c) for c in rest))))
    done = F.aggregate(ordered, start, step, finish) if finish else F.aggregate(ordered, start, step)
    return log.groupBy(*key.group()).agg(done.alias(out), F.max(OP).alias(OP))


def accumulate(log: DataFrame, key: KeySpec, **aggregates: Column) -> DataFrame:
    """Commutative updaters as aggregates, which Spark sums up before the shuffle."""
    return log.groupBy(*key.group()).agg(*(a.alias(n) for n, a in aggregates.items()))


def counter(log: DataFrame, key: KeySpec) -> DataFrame:
    """A key's first operation adds zero, each later one increments."""
    return accumulate(log, key, value=F.count("*") - 1)


def results(view: DataFrame | None, batch: DataFrame, key: KeySpec, *, cancelled: Column | None = None) -> DataFrame:
    """The change feed of an add-or-update batch: ``Added``, ``Updated`` or ``Cancelled`` for each record.

    ``returned`` is what the call would have returned: true for ``Added`` only. Records that ``cancelled`` marks write nothing.
    """
    stop = F.lit(False) if cancelled is None else F.coalesce(cancelled, F.lit(False))
    rows = batch.withColumn("__stop", stop)
    if view is not None:
        rows = rows.join(view.select(*key.names).withColumn("__in", F.lit(True)), key.names, "left")
    else:
        rows = rows.withColumn("__in", F.lit(None).cast("boolean"))
    before = W.partitionBy(*key.names).orderBy(OP).rowsBetween(W.unboundedPreceding, -1)
    there = F.coalesce(F.col("__in"), F.lit(False)) | F.coalesce(F.max(~F.col("__stop")).over(before), F.lit(False))
    what = F.when(F.col("__stop"), "Cancelled").when(there, "Updated").otherwise("Added")
    return rows.withColumn("result", what).withColumn("returned", F.col("result") == "Added").drop("__stop", "__in")


def slide_expiration(expiration: Column, now: Column, interval: Column) -> Column:
    """A later expiration; never an earlier one."""
    return F.greatest(expiration, now + interval)


def expire(now: Column) -> Column:
    return now


def compact_log(log: DataFrame, key: KeySpec, *, is_deleted: IsDeleted = deleted_flag, keep_tombstones: bool = True) -> DataFrame:
    """Replay: each key's newest record, with or without tombstones; operation indexes stay."""
    from tidelog.plans.view import last_write_wins

    newest = last_write_wins(log, key)
    return newest if keep_tombstones else newest.where(~is_deleted(newest))
