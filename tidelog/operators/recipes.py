"""Key layouts for common workloads over keyed tables: time series, event streams, queues, secondary indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.write import try_add
from tidelog.spec import KeySpec


def series_range(view: DataFrame, series: str, time: str, of: object, low: object, high: object) -> DataFrame:
    """One series in ``[low, high)``, oldest first."""
    return view.where((F.col(series) == F.lit(of)) & (F.col(time) >= F.lit(low)) & (F.col(time) < F.lit(high))).orderBy(series, time)


def latest(view: DataFrame, series: str, time: str, n: int = 1) -> DataFrame:
    """The newest ``n`` records of every series."""
    by = W.partitionBy(series).orderBy(F.col(time).desc())
    return view.withColumn("__rn", F.row_number().over(by)).where(F.col("__rn") <= n).drop("__rn")


def retained(view: DataFrame, time: str, since: Column) -> DataFrame:
    return view.where(F.col(time) >= since)


def rollup(view: DataFrame, series: str, time: str, unit: str, **aggregates: Column) -> DataFrame:
    return view.groupBy(series, F.date_trunc(unit, time).alias("bucket")).agg(*(a.alias(n) for n, a in aggregates.items()))


def stream_versions(events: DataFrame, stream: str, *order: str, out: str = "version") -> DataFrame:
    """Each event's version in its stream, from 1."""
    return events.withColumn(out, F.row_number().over(W.partitionBy(stream).orderBy(*order)).cast("long"))


def read_stream(view: DataFrame, stream: str, version: str, of: object, after: int = 0) -> DataFrame:
    return view.where((F.col(stream) == F.lit(of)) & (F.col(version) > after)).orderBy(version)


def append_if_absent(view: DataFrame, batch: DataFrame, key: KeySpec) -> DataFrame:
    """Idempotent append: events whose ``(stream, version)`` is free, each slot's first."""
    return try_add(view, batch, key)


def queue_pending(queue: DataFrame, acks: DataFrame, offsets: DataFrame, *, name: str = "queue", seq: str = "seq", committed: str = "committed") -> DataFrame:
    """Messages after their queue's committed offset and not acknowledged one by one."""
    rest = queue.join(offsets, name, "left").where(F.col(seq) > F.coalesce(F.col(committed), F.lit(-1))).drop(committed)
    return rest.join(acks.select(name, seq), [name, seq], "left_anti")


def queue_visible(pending: DataFrame, leases: DataFrame, now: Column, *, name: str = "queue", seq: str = "seq", until: str = "until") -> DataFrame:
    """Pending messages that no consumer holds: those without a lease or with one that has run out."""
    held = leases.where(F.col(until) > now).select(name, seq)
    return pending.join(held, [name, seq], "left_anti")


def secondary_index(view: DataFrame, columns: list[str], key: KeySpec, covering: list[str] | None = None) -> DataFrame:
    """Index entries in index order; with ``covering`` columns a read needs no lookup."""
    return view.select(*columns, *key.names, *(covering or [])).orderBy(*columns, *key.names)


def index_lookup(index: DataFrame, primary: DataFrame, where: Column, key: KeySpec) -> DataFrame:
    return primary.join(index.where(where).select(*key.names), key.names)


def partition_cell(view: DataFrame, by: Column, cells: int) -> DataFrame:
    """A hash cell of each row, for one directory per cell."""
    return view.withColumn("cell", F.pmod(F.xxhash64(by), F.lit(cells)).cast("int"))
