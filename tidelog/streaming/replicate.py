"""Replication of an out-of-order operation stream: each key takes an operation unless it has a later one.

Batch and stream agree in their final state. The stream form keeps nothing in memory between batches but what its target
table holds: each micro-batch is reduced to its newest record per key and merged in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.read import only_keys
from tidelog.plans.view import last_write_wins
from tidelog.sources.table import KeyedTable
from tidelog.spec import OP, KeySpec


def accepted(ops: DataFrame, key: KeySpec, *arrival: str | Column) -> DataFrame:
    """The operations that a replica takes, in order of arrival: those with no later one of their key before them.

    An equal operation index is taken again.
    """
    seen = F.max(OP).over(W.partitionBy(*key.names).orderBy(*arrival).rowsBetween(W.unboundedPreceding, 0))
    return ops.withColumn("__seen", seen).where(F.col(OP) >= F.col("__seen")).drop("__seen")


def apply_batch(table: KeyedTable, ops: DataFrame) -> int:
    """Merge a batch into a replica: only records newer than what it holds, or as new. Returns how many were taken."""
    newest = last_write_wins(ops, table.key)
    held = only_keys(table.log(), newest, table.key).groupBy(*table.key.names).agg(F.max(OP).alias("__held"))
    fresh = newest.join(held, table.key.names, "left").where(F.col("__held").isNull() | (F.col(OP) >= F.col("__held"))).drop("__held")
    return table.append(fresh, keep_ops=True)


def replicate(stream: DataFrame, table: KeyedTable, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Run a streaming DataFrame of operations into a replica; its checkpoint makes a restart go on where it stopped.

    A batch that is delivered again changes nothing, since its operations are not newer than what the replica holds.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: apply_batch(table, df) and None)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
