"""Views of an operation log: the newest record of each key, with or without its tombstone.

All of these are plans only. A filter on key columns put above a view is pushed below it to the scan by Catalyst; one on values
stays above it, as it must: an older record must not come up because the newest one does not match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.spec import DELETED, LAYER, OP, IsDeleted, KeySpec, deleted_flag


def log_of(df: DataFrame, *, op: Column | None = None, deleted: Column | None = None, layer: Column | None = None) -> DataFrame:
    """A DataFrame as an operation log: its rows with their operation index, tombstone flag and, if given, layer."""
    out = {}
    if op is not None:
        out[OP] = op.cast("long")
    if deleted is not None:
        out[DELETED] = F.coalesce(deleted, F.lit(False))
    if layer is not None:
        out[LAYER] = layer.cast("int")
    df = df.withColumns(out)
    return df if DELETED in df.columns else df.withColumn(DELETED, F.lit(False))


def last_write_wins(log: DataFrame, key: KeySpec, *, rank: list[Column] | None = None) -> DataFrame:
    """The newest record of each key, tombstones too; one partial and one final aggregation.

    ``rank`` orders records from old to new; by default the operation index. Equal ranks: the greater record.
    """
    rest = [c for c in log.columns if c not in key.names]
    rank = rank or [F.col(OP)]
    newest = F.max_by(F.struct(*rest), F.struct(*rank, *([F.col(OP)] if OP in rest else []))).alias("__r")
    return log.groupBy(*key.group()).agg(newest).select(*key.names, *(F.col(f"__r.{c}").alias(c) for c in rest)).select(*log.columns)


def layered(log: DataFrame, key: KeySpec) -> DataFrame:
    """The record of the newest layer that holds the key, whatever the operation indexes say; layer 0 is the newest."""
    return last_write_wins(log, key, rank=[-F.col(LAYER)])


def layered_in_ranges(log: DataFrame, key: KeySpec) -> DataFrame:
    """``layered`` of a log that lies in ranges of keys, for writing: the sort that picks each key's record is the one that the
    file is written in."""
    newest = F.row_number().over(W.partitionBy(*key.group()).orderBy(F.col(LAYER), F.col(OP).desc()))
    return log.withColumn("__newest", newest).where("__newest = 1").drop("__newest")


def visible(log: DataFrame, key: KeySpec, *, is_deleted: IsDeleted = deleted_flag, by_layer: bool = False, include_deleted: bool = False) -> DataFrame:
    """Records that a reader sees. The tombstone test runs on winners only: a dead winner hides older live records."""
    newest = layered(log, key) if by_layer else last_write_wins(log, key)
    return newest if include_deleted else newest.where(~is_deleted(newest))


def of_layers(log: DataFrame, layers: list[int]) -> DataFrame:
    return log.where(F.col(LAYER).isin(layers))
