"""Reads of a visible view: points, seeks, ranges, prefixes, ordinals, counts and boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.ranks import Cuts, from_place, unused, with_places
from tidelog.spec import DELETED, LAYER, OP, KeyColumn, KeySpec

#: Keys of one band of an as-of join; see ``floor_join``.
BAND_ROWS = 100_000
#: Keys of a lookup that are broadcast at most; more are shuffled.
BROADCAST_KEYS = 1_000_000


def scan(view: DataFrame, key: KeySpec, *, reverse: bool = False) -> DataFrame:
    return view.orderBy(*key.order(reverse))


def seek(view: DataFrame, key: KeySpec, values: Sequence, *, reverse: bool = False) -> DataFrame:
    """From the first key at or after ``values`` on, or backwards from the last at or before it."""
    return scan(view.where(key.compare(values, op="<=" if reverse else ">=")), key, reverse=reverse)


def after(view: DataFrame, key: KeySpec, values: Sequence, *, reverse: bool = False) -> DataFrame:
    """Go on behind a key already read: how a refreshed scan keeps its position."""
    return scan(view.where(key.compare(values, op="<" if reverse else ">")), key, reverse=reverse)


def first(view: DataFrame, key: KeySpec, n: int = 1, *, reverse: bool = False) -> DataFrame:
    """The first or last ``n`` rows: a top-k, no total sort."""
    return scan(view, key, reverse=reverse).limit(n)


def skip(view: DataFrame, key: KeySpec, n: int) -> DataFrame:
    """All but the first ``n`` rows: an offset by itself would bring all rows into one task. Ties are those of ``ordinals``."""
    return scan(from_place(view, key.sort_keys(), n), key)


def between(view: DataFrame, key: KeySpec, low: Sequence | None = None, high: Sequence | None = None) -> DataFrame:
    """Keys in ``[low, high)``."""
    if low is not None:
        view = view.where(key.compare(low, op=">="))
    if high is not None:
        view = view.where(key.compare(high, op="<"))
    return view


def successor(prefix: str) -> str | None:
    """The least string above all strings with the prefix; None if there is none."""
    for i in reversed(range(len(prefix))):
        c = ord(prefix[i]) + 1
        if c == 0xD800:
            c = 0xE000
        if c <= 0x10FFFF:
            return prefix[:i] + chr(c)
    return None


def with_prefix(view: DataFrame, column: str, prefix: str) -> DataFrame:
    """A prefix as a range, which row-group statistics can prune."""
    high = successor(prefix)
    found = view.where(F.col(column) >= prefix)
    return found.where(F.col(column) < high) if high is not None else found


def only_keys(log: DataFrame, keys: DataFrame, key: KeySpec, *, rows: int | None = None) -> DataFrame:
    """The records of some keys: what a lookup of few keys should aggregate. Keys are broadcast up to a checked number."""
    wanted = keys.select(*key.names).distinct()
    n = wanted.count() if rows is None else rows
    on = [log[k].eqNullSafe(wanted[k]) for k in key.names]
    return log.join(F.broadcast(wanted) if n <= BROADCAST_KEYS else wanted, on, "left_semi")


def contains(view: DataFrame, keys: DataFrame, key: KeySpec) -> DataFrame:
    return keys.join(view.select(*key.names), key.names, "left_semi")


def missing(view: DataFrame, keys: DataFrame, key: KeySpec) -> DataFrame:
    return keys.join(view.select(*key.names), key.names, "left_anti")


def multi_get(view: DataFrame, keys: DataFrame, key: KeySpec) -> DataFrame:
    """Values of many keys; a key that is not there has null values and ``found`` false. A value column whose name ``keys`` has
    too comes out as ``view_<name>``."""
    values = [c for c in view.columns if c not in (*key.names, OP, DELETED, LAYER)]
    mark = unused(keys, "__found")
    named = view.select(*key.names, *(F.col(c).alias(f"view_{c}" if c in keys.columns else c) for c in values), F.lit(True).alias(mark))
    return keys.join(named, key.names, "left").withColumn("found", F.coalesce(mark, F.lit(False))).drop(mark)


def one(view: DataFrame, key: KeySpec, values: Sequence) -> DataFrame:
    return view.where(key.compare(values, op="==")).limit(1)


def floor(view: DataFrame, key: KeySpec, values: Sequence) -> DataFrame:
    return seek(view, key, values, reverse=True).limit(1)


def ceiling(view: DataFrame, key: KeySpec, values: Sequence) -> DataFrame:
    return seek(view, key, values).limit(1)


def _as_of(keys: DataFrame, probes: DataFrame, key: KeyColumn, probe: str, up: bool, bands: int | None, out: str) -> DataFrame:
    """``probes`` and the greatest key at or before (``up`` false) or least at or after each probe value, in the key's order:
    distributed, without a range join.

    Values are cut into bands at fixed cuts of the keys. Within a band the answer is a running last key over keys and probes
    in order; where a band has no key yet, it is the nearest band's last (first) one, of which there is one row per band.
    """
    v, band, own = "__v", "__band", KeyColumn("__v", key.ascending, key.collation, key.nan_first, key.longer_first, key.utf16)
    kind = keys.schema[key.name].dataType
    k = keys.select(F.col(key.name).alias(v)).where(F.col(v).isNotNull()).distinct()
    p = probes.select(F.col(probe).cast(kind).alias(v)).where(F.col(v).isNotNull()).distinct()
    order = own.sort_keys()
    if bands is None:
        bands = max(1, min(10_000, k.count() // BAND_ROWS))
    cuts = Cuts(k, order, parts=bands)
    placed = cuts.numbered(k.withColumn("__k", F.lit(True)).unionByName(p.withColumn("__k", F.lit(False))), order, band)
    # running from the first to the last, or back; of equal values the key comes first
    way = [c.asc_nulls_first() if ascending != up else c.desc_nulls_last() for c, ascending in order]
    here = F.last(F.when(F.col("__k"), F.col(v)), ignorenulls=True).over(W.partitionBy(band).orderBy(*way, F.col("__k").desc()).rowsBetween(W.unboundedPreceding, 0))
    found = placed.withColumn("__here", here).where(~F.col("__k")).select(v, band, "__here")
    if cuts.parts > 1:
        last = W.partitionBy(band).orderBy(*([c.desc_nulls_last() if ascending != up else c.asc_nulls_first() for c, ascending in order]))
        ends = placed.where("__k").withColumn("__n", F.row_number().over(last)).where("__n = 1").select(band, v)
        rows = {r[band]: r[v] for r in ends.collect()}  # a row for each band
        carried, edge = [], None
        for b in reversed(range(cuts.parts)) if up else range(cuts.parts):
            carried.append((b, edge))
            edge = rows.get(b, edge)
        edges = keys.sparkSession.createDataFrame(carried, T.StructType([T.StructField(band, T.IntegerType()), T.StructField("__edge", kind)]))
        found = found.join(F.broadcast(edges), band).select(v, F.coalesce("__here", "__edge").alias("__here"))
    name, answer = unused(probes, "__probe"), unused(probes, "__answer")
    found = found.select(F.col(v).alias(name), F.col("__here").alias(answer))
    joined = probes.join(found, probes[probe].cast(kind) == F.col(name), "left").drop(name)
    return joined.select(*(F.col(f"`{c}`") for c in probes.columns if c != out), F.col(answer).alias(out))


def floor_join(view: DataFrame, probes: DataFrame, *, key: str | KeyColumn, probe: str, out: str = "floor_key", bands: int | None = None) -> DataFrame:
    """``probes`` with the last key of ``view`` at or before each probe in key order; null if there is none or the probe is null."""
    return _as_of(view, probes, KeyColumn(key) if isinstance(key, str) else key, probe, False, bands, out)


def ceiling_join(view: DataFrame, probes: DataFrame, *, key: str | KeyColumn, probe: str, out: str = "ceiling_key", bands: int | None = None) -> DataFrame:
    """``probes`` with the first key of ``view`` at or after each probe in key order; null if there is none or the probe is null."""
    return _as_of(view, probes, KeyColumn(key) if isinstance(key, str) else key, probe, True, bands, out)


def ordinals(view: DataFrame, key: KeySpec, *, out: str = "ordinal") -> DataFrame:
    """Each row's place in key order, from 0, dense."""
    return with_places(view, key.sort_keys(), out=out)


def sparse_index(view: DataFrame, key: KeySpec, step: int = 1024) -> DataFrame:
    """Every ``step``-th key, and the last one, with their ordinals."""
    placed = ordinals(view.select(*key.names), key)
    top = view.count() - 1
    return placed.where((F.col("ordinal") % step == 0) | (F.col("ordinal") == top))


def boundaries(view: DataFrame, part: Column, key: str, value: str | None = None) -> DataFrame:
    """First and last key, last value and size of every part."""
    aggs = [F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.count("*").alias("n_rows")]
    if value is not None:
        aggs.append(F.max_by(value, key).alias("last_value"))
    return view.groupBy(part.alias("part")).agg(*aggs)


def count_full_scan(view: DataFrame) -> DataFrame:
    return view.agg(F.count("*").alias("n"))


def count_fast(base: DataFrame, delta: DataFrame, key: KeySpec, *, base_rows: int | None = None) -> DataFrame:
    """Size of a tombstone-free base, known from its manifest or counted, adjusted by a delta's newest records.

    A live record of a key that the base lacks adds one, a tombstone of one that it has takes one away.
    """
    marked = delta.join(base.select(*key.names).withColumn("__in", F.lit(True)), key.names, "left")
    change = F.when(F.col(DELETED) & F.col("__in"), -1).when(~F.col(DELETED) & F.col("__in").isNull(), 1).otherwise(0)
    total = marked.agg(F.coalesce(F.sum(change), F.lit(0)).cast("long").alias("change"))
    size = base.count() if base_rows is None else base_rows
    return total.select((F.lit(size) + F.col("change")).alias("n"))


def physical_counts(log: DataFrame) -> DataFrame:
    """Records of each layer, duplicates and tombstones too."""
    return log.groupBy(F.col(LAYER).alias("layer")).agg(F.count("*").alias("n_records"), F.sum(F.col(DELETED).cast("long")).alias("n_tombstones"))


def max_op(log: DataFrame) -> DataFrame:
    return log.agg(F.max(OP).alias("max_op"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one view only, with the side that has them."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
