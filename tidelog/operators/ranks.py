"""Places of rows in a total order, without a task that sees all rows.

Cut points are drawn from a sample in the order asked for and then fixed: a row's part is an expression of the row and the
cuts, so every pass over the rows has the same parts, whatever Spark does with its shuffles. A row's place is its rank in
its part and the size of the parts before, which is looked up by number: no row can be lost or counted twice.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.spec import SortKey, precedes

#: Rows of one part, about; parts at most; rows that are sampled for each part.
PART_ROWS, PARTS, PER_PART = 1_000_000, 10_000, 20
#: Rows of a part where only one place is sought.
NEAR_ROWS = 100_000


def unused(df: DataFrame, base: str) -> str:
    """A column name that ``df`` lacks."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def sorted_by(order: list[SortKey]) -> list[Column]:
    return [c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in order]


class Cuts:
    """Cut points of ``df`` in an order, and the number of the part in which a row lies."""

    def __init__(self, df: DataFrame, order: list[SortKey], *, parts: int | None = None, part_rows: int | None = None) -> None:
        self.up = [up for _, up in order]
        self.kinds = [f"k{i}" for i in range(len(order))]
        keys = df.select(*(c.alias(n) for n, (c, _) in zip(self.kinds, order, strict=True)))
        n = self.size = keys.count()
        parts = max(1, min(PARTS, n // (part_rows or PART_ROWS))) if parts is None else parts
        self.rows: list = []
        if parts > 1 and n:
            sample = keys.sample(min(1.0, 2 * PER_PART * parts / n), seed=7) if n > 2 * PER_PART * parts else keys
            own = [(F.col(k), up) for k, up in zip(self.kinds, self.up, strict=True)]
            drawn = sample.orderBy(*sorted_by(own)).collect()  # about 2 * PER_PART rows for each part
            self.rows = [drawn[len(drawn) * i // parts] for i in range(1, parts)] if drawn else []
        self.schema = keys.schema

    @classmethod
    def of(cls, values: list, kind: T.DataType) -> Cuts:
        """Given cut points of one ascending column."""
        cuts = cls.__new__(cls)
        cuts.up, cuts.kinds, cuts.rows = [True], ["k0"], [(v,) for v in values]
        cuts.schema = T.StructType([T.StructField("k0", kind)])
        return cuts

    @property
    def parts(self) -> int:
        return len(self.rows) + 1

    def numbered(self, df: DataFrame, order: list[SortKey], out: str) -> DataFrame:
        """``df`` with the number of each row's part, from 0: how many cuts are at or before it."""
        if not self.rows:
            return df.withColumn(out, F.lit(0))
        own = [c for c, _ in order]
        kind = self.schema[0].dataType
        if len(own) == 1 and kind in (T.LongType(), T.StringType()) and all(r[0] is not None for r in self.rows):
            # as a constant: a column of many cuts would be copied into each row
            table = F.from_json(F.lit(json.dumps([r[0] for r in self.rows])), f"array<{kind.simpleString()}>")
            return df.withColumn(out, self._sought(own, lambda i: [F.get(table, i)]))
        name = unused(df, "__cuts")
        one = df.sparkSession.createDataFrame(self.rows, self.schema).coalesce(1).select(F.struct(*self.kinds).alias("c"), F.monotonically_increasing_id().alias("i"))
        one = one.agg(F.sort_array(F.collect_list(F.struct("i", "c"))).alias("all")).select(F.transform("all", lambda x: x["c"]).alias(name))
        found = self._sought(own, lambda i: [F.get(F.col(name), i)[k] for k in self.kinds])
        return df.join(F.broadcast(one)).withColumn(out, found).drop(name)  # one row of cuts

    def _sought(self, own: list[Column], cut: Callable[[Column], list[Column]]) -> Column:
        """How many cuts are at or before the values ``own``: halving."""

        def step(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["a"] + acc["b"]) / 2).cast("int")
            after = precedes(list(zip(own, cut(mid), self.up, strict=True)))
            halved = F.struct(F.when(after, acc["a"]).otherwise(mid + 1).alias("a"), F.when(after, mid).otherwise(acc["b"]).alias("b"))
            return F.when(acc["a"] < acc["b"], halved).otherwise(acc)

        start = F.struct(F.lit(0).alias("a"), F.lit(len(self.rows)).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(self.rows).bit_length())), start, step, lambda acc: acc["a"])


def with_places(df: DataFrame, order: list[SortKey], *, start: int = 0, out: str) -> DataFrame:
    """``df`` with each row's place in the order as ``out``, dense from ``start``. Rows that are equal in all columns are
    interchangeable; other ties are broken by a hash of the row. ``df`` must be the same each time it is read."""
    order = _total(df, order)
    part, before = unused(df, "__part"), unused(df, "__before")
    cuts = Cuts(df, order)
    placed = cuts.numbered(df, order, part)
    sizes = {r[part]: r["n"] for r in placed.groupBy(part).agg(F.count("*").alias("n")).collect()} if cuts.parts > 1 else {}  # a row for each part
    sums, total = [], start
    for i in range(cuts.parts):
        sums.append(total)
        total += sizes.get(i, 0)
    table = F.from_json(F.lit(str(sums)), "array<bigint>") if len(sums) > 1 else F.array(F.lit(start).cast("long"))
    rank = F.row_number().over(W.partitionBy(part).orderBy(*sorted_by(order)))
    return placed.withColumn(before, F.get(table, F.col(part))).withColumn(out, (F.col(before) + rank - 1).cast("long")).drop(part, before)


def from_place(df: DataFrame, order: list[SortKey], n: int) -> DataFrame:
    """Rows of ``df`` from place ``n`` of ``with_places`` on. Of the cuts two around the place are taken, and the rows before them
    counted; only those between them are ranked, those behind them stay. ``df`` must be the same each time it is read."""
    if n <= 0:
        return df
    total = _total(df, order)
    cuts = Cuts(df, total, part_rows=NEAR_ROWS)
    if n >= cuts.size:
        return df.where(F.lit(False))
    at, wide = n * cuts.parts // cuts.size, 1
    while True:
        ends = [cuts.rows[i] if 0 <= i < len(cuts.rows) else None for i in (at - 1 - wide, at + wide)]
        where, placed = _between(df, total, cuts, ends)
        sizes = {r[where]: r["n"] for r in placed.groupBy(where).agg(F.count("*").alias("n")).collect()}  # three rows
        before = sizes.get(0, 0)
        if before <= n < before + sizes.get(1, 0) or ends == [None, None]:
            break
        wide *= 4  # the sample was off
    rank = unused(placed, "__rank")
    here = placed.where(F.col(where) == 1).withColumn(rank, F.row_number().over(W.partitionBy(where).orderBy(*sorted_by(total))))
    here = here.where(F.col(rank) > n - before).drop(rank)
    return here.unionByName(placed.where(F.col(where) == 2)).drop(where)


def _between(df: DataFrame, order: list[SortKey], cuts: Cuts, ends: list) -> tuple[str, DataFrame]:
    """``df`` with a column, whose name comes first, that is 0 before the first end, 1 from it on, 2 from the second on; an end may lack."""
    out, place, fields, values = unused(df, "__where"), F.lit(1), [], []
    for e, row in enumerate(ends):
        if row is None:
            continue
        names = [unused(df, f"__end{e}{k}") for k in cuts.kinds]
        fields += [T.StructField(name, f.dataType) for name, f in zip(names, cuts.schema.fields, strict=True)]
        values += list(row)
        before = precedes([(c, F.col(name), up) for (c, up), name in zip(order, names, strict=True)])
        place = F.when(before, 0).otherwise(place) if e == 0 else F.when(~before, 2).otherwise(place)
    if not fields:
        return out, df.withColumn(out, place)
    one = df.sparkSession.createDataFrame([tuple(values)], T.StructType(fields))
    return out, df.join(F.broadcast(one)).withColumn(out, place).drop(*one.columns)  # one row


def _total(df: DataFrame, order: list[SortKey]) -> list[SortKey]:
    """An order with ties broken by a hash of the row."""
    tie = [c for c in df.columns if not _unhashable(df.schema[c].dataType)]
    return [*order, (F.xxhash64(*(F.col(f"`{c}`") for c in tie)) if tie else F.lit(0).cast("long"), True)]


def _unhashable(kind: object) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()
