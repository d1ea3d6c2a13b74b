"""Packing token sequences of documents into as few training sequences as possible: large-item matching, then best fit.

Lengths are whole numbers up to the capacity, so the plan needs only how many pieces there are of each length: at most
``capacity`` counts reach the driver, whatever the corpus. Pieces above a third of the capacity share a sequence with one
other of their kind at most and are paired greedily, the largest with the largest that still fits; smaller pieces, largest
first, go where the least room is left over. Both run on whole groups of equal sequences at once. Pieces learn their place
from their length and their rank among the pieces of that length, which is counted in salted buckets.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import emit, stored, texts_of
from tidelog.llm.tokens import id_bytes

#: Pieces of one length that are ranked together.
BUCKET = 2000


@dataclass
class Plan:
    """Where pieces go: those of ``length`` with ranks from ``rank`` on, ``per`` to a sequence, into sequences from ``to`` on, at ``offset``."""

    capacity: int
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0

    def arrays(self) -> tuple[np.ndarray, ...]:
        table = np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 5)
        return tuple(table[:, i] for i in range(5))


def plan_packing(counts: dict[int, int], capacity: int) -> Plan:
    """Plan for ``counts`` pieces of each length in 1..capacity. Work grows with the capacity, not with the counts."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 1 <= n <= capacity for n in left):
        raise ValueError("lengths run from 1 to the capacity")
    plan, used = Plan(capacity), dict.fromkeys(left, 0)
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences (first, how many)
    heap: list[int] = []

    def place(length: int, total: int, per: int, first: int, offset: int) -> None:
        plan.rows.append((length, used[length], per, first, offset))
        used[length] += total
        left[length] -= total

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            rooms.setdefault(room, []).append((first, n))

    def fresh(n: int) -> int:
        plan.sequences += n
        return plan.sequences - n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for i, a in enumerate(large):
        fits = [b for b in large[i:] if a + b <= capacity]  # largest first
        while left[a]:
            b = next((b for b in fits if left[b] and (b != a or left[a] > 1)), None)
            if b is None:
                n = left[a]
                first = fresh(n)
                place(a, n, 1, first, 0)
                free(capacity - a, first, n)
            elif b == a:
                n = left[a] // 2
                first = fresh(n)
                place(a, n, 1, first, 0)
                place(a, n, 1, first, a)
                free(capacity - 2 * a, first, n)
            else:
                n = min(left[a], left[b])
                first = fresh(n)
                place(a, n, 1, first, 0)
                place(b, n, 1, first, a)
                free(capacity - a - b, first, n)
    heap = sorted(rooms)
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        too_small: list[int] = []
        while left[s]:
            while heap and (heap[0] < s or not rooms.get(heap[0])):
                room = heapq.heappop(heap)
                if rooms.get(room):
                    too_small.append(room)
            if heap:
                room = heap[0]
                first, n = rooms[room].pop()
            else:
                room = capacity
                per = capacity // s
                n = -(-left[s] // per)
                first = fresh(n)
            per = room // s
            whole = min(n, left[s] // per)
            if whole:
                place(s, whole * per, per, first, capacity - room)
                rest = room - per * s
                free(rest, first, whole)
                if rest:
                    heapq.heappush(heap, rest)
            first, n = first + whole, n - whole
            if n and left[s]:  # fewer than a sequence takes
                k = left[s]
                place(s, k, k, first, capacity - room)
                rest = room - k * s
                free(rest, first, 1)
                if rest:
                    heapq.heappush(heap, rest)
                first, n = first + 1, n - 1
            if n:
                free(room, first, n)
                heapq.heappush(heap, room)
        for room in too_small:
            heapq.heappush(heap, room)
    return plan




def cut(docs: DataFrame, *, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc, piece, start, length, crc)``: each text's ids and ``end_id``, cut only where they exceed the capacity."""
    fields = [("doc", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())]
    schema = pa.schema(fields)
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = id_bytes(vocabulary)

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                data = ids(text) + tail
                for i, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    yield doc, i, at // 4, len(part) // 4, zlib.crc32(part)

        for batch in batches:
            yield from emit(rows(batch), schema)

    picked = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc long, piece int, start long, length long, crc long")


def pack(
    docs: DataFrame, *, vocabulary: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)``: a row per piece of a row's text.

    Null and empty texts are one piece of the end id alone. Null and repeated ids are kept, each row packed by itself;
    pieces that are equal in all columns are interchangeable. An empty table gives no rows. Other columns are not read.
    """
    pieces = stored(cut(docs, vocabulary=vocabulary, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = plan_packing(counts, capacity)
    spark = docs.sparkSession
    sizes = spark.createDataFrame([(n, -(-c // BUCKET)) for n, c in counts.items()], "length long, buckets long")
    salted = pieces.join(F.broadcast(sizes), "length").withColumn("bucket", F.expr("pmod(xxhash64(doc, piece, crc), buckets)")).drop("buckets")
    per = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = per.select("length", "bucket", (F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inner = W.partitionBy("length", "bucket").orderBy("doc", "piece", "start", "crc")
    ranked = salted.withColumn("rank", F.row_number().over(inner)).join(before, ["length", "bucket"])
    ranked = ranked.select("doc", "piece", "start", "length", "crc", (F.col("before") + F.col("rank") - 1).alias("rank"))
    arrays = spark.sparkContext.broadcast(plan.arrays())  # bounded by the capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, per_sequence, to, offset = arrays.value
        wide = np.int64(1) << 51
        starts = length * wide + rank
        for batch in batches:
            n, r = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(starts, n * wide + r, side="right") - 1
            past = r - rank[at]
            sequence, place = to[at] + past // per_sequence[at], offset[at] + past % per_sequence[at] * n
            cols = [*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(place)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "piece", "start", "length", "crc", "sequence_id", "offset"])

    out = ranked.mapInArrow(run, "doc long, piece int, start long, length long, crc long, sequence_id long, offset long")
    return out.select(F.col("doc").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
