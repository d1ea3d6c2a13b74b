"""SimHash near-duplicates: byte-position inverted index with count filtering.

Fingerprints of 64 bits link when few bits differ. If at most ``d`` bits differ, at most ``d`` of the 8 bytes do, so the
pair shares at least ``8 - d`` positional bytes. The index therefore has a list for every choice of ``8 - d`` byte
positions and their values, so that no pair below the minimum meets in any. Where a pair meets, its shared positional bytes
are tallied: it is retained if the tally reaches the minimum and the list is the first of the ``C(tally, 8 - d)`` in which it
meets, so that each pair counts once. Several fingerprints of a text,
by seed, each have their own lists. Pairs of a list are
verified by their exact distance where the list lies, and only links that join parts of the list not yet joined leave it:
the output is linear in the list, never its square. A list longer than ``LIST`` is not compared pair by pair at all: the
fingerprints of a list differ in the other ``8 d`` bits alone, and two of them differ in at most ``d`` bits exactly if
some value lies within ``d / 2`` bits of both (rounded up and down for odd ``d``), so each is sent to all those values
and linked to the smallest one that meets it there.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import stored, texts_of
from tidelog.llm.components import components

#: Longest list whose pairs are compared directly (all of them); longer lists take the exact way by common neighbours.
LIST = 2048
#: A fingerprint is hot if one row in so many has it.
HOT = 1000
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, width: int = 4, seed: int = 42, distinct: bool = False) -> int:
    """SimHash of the word shingles of a text; 0 without words.

    Bytes A-Z are lower-cased, words are parted by ASCII white space, repeated shingles count again unless ``distinct``, fewer
    words than ``width`` are one shingle. A bit is set if it is in over half of the shingles' XXH64 values.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    spans = zip((end - size)[: len(words) - width + 1].tolist(), end[width - 1 :].tolist(), strict=True)
    shingles: Iterator[bytes] = (joined[a:b] for a, b in spans)
    if distinct:
        shingles = iter(dict.fromkeys(shingles))
    digest, n = xxhash.xxh64_intdigest, 0
    count = np.zeros(64, dtype=np.int64)
    while block := [digest(x, seed) for x in itertools.islice(shingles, BLOCK)]:
        h = np.array(block, dtype="<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(block)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, width: int = 4, seeds: tuple[int, ...] = (42,), distinct: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, fps)``: a fingerprint of each row for each seed, as signed 64-bit integers. Null text has no words."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, width, s, distinct) for t in texts_of(batch) for s in seeds], dtype=np.uint64).view(np.int64)
            flat = pa.array(fps)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(fps) + 1, len(seeds)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc", "fps"])

    return picked.mapInArrow(run, "doc long, fps array<long>")


def bits_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def tallies(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many positional bytes two fingerprints share, and which, as bits."""
    other = np.ascontiguousarray(a ^ b).view(np.uint8).reshape(-1, 8)
    same = np.packbits(other == 0, axis=1, bitorder="little")[:, 0]
    return np.bitwise_count(same), same


def _first_choice(least: int) -> np.ndarray:
    """For each set of shared bytes, as bits, the number of the first choice of ``least`` positions within it; -1 if it is too small."""
    choices = list(itertools.combinations(range(8), least))
    return np.array([next((i for i, c in enumerate(choices) if all(same >> p & 1 for p in c)), -1) for same in range(256)])


def _index(distance: int):
    """Rows ``(key, fp, node, choice)`` of the inverted index: a key for each choice of byte positions and their values."""
    choices = list(itertools.combinations(range(8), 8 - distance))
    masks = np.array([sum(0xFF << 8 * p for p in c) for c in choices], dtype=np.uint64)
    number = np.arange(len(choices), dtype=np.int8)
    # the choice is part of the key: choices of the same bytes' values get keys apart
    salts = np.array([xxhash.xxh64_intdigest(bytes(c)) for c in choices], dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            every = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(node), -1)
            for s in range(every.shape[1]):
                # fingerprints of different seeds are apart, and distances of one seed's as they were
                own = every[:, s] ^ np.uint64(0 if s == 0 else xxhash.xxh64_intdigest(b"seed", s))
                for at in range(0, len(own), 2000):
                    part = own[at : at + 2000]
                    key = ((part[:, None] & masks) ^ salts) * np.uint64(0x9E3779B97F4A7C15)
                    rows = [key.ravel().view(np.int64), np.repeat(part, len(masks)).view(np.int64), np.repeat(node[at : at + 2000], len(masks)), np.tile(number, len(part))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["key", "fp", "node", "choice"])

    return run


def _spanning(fp: np.ndarray, choice: int, first: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links of a list that join its parts, as places in it: every pair is tallied and verified, a link within a part already
    joined is left out."""
    part = np.arange(len(fp))
    out_a, out_b = [], []
    for i in range(len(fp) - 1):
        _, same = tallies(fp[i], fp[i + 1 :])
        near = np.flatnonzero((first[same] == choice) & (bits_between(fp[i], fp[i + 1 :]) <= distance)) + i + 1
        for j in near[np.unique(part[near], return_index=True)[1]]:
            if part[j] != part[i]:
                part[part == part[j]] = part[i]
                out_a.append(i)
                out_b.append(int(j))
    return out_a, out_b


def _lists(distance: int, longest: int):
    """Walk the sorted index and emit ``(kind, a, b)``: kind 0 links nodes a and b; kind 1 is node b, of fingerprint a, in a long
    list. No more than ``longest`` rows of a list are held: the rest of a longer one goes out as it comes."""
    first = _first_choice(8 - distance)

    def batch(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a.view(np.int64)), pa.array(b)], names=["kind", "a", "b"])

    def emit(key: np.ndarray, fp: np.ndarray, node: np.ndarray, choice: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole lists."""
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[cut, len(key)])
        two = cut[size == 2]
        _, same = tallies(fp[two], fp[two + 1])
        near = two[(first[same] == choice[two]) & (bits_between(fp[two], fp[two + 1]) <= distance)]
        lefts, rights = [node[near]], [node[near + 1]]
        for at, n in zip(cut[size > 2], size[size > 2], strict=True):
            own, names = fp[at : at + n], node[at : at + n]
            if n <= longest:
                a, b = _spanning(own, choice[at], first, distance)
                lefts.append(names[a])
                rights.append(names[b])
            else:
                yield batch(1, own, names)
        left = np.concatenate(lefts)
        if len(left):
            yield batch(0, left, np.concatenate(rights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        passing = None  # the key of a long list that goes out as it comes
        for part in batches:
            key, fp, node, choice = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if passing is not None:
                n = int(np.searchsorted(key, passing, side="right"))
                if n:
                    yield batch(1, fp[:n], node[:n])
                key, fp, node, choice = key[n:], fp[n:], node[n:], choice[n:]
            if not len(key):
                continue
            passing = None
            held.append((key, fp.view(np.uint64), node, choice))
            rows = tuple(map(np.concatenate, zip(*held, strict=True)))
            last = int(np.searchsorted(rows[0], rows[0][-1], side="left"))  # the last list may go on
            if last:
                yield from emit(*(x[:last] for x in rows))
            held = [tuple(x[last:] for x in rows)]
            if len(held[0][0]) > longest:
                passing = held[0][0][0]
                yield batch(1, held[0][1], held[0][2])
                held = []
        if held:
            yield from emit(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _balls(radius: int):
    """For fingerprints of long lists, all values within ``radius`` bits."""
    steps = [0] + [sum(1 << b for b in c) for r in range(1, radius + 1) for c in itertools.combinations(range(64), r)]
    moves = np.array(steps, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            node = batch.column(1).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 32):
                part = fp[at : at + 32]
                rows = [(part[:, None] ^ moves).ravel().view(np.int64), np.repeat(node[at : at + 32], len(moves))]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["key", "node"])

    return run


def fingerprint_links(nodes: DataFrame, *, distance: int = 4, longest: int = LIST) -> DataFrame:
    """Links ``(a, b)`` that connect ``nodes(node, fps)`` exactly as all pairs do in which fingerprints of one seed differ in at
    most ``distance`` bits."""
    if not 0 <= distance <= 7:
        raise ValueError("the byte-position index guarantees a shared byte for distances of 0 to 7 only")
    index = nodes.select("node", "fps").mapInArrow(_index(distance), "key long, fp long, node long, choice byte")
    lists = index.repartition("key").sortWithinPartitions("key", "fp", "node")
    made = stored(lists.mapInArrow(_lists(distance, longest), "kind int, a long, b long"), "simhash-links")
    links = made.where("kind = 0").select("a", "b")
    dense = made.where("kind = 1").select(F.col("a").alias("fp"), F.col("b").alias("node")).distinct()
    if dense.isEmpty():
        return links
    # a value within half of the distance, rounded down, of one and the rest of it of the other exists exactly if at most
    # `distance` bits differ; all that meet at a value are linked to the least that is within the smaller half
    wide = dense.mapInArrow(_balls((distance + 1) // 2), "key long, node long")
    core = wide if distance % 2 == 0 else dense.mapInArrow(_balls(distance // 2), "key long, node long")
    low = core.groupBy("key").agg(F.min("node").alias("a"))
    return links.union(wide.join(low, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct())


def near_duplicates(
    docs: DataFrame, *, width: int = 4, distance: int = 4, seeds: tuple[int, ...] = (42,), distinct: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row per input row: ``(id, fingerprint, component_id)``; the first seed's fingerprint as 16 lower-case hex digits.

    ``component_id`` is the smallest id reachable over links of at most ``distance`` bits under any seed, itself included.
    Rows with equal ids stay apart rows. A null id is nobody's smallest: its component takes the smallest other id, or null.
    Null and empty texts have fingerprint 0 and link like any other. Other columns are not read.
    """
    fps = stored(fingerprints(docs, width=width, seeds=seeds, distinct=distinct, id_col=id_col, text_col=text_col), "simhash")
    node = F.col("fps")[0] if len(seeds) == 1 else F.xxhash64("fps")
    fps = fps.withColumn("node", node)
    nodes = stored(fps.groupBy("node").agg(F.first("fps").alias("fps"), F.min("doc").alias("low"), F.count("*").alias("rows")), "simhash-nodes")
    linked = components(fingerprint_links(nodes, distance=distance))
    lows = linked.join(nodes.select("node", "low"), "node").groupBy("root").agg(F.min("low").alias("component_id"))
    grouped = linked.join(lows, "root").select("node", "component_id")
    of_node = stored(nodes.join(grouped, "node", "left").select("node", F.coalesce("component_id", "low").alias("component_id"), "rows"), "simhash-components")
    # fingerprints that a thousandth of all rows have, of which there are a thousand at most, meet their rows where these are
    hot = F.broadcast(of_node.where(F.col("rows") * HOT >= fps.count()).select("node", F.col("component_id").alias("hot_id"), F.lit(True).alias("hot")))
    both = fps.join(hot, "node", "left")
    rare = both.where("hot is null").join(of_node.select("node", "component_id"), "node").select("doc", "fps", "component_id")
    out = rare.union(both.where("hot").select("doc", "fps", F.col("hot_id").alias("component_id")))
    return out.select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")
