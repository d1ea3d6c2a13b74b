"""Near-duplicates by the exact similarity of word shingle sets.

Two texts are linked if their sets of ``WIDTH``-word shingles have a Jaccard similarity of ``SIMILARITY`` at least; every link is
checked on the sets themselves. Texts of equal sets are one node. Candidates come first from operator 9: SimHash fingerprints of
the distinct ``PAIR``-word shingles that differ in at most ``DISTANCE`` bits, by its inverted index of byte positions and its
tallies. Such fingerprints miss some pairs of similarity 0.8, so that the parts which they leave unjoined are sought in bands of
``ROWS`` minimum hashes: of ``BANDS`` bands at least one agrees with probability ``1 - (1 - s ** ROWS) ** BANDS`` at similarity
``s``, 0.99993 at 0.8. Of each list of a band the node that meets the most others, counted in all its lists, is held against
the rest first: it is near the middle of its group and joins most of it. Then what is left is dealt at random into groups of
``GROUP``, twice, and one node of each group is held against the rest of it; then, in each round, some of the nodes that are not in
the list's largest part yet are held against all others, until none is left that has not been held against all outside its own
part. So a list of copies costs its length and not its square, and no pair of unjoined parts is left out. Nor do nodes that are
like a large group, but not enough to be linked, meet all of it: of nodes that are in lists above ``LONG`` after the first of these
rounds, an element of at most ``RARE`` sets is rare. Two similar sets that share a rare one share the rarest that they share, which
is among the rarest fifth of both, and meet there. Two that share none share common ones only, ``s (n + m) / (1 + s)`` of these at
least; a bitmap of the common ones of each shows how many of them the other lacks at least, and the rounds leave out the pairs that
cannot share enough. Lists are grouped by sums, minima and maxima only, which are made before the shuffle, so no task holds a whole
list. Pairs of which fewer than ``AGREE`` of the minimum hashes agree go before sets are fetched: at similarity 0.8 that happens to
one pair in six million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm import simhash
from tidelog.llm.common import discard, stored, texts_of
from tidelog.llm.components import components

WIDTH, SIMILARITY = 5, 0.8
#: Words of a shingle of the fingerprints, and bits in which candidates may differ.
PAIR, DISTANCE = 2, 4
ROWS, BANDS = 5, 24
#: Rows up to which a table of row numbers is broadcast; beyond it it is shuffled.
BROADCAST_ROWS = 500_000
#: Nodes of one group of the first round; minimum hashes that agree in every pair worth a look.
GROUP, AGREE = 8, 74
#: How many times as many nodes of a list are held against the others in each round as in the one before.
MORE = 16
#: Nodes of a list beyond which their elements are weighed; sets that have a rare element at most; slots of the table of counts.
LONG, RARE, SLOTS = 16, 64, 1 << 22
#: Two sets have at most so many elements together as ``REACH`` times those that similar ones share.
REACH = (1 + SIMILARITY) / SIMILARITY
#: Longs of the bitmap of a node's common elements.
LONGS = 8
_MIX = np.random.default_rng(5).integers(0, 1 << 32, (2, ROWS * BANDS), dtype=np.uint32)
_MIX[0] |= 1


def shingle_set(text: bytes) -> np.ndarray:
    """Distinct XXH64 values of the word shingles of a text, sorted; words as in ``simhash.fingerprint``. Empty without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= WIDTH:
        return np.array([xxhash.xxh64_intdigest(joined)], dtype=np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    n = len(words) - WIDTH + 1
    spans = zip((end - size)[:n].tolist(), end[WIDTH - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in spans), dtype=np.uint64, count=n))


def band_keys(shingles: np.ndarray) -> tuple[list[int], bytes]:
    """A key for each band of minimum hashes, as signed 64-bit integers, and the last byte of each hash; none for an empty set."""
    if not len(shingles):
        return [], b""
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(high), 1024):
        least = np.minimum(least, ((high[at : at + 1024, None] ^ _MIX[1]) * _MIX[0]).min(axis=0))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist(), least.astype(np.uint8).tobytes()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes, fps, keys, sketches = [], [], [], [], []
        for text in texts_of(batch):
            s = shingle_set(text)
            nodes.append(xxhash.xxh64_intdigest(s.tobytes()))
            sizes.append(len(s))
            fps.append(simhash.fingerprint(text, PAIR, distinct=True))
            own, sketch = band_keys(s)
            keys.append(own)
            sketches.append(np.frombuffer(sketch, dtype=np.int8))
        node, fp = (pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (nodes, fps))
        yield pa.RecordBatch.from_arrays([batch.column(0), node, pa.array(sizes, pa.int32()), fp, pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int8()))], names=["row", "node", "n", "fp", "keys", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            made = [shingle_set(t).view(np.int64) for t in texts_of(part)]
            ends = pa.array(np.r_[0, np.cumsum([len(s) for s in made])], pa.int32())
            sets = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(made)))
            yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["node", "set"])


def _slots_of(size: int):
    """Rows ``(slot, many)``: how many elements of a batch's sets fall into each of ``size`` slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                elements = batch.column(0).slice(at, 1024).flatten().to_numpy(zero_copy_only=False)
                slot, many = np.unique(elements & (size - 1), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(many, pa.int64())], names=["slot", "many"])

    return run


def _weights_by(sent):
    """Rows ``(node, n, common, bits, rare)``: how many elements are not rare, a bitmap of these, and the rare ones of the rarest
    fifth and one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common, bits, rare = [], [], []
            sizes = [len(x) for x in batch.column("set")]
            for x, n in zip(batch.column("set"), sizes, strict=True):
                s = x.values.to_numpy(zero_copy_only=False)
                many = sent.value[s & (len(sent.value) - 1)]
                common.append(int((many > RARE).sum()))
                bit = np.zeros(64 * LONGS, dtype=bool)
                bit[(s[many > RARE] >> 32) & (64 * LONGS - 1)] = True
                bits.append(np.packbits(bit).view(np.int64))
                first = np.lexsort((s, many))[: int((1 - SIMILARITY) * n + 1e-6) + 1]
                rare.append(s[first][(many[first] > 1) & (many[first] <= RARE)])
            columns = [batch.column("node"), pa.array(sizes, pa.int32()), pa.array(common, pa.int32()), pa.array(bits, pa.list_(pa.int64())), pa.array(rare, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "common", "bits", "rare"])

    return run


def _weights(crowd: DataFrame, sets: DataFrame) -> DataFrame:
    """The nodes of ``crowd(node)`` with their rare elements. Sets that have an element are counted by slots, of which
    elements may share one: a rare element may count as common, which costs pairs and loses none."""
    own = stored(sets.join(bounded(crowd), "node").select("node", "set"), "near-crowd")
    elements = own.agg(F.sum(F.size("set").cast("long"))).first()[0] or 0
    size = min(SLOTS, 1 << (4 * elements + 1).bit_length())
    counts = own.select("set").mapInArrow(_slots_of(size), "slot long, many long").groupBy("slot").agg(F.sum("many").alias("many")).where("many > 1").toArrow()  # SLOTS rows at most
    table = np.ones(size, dtype=np.uint8)
    table[counts["slot"].to_numpy()] = np.minimum(counts["many"].to_numpy(), 255)
    sent = own.sparkSession.sparkContext.broadcast(table)
    out = stored(own.mapInArrow(_weights_by(sent), "node long, n int, common int, bits array<long>, rare array<long>"), "near-weights")
    sent.unpersist()
    discard(own)
    return out


def bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Candidates ``(a, b)`` that connect ``nodes(node, fp)`` as all pairs do in which at most ``DISTANCE`` bits differ."""
    heads = stored(nodes.groupBy("fp").agg(F.min("node").alias("node")), "near-heads")
    links = simhash.fingerprint_links(heads.select("node", F.array("fp").alias("fps")), distance=DISTANCE)
    equal = nodes.join(heads.select("fp", F.col("node").alias("a")), "fp").where("a <> node").select("a", F.col("node").alias("b"))
    return links.union(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _alike(pairs: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose sets are similar enough; sets are fetched for pairs whose sketches are."""

    def with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        out = pairs.join(table.select(F.col("node").alias("b"), F.col(value).alias("y")), "b")
        return out.join(table.select(F.col("node").alias("a"), F.col(value).alias("x")), "a")

    agree = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    likely = stored(with_both(pairs, sketches, "sketch").where(agree >= AGREE).select("a", "b"), "near-likely")
    both = F.size(F.array_intersect("x", "y"))
    found = with_both(likely, sets, "set").where(both / (F.size("x") + F.size("y") - both) >= SIMILARITY).select("a", "b")
    return stored(found, "near-links")


def _lacking(x: str, y: str) -> Column:
    """How many bits of the bitmap ``x`` are not in ``y``: so many elements at least are not in the other set."""
    return sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(1, LONGS)), F.bit_count(F.col(x)[0].bitwiseAND(F.bitwise_not(F.col(y)[0]))))


def _central(lists: DataFrame) -> DataFrame:
    """``(key, a, m, root_a)``: of each list the node that meets the most others, counted in all of its lists."""
    met = lists.groupBy("node").agg(F.sum("many").alias("met"))
    first = lists.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node", "n", "root")).alias("p"))
    return first.select("key", F.col("p.node").alias("a"), F.col("p.n").alias("m"), F.col("p.root").alias("root_a"))


def _dealt(lists: DataFrame) -> DataFrame:
    """Pairs with their sizes, parts and common elements of one node of each random group of a list and the rest of the group."""
    groups = F.ceil(F.col("many") / GROUP)
    deals = F.array(*(F.struct(F.lit(i).alias("deal"), F.pmod(F.xxhash64("node", "key", F.lit(i)), groups).alias("group")) for i in (1, 2)))
    dealt = lists.select("key", F.col("node").alias("b"), "n", F.col("root").alias("root_b"), F.col("common").alias("common_b"), F.col("bits").alias("bits_b"), F.explode(deals).alias("g"))
    dealt = dealt.select("key", "b", "n", "root_b", "common_b", "bits_b", "g.deal", "g.group")
    firsts = dealt.groupBy("key", "deal", "group").agg(F.min(F.struct("b", "n", "root_b", "common_b", "bits_b")).alias("p"))
    firsts = firsts.select("key", "deal", "group", F.col("p.b").alias("a"), F.col("p.n").alias("m"), F.col("p.root_b").alias("root_a"), F.col("p.common_b").alias("common_a"), F.col("p.bits_b").alias("bits_a"))
    return firsts.join(dealt, ["key", "deal", "group"])


def _links(lists: DataFrame, pairs: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame | None:
    """``(node, root)`` of the nodes that are linked to another one; None if none is. ``pairs`` are looked at first."""
    sized = F.least("m", "n") >= F.lit(SIMILARITY) * F.greatest("m", "n") - 1e-6
    apart = F.col("root_a") != F.col("root_b")
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    unknown = F.col("common_a").isNull() | F.col("common_b").isNull()
    shared = F.least(F.col("common_a") - _lacking("bits_a", "bits_b"), F.col("common_b") - _lacking("bits_b", "bits_a"))  # at most
    fits = unknown | (shared * REACH + 1e-6 >= F.col("m") + F.col("n"))
    done = lists.sparkSession.createDataFrame([], "key long, node long")
    lists = lists.withColumn("common", F.lit(None).cast("int")).withColumn("bits", F.lit(None).cast("array<long>"))  # unknown: nothing is left out
    parts, links, weights, buckets = None, None, None, None
    while True:
        found = _alike(pairs, sketches, sets)
        discard(pairs)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            parts = components(links)
        rooted = lists.select("key", "node", "n", "common", "bits").withColumn("root", F.col("node"))
        if parts is not None:
            rooted = lists.select("key", "node", "n", "common", "bits").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("size"))
        main = sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"), F.count("*").alias("parts"), F.sum("size").alias("many")).where("parts > 1")
        lists = stored(rooted.join(main.select("key", F.col("top.root").alias("main"), "many"), "key"), "near-open")  # lists of several parts
        others = lists.select("key", F.col("node").alias("b"), "n", F.col("root").alias("root_b"), F.col("common").alias("common_b"), F.col("bits").alias("bits_b"))
        if buckets is None:
            buckets = 0
            centres = stored(_central(lists), "near-centres")
            pairs = stored(bounded(centres).join(others, "key").where(apart & sized).select(*ends).distinct(), "near-pairs")
            continue
        if buckets == 0:
            buckets = 1
            crowd = stored(lists.where(F.col("many") > LONG).select("node").distinct(), "near-crowded")
            if not crowd.isEmpty():
                weights = _weights(crowd, sets)
                lists = stored(lists.drop("common", "bits").join(weights.select("node", "common", "bits"), "node", "left"), "near-weighed")
            pairs = stored(_dealt(lists).where(apart & sized & fits).select(*ends).distinct(), "near-pairs")
            continue
        meet = None
        if buckets == 1 and weights is not None:
            rare = weights.join(lists.select("node", "root").distinct(), "node").select("node", "n", "root", F.explode("rare").alias("element"))
            left = rare.select("element", F.col("node").alias("a"), F.col("n").alias("m"), F.col("root").alias("root_a"))
            right = rare.select("element", F.col("node").alias("b"), "n", F.col("root").alias("root_b"))
            meet = left.join(right, "element").where("a < b").where(apart & sized).select("a", "b")
        buckets *= MORE
        # of a list whose nodes are all weighed, those that no other one's size fits are held against none
        lows = lists.groupBy("key").agg(F.min(F.when(F.col("common").isNull(), -1).when(F.col("common") >= SIMILARITY * F.col("n") - 1e-6, F.col("n"))).alias("low"))
        rest = lists.where("root <> main").join(done, ["key", "node"], "left_anti").join(lows, "key")
        rest = rest.where((F.col("low") < 0) | (F.col("common") * REACH + 1e-6 >= F.col("n") + F.greatest(SIMILARITY * F.col("n"), "low")))
        drawn = rest.groupBy("key", F.pmod(F.xxhash64("node", F.lit(buckets)), F.lit(buckets)).alias("bucket")).agg(F.min(F.struct("node", "n", "root", "common", "bits")).alias("p"))
        pivots = stored(drawn.select("key", F.col("p.node").alias("a"), F.col("p.n").alias("m"), F.col("p.root").alias("root_a"), F.col("p.common").alias("common_a"), F.col("p.bits").alias("bits_a")), "near-pivots")
        if meet is None and pivots.isEmpty():
            return parts
        done = done.union(pivots.select("key", F.col("a").alias("node")))
        pairs = bounded(pivots).join(others, "key").where(apart & sized & fits).select(*ends)
        pairs = stored((pairs if meet is None else pairs.union(meet)).distinct(), "near-pairs")


def band_lists(own: DataFrame) -> DataFrame:
    """``(key, node, n, row)``: the nodes of ``own(node, n, row, keys)`` under each key that several of them have."""
    lists = stored(own.select("node", "n", "row", F.explode("keys").alias("key")), "near-bands")
    several = lists.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key")
    return stored(lists.join(several, "key"), "near-candidates")


def surplus(rows: DataFrame, *, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row)``: the rows that are near-duplicates of a row that stays. ``rows`` is a stored table with a row number.

    Of each component of links the row of the smallest id stays, rows without an id coming last; of equal ids the first row.
    Texts without words are equal. Texts are read twice, the second time those of candidates only, and shuffled only where
    more than ``BROADCAST_ROWS`` are candidates; the shingle sets of candidates are shuffled.
    """
    texts = rows.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_signatures, "row long, node long, n int, fp long, keys array<long>, sketch array<tinyint>"), "near-signatures")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("row"))
    ids = rows.select(F.col(row_col).alias("row"), F.col(id_col).alias(id_col))
    named = signed.select("row", "node").join(ids, "row").groupBy("node").agg(F.min(order).alias("least"))
    named = stored(named, "near-nodes")
    # one row of each node
    own = signed.join(named.select(F.col("least.row").alias("row")), "row")
    heads = stored(own.select("node", "row", "fp"), "near-fingerprints")
    pairs = stored(simhash_pairs(heads), "near-pairs")
    lists = band_lists(own)
    reached = heads.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("node", "row")
    wanted = stored(lists.select("node", "row").union(reached).distinct(), "near-wanted")
    sketches = stored(signed.join(bounded(wanted.select("row")), "row").select("node", "sketch"), "near-sketches")
    sets = texts.join(bounded(wanted), "row").select("node", "text")
    sets = stored(sets.mapInArrow(_sets, "node long, set array<long>"), "near-sets")
    parts = _links(lists, pairs, sketches, sets)
    if parts is None:
        stay = named.select("node", F.col("least.row").alias("stay"))
    else:
        rooted = stored(named.join(parts, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "near-roots")
        best = rooted.groupBy("root").agg(F.min("least").alias("least")).select("root", F.col("least.row").alias("stay"))
        stay = rooted.select("node", "root").join(best, "root").select("node", "stay")
    return stored(signed.select("row", "node").join(stay, "node").where("row <> stay").select("row"), "near-surplus")
