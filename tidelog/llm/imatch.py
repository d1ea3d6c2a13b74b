"""I-Match document fingerprints: hashes of a document's mid-frequency terms under several randomised lexicons.

The lexicon is the terms whose inverse document frequency lies in a band. The band's upper end is a share of all documents,
so the lexicon's size is bounded whatever the corpus: documents with ``t`` distinct terms on average hold at most
``t / share`` terms that so many documents have. A document's fingerprint is one hash for each of ``subsets`` random parts
of the lexicon, of its terms in that part, distinct and sorted. Parts come in several sizes, so that documents with few and
with many terms, and close and distant pairs, are told apart.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Recent, emit, stored, texts_of

#: Distinct terms that one task counts before it hands the counts on.
FLUSH = 500_000
#: Terms that a worker remembers the hash of; see ``Recent``.
REMEMBERED = 100_000
#: Documents of one bucket in the order of ids, about, and buckets at most.
BUCKET, BUCKETS = 2000, 20_000
#: Bytes that a part of a fingerprint takes, and a part without terms.
WIDTH = 3
EMPTY = bytes(WIDTH)
#: Shares of the lexicon that its random parts hold, in turn.
SIZES = (1.0, 1 / 4, 1 / 16, 1 / 64, 1 / 64, 1 / 256, 1 / 256, 1 / 256)


@dataclass(frozen=True)
class Lexicon:
    """Sorted hashes of the terms in the band, and the numbers that draw its parts."""

    terms: np.ndarray
    subsets: int
    sizes: tuple[float, ...]

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        odd = np.array([xxhash.xxh64_intdigest(b"part", i) | 1 for i in range(self.subsets)], dtype=np.uint64)
        share = np.array([self.sizes[i % len(self.sizes)] for i in range(self.subsets)])
        return odd, (share * 2.0**32).astype(np.uint64)


def terms_of(text: bytes) -> set[bytes]:
    return set(text.lower().split())


def build_lexicon(
    docs: DataFrame, *, rarest: float = 0.0002, commonest: float = 0.05, subsets: int = 64, sizes: tuple[float, ...] = SIZES, text_col: str = "text", most: int = 20_000_000
) -> Lexicon:
    """Terms that at least ``rarest`` and at most ``commonest`` of all documents have, counted over all of them.

    The idf band is ``[-ln commonest, -ln rarest]``. At least 2 documents must have a term, and in small corpora 10 may. ``most`` is
    checked before the lexicon is sent to the executors; the bound above keeps it below.
    """
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter[bytes] = Counter()
        docs_seen = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h = np.array([xxhash.xxh64_intdigest(t) for t in tally], dtype=np.uint64).view(np.int64)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(list(tally.values()), pa.int64())], schema=schema)
            tally.clear()

        for batch in batches:
            for text in texts_of(batch):
                docs_seen += 1
                tally.update(terms_of(text))
                if len(tally) > FLUSH:
                    yield from flush()
        yield from flush()
        yield from emit([(None, docs_seen)], schema)  # the null term counts documents

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = stored(counts, "term-counts")
    total = counts.where("term is null").agg(F.sum("n")).first()[0] or 0
    low, high = max(2, math.ceil(rarest * total)), max(10, math.floor(commonest * total))
    band = counts.where(F.col("term").isNotNull() & F.col("n").between(low, high)).select("term")
    n = band.count()
    if n > most:
        raise ValueError(f"the lexicon has {n} terms; raise the least share of documents")
    terms = np.sort(np.array([r[0] for r in band.toLocalIterator()], dtype=np.int64).view(np.uint64)) if n else np.empty(0, np.uint64)
    return Lexicon(terms, subsets, sizes)


class Printer:
    """Fingerprints under one lexicon."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, (self.odd, self.share) = lexicon, lexicon.parts()
        self.seen = Recent(REMEMBERED)

    def hashes(self, terms: set[bytes]) -> np.ndarray:
        """Sorted hashes of those terms that the lexicon has."""
        new = self.seen.unknown(terms)
        seen = self.seen.young
        if new:
            h = np.array([xxhash.xxh64_intdigest(t) for t in new], dtype=np.uint64)
            if len(self.lexicon.terms):
                at = np.minimum(np.searchsorted(self.lexicon.terms, h), len(self.lexicon.terms) - 1)
                known = self.lexicon.terms[at] == h
            else:
                known = np.zeros(len(h), dtype=bool)
            seen.update(zip(new, np.where(known, h, 0).tolist(), strict=True))
        out = np.fromiter((seen[t] for t in terms), dtype=np.uint64, count=len(terms))
        return np.sort(out[out != 0])

    def fingerprint(self, text: bytes) -> bytes:
        """``WIDTH`` bytes for each part; a part without terms is zero. A text without any known term is hashed as a whole."""
        h = self.hashes(terms_of(text))
        if not len(h):
            return xxhash.xxh64_digest(text)
        mixed = (h[:, None] * self.odd) >> np.uint64(32)
        chosen = mixed < self.share
        out = []
        for i in range(len(self.odd)):
            part = h[chosen[:, i]]
            digest = xxhash.xxh32_digest(part.tobytes(), i)[:WIDTH] if len(part) else EMPTY
            out.append(digest if digest != EMPTY or not len(part) else EMPTY[1:] + b"\x01")
        return b"".join(out)


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal parts among those that either document has terms in; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    if len(a) % WIDTH == 0 and len(a) == len(b) > 8:
        parts = [(a[i : i + WIDTH], b[i : i + WIDTH]) for i in range(0, len(a), WIDTH)]
        either = [x == y for x, y in parts if x != EMPTY or y != EMPTY]
        return sum(either) / len(either)
    return 0.0  # one of them is the hash of a whole text


def with_next(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Rows ``(bucket, tail, doc, text)``, sorted within partitions: each bucket's rows by id, then, as its tail, a copy of the
    first row of the next bucket (of the first bucket for the last). One shuffle of the texts."""
    picked = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    ids = picked.select("doc")
    n = ids.count()
    k = max(1, min(BUCKETS, n // BUCKET))
    cuts = ids.select(F.percentile_approx("doc", [i / k for i in range(1, k)], max(10_000, 10 * k))).first()[0] if k > 1 else []
    cuts = sorted(set(cuts or []))
    place = F.lit(0)
    if cuts:
        table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")
        # the number of cuts below an id: binary search, as an expression
        place = F.when(F.col("doc").isNull(), 0).otherwise(_rank(table, len(cuts)))
    placed = picked.withColumn("bucket", place.cast("int"))
    firsts = ids.withColumn("bucket", place.cast("int")).groupBy("bucket").agg(F.min(F.struct(F.col("doc"))).alias("first"))
    rows = sorted((r["bucket"], r["first"]["doc"]) for r in firsts.collect())  # BUCKETS rows at most
    if not rows:
        return placed.withColumn("tail", F.lit(0)).select("bucket", "tail", "doc", "text")
    before = {b: rows[i - 1][0] for i, (b, _) in enumerate(rows)}  # the first bucket follows the last
    heads = docs.sparkSession.createDataFrame([(d, before[b]) for b, d in rows], "head long, target int")
    copies = placed.join(F.broadcast(heads), F.col("doc").eqNullSafe(F.col("head"))).select(F.col("target").alias("bucket"), F.lit(1).alias("tail"), "doc", "text")
    both = placed.select("bucket", F.lit(0).alias("tail"), "doc", "text").union(copies)
    return both.repartition("bucket").sortWithinPartitions("bucket", "tail", "doc", "text")


def _rank(table, n: int):
    low, high = F.lit(0), F.lit(n)
    state = F.struct(low.alias("a"), high.alias("b"))
    steps = F.sequence(F.lit(0), F.lit(max(1, n).bit_length()))

    def step(acc, _):
        mid = F.floor((acc["a"] + acc["b"]) / 2).cast("int")
        right = F.get(table, mid) < F.col("doc")
        halved = F.struct(F.when(right, mid + 1).otherwise(acc["a"]).alias("a"), F.when(right, acc["b"]).otherwise(mid).alias("b"))
        return F.when(acc["a"] < acc["b"], halved).otherwise(acc)

    return F.aggregate(steps, state, step, lambda acc: acc["a"])


def document_fingerprints(docs: DataFrame, *, lexicon: Lexicon | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)``, a row per input row, in hex. Equal texts have equal fingerprints; null text counts as empty."""
    lexicon = lexicon or build_lexicon(docs, text_col=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Printer(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([printer.fingerprint(t).hex() for t in texts_of(batch)])], names=["doc", "fingerprint"])

    picked = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"doc {picked.schema['doc'].dataType.simpleString()}, fingerprint string").withColumnRenamed("doc", id_col)


def edited(text: str, following: str) -> str:
    """The last half of the text, rounded down, replaced by as many letters from the start of the following text."""
    m = len(text) // 2
    return text[: len(text) - m] + following[:m]


def fingerprints_and_edits(docs: DataFrame, *, lexicon: Lexicon | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, a row per input row.

    The next document is that of the next row by id, then text; null ids come first; the last row's is the first (a single
    row's is itself). Null text counts as empty. An empty table gives no rows; other columns are not read.
    """
    lexicon = lexicon or build_lexicon(docs, text_col=text_col)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = [("doc", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    schema = pa.schema(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Printer(sent.value)

        def stream() -> Iterator[tuple[int, int, int | None, bytes]]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts_of(batch), strict=True)

        def rows() -> Iterator[tuple]:
            held = None
            for bucket, tail, doc, raw in stream():
                if held and held[0] == bucket and not held[1]:
                    text, next_print = raw.decode("utf-8", "replace"), printer.fingerprint(raw)
                    yield finish(held, text, next_print)
                    held = (bucket, tail, doc, text, next_print)
                elif tail:
                    held = (bucket, tail, doc, "", b"")
                else:
                    held = (bucket, tail, doc, raw.decode("utf-8", "replace"), printer.fingerprint(raw))

        def finish(own: tuple, following: str, next_print: bytes) -> tuple:
            _, _, doc, text, own_print = own
            new = edited(text, following).encode()
            new_print = printer.fingerprint(new)
            return doc, len(text), hashlib.sha256(new).hexdigest(), own_print.hex(), new_print.hex(), likeness(own_print, new_print), likeness(own_print, next_print)

        yield from emit(rows(), schema, 5000)

    out = with_next(docs, id_col=id_col, text_col=text_col).mapInArrow(
        run, "doc long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return out.withColumnRenamed("doc", id_col)
