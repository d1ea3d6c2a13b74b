"""Language-model scoring: the marginal probability of a text over all its segmentations into subwords.

The vocabulary is that of a public tokenizer, as it is. Its scores weight the segmentations to begin with: they are merge
ranks, not log probabilities, so Zipf's law turns them into such. Piece probabilities are then fitted to the training rows by expectation over all segmentations of all their word types, weighted
by how often each occurs. A word's probability is a sum over the paths of its lattice, by forward recursion in log space; a
text's is the product over its words and its end. Letters that no piece covers go by their bytes.

Word types may be more than any machine holds. Those that make up at least ``1 / HEAD`` of all tokens, of which there can be
no more than ``HEAD``, are sent to the executors and looked up there; all other words meet their counts in a join, in which
no word can be hot for that very reason.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import OUT_ROWS, emit, stored, texts_of

HEAD = 100_000
FLUSH = 200_000
ROUNDS = 2
SPACE = "▁"
END = b""
TINY = 0.1
LN10 = math.log(10)
#: Letters above which a word goes through its lattice by itself, place by place; starts that are looked up at once there.
LONG, AT_ONCE = 400, 20_000


class Lattice:
    """Pieces with log probabilities, and the forward and backward recursions of many words at once.

    Words of about one length are the rows of an array of letters. For each number of letters, the pieces that start at each
    place are looked up by a rolling hash; the recursions then run over places, for all rows together, in log space.
    """

    _BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, pieces: dict[str, int], bytes_: list[int], log_p: np.ndarray) -> None:
        self.bytes, self.p = np.array(bytes_), np.asarray(log_p, dtype=float)
        names = [w for w in pieces if w]
        self.longest = max(map(len, names))
        hashes = np.empty(len(names), dtype=np.uint64)
        for i, w in enumerate(names):
            hashes[i] = self._hash(w)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array([pieces[w] for w in names])[order]
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self._slot(self.hashes)] = True

    @classmethod
    def _hash(cls, w: str) -> np.uint64:
        h = 0
        for c in w:
            h = (h * int(cls._BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return np.uint64(h)

    @classmethod
    def _slot(cls, h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * cls._MIX) >> np.uint64(44)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words])
        top = int(size.max())
        return np.array(words, dtype=f"U{top}").view(np.uint32).reshape(len(words), top).astype(np.uint64), size

    def _pieces(self, letters: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each length from 1, the ids of pieces by row and start, -1 for none, and their log probabilities."""
        ids, weights = [], []
        h = np.zeros_like(letters)
        for k in range(1, min(letters.shape[1], self.longest) + 1):
            h = h[:, : letters.shape[1] - k + 1] * self._BASE + letters[:, k - 1 :]
            found = np.full(h.shape, -1)
            near = np.nonzero(self.maybe[self._slot(h)])
            own = h[near]
            at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            found[near] = np.where(self.hashes[at] == own, self.ids[at], -1)
            w = np.where(found >= 0, self.p[found], -np.inf)
            if k == 1:
                for c in np.unique(letters[(found < 0) & (letters > 0)]).tolist():
                    w[letters == c] = self.p[self.bytes[list(chr(c).encode("utf-8", "replace"))]].sum()
            ids.append(found)
            weights.append(w)
        return ids, weights

    @staticmethod
    def _sum(terms: list[np.ndarray]) -> np.ndarray:
        if len(terms) == 1:
            return terms[0]
        x = np.stack(terms)
        top = x.max(0)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(x - safe).sum(0))

    def _forward(self, weights: list[np.ndarray], n: int, top: int) -> np.ndarray:
        """Log of the summed probability of all ways to reach each place."""
        a = np.full((n, top + 1), -np.inf)
        a[:, 0] = 0
        for j in range(1, top + 1):
            a[:, j] = self._sum([a[:, j - k] + weights[k - 1][:, j - k] for k in range(1, min(j, len(weights)) + 1)])
        return a

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Marginal log probability of each word."""
        out = np.zeros(len(words))
        words, long = _marked(words)
        for i in long:
            out[i] = self._places(self._edges(words[i]))[-1]
        for rows, parts in _alike(words, long):
            letters, size = self._letters(parts)
            _, weights = self._pieces(letters)
            a = self._forward(weights, *letters.shape)
            out[rows] = a[np.arange(len(parts)), size]
        return out

    def _edges(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lattice of one word of any length: start, end, piece (-1 for a letter that goes by its bytes) and log probability
        of each piece in it, by end. Some starts at a time, with as many letters more as a piece can have."""
        found: list[list[np.ndarray]] = [[], [], [], []]
        for low in range(0, len(word), AT_ONCE):
            letters, _ = self._letters([word[low : low + AT_ONCE + self.longest - 1]])
            ids, weights = self._pieces(letters)
            for k, (own, w) in enumerate(zip(ids, weights, strict=True), 1):
                at = np.flatnonzero(np.isfinite(w[0, :AT_ONCE]))
                for x, y in zip(found, (at + low, at + low + k, own[0, at], w[0, at]), strict=True):
                    x.append(y)
        start, end, piece, weight = (np.concatenate(x) for x in found)
        order = np.argsort(end, kind="stable")
        return start[order], end[order], piece[order], weight[order]

    @staticmethod
    def _places(edges: tuple) -> list[float]:
        """Log of the summed probability of all ways to reach each place of one word."""
        start, end, _, weight = edges
        n = int(end[-1])
        a = [0.0] + [-math.inf] * n
        cuts = np.searchsorted(end, np.arange(1, n + 2)).tolist()
        start, weight = start.tolist(), weight.tolist()
        for j in range(1, n + 1):
            terms = [a[start[i]] + weight[i] for i in range(cuts[j - 1], cuts[j])]
            top = max(terms, default=-math.inf)
            if top > -math.inf:
                a[j] = top + math.log(sum(math.exp(x - top) for x in terms))
        return a

    def _expect_long(self, word: str, times: float, into: np.ndarray) -> None:
        start, end, piece, weight = edges = self._edges(word)
        n = int(end[-1])
        a = np.array(self._places(edges))
        b = np.array(self._places(self._turned(edges, n)))[::-1]
        use = np.exp(a[start] + weight + b[end] - a[n]) * times
        known = piece >= 0
        into += np.bincount(piece[known], use[known], len(into))
        for i in np.flatnonzero(~known).tolist():
            np.add.at(into, self.bytes[list(word[start[i]].encode("utf-8", "replace"))], use[i])

    @staticmethod
    def _turned(edges: tuple, n: int) -> tuple:
        """The same lattice from its end."""
        start, end, piece, weight = edges
        order = np.argsort(n - start, kind="stable")
        return (n - end)[order], (n - start)[order], piece[order], weight[order]

    def log_prob(self, word: str) -> float:
        return float(self.log_probs([word])[0])

    def expect(self, words: list[str], times: np.ndarray, into: np.ndarray) -> None:
        """Add the expected uses of each piece in ``times`` occurrences of each word."""
        words, long = _marked(words)
        for i in long:
            self._expect_long(words[i], float(times[i]), into)
        for rows, parts in _alike(words, long):
            letters, size = self._letters(parts)
            n, top = letters.shape
            ids, weights = self._pieces(letters)
            a = self._forward(weights, n, top)
            total = a[np.arange(n), size]
            b = np.full((n, top + 1), -np.inf)
            for i in range(top, -1, -1):
                ends = np.where(size == i, 0.0, -np.inf)
                b[:, i] = self._sum([ends, *(weights[k - 1][:, i] + b[:, i + k] for k in range(1, min(top - i, len(weights)) + 1))])
            c = np.asarray(times, dtype=float)[rows]
            for k, (found, w) in enumerate(zip(ids, weights, strict=True), 1):
                with np.errstate(invalid="ignore"):
                    use = np.exp(a[:, : top - k + 1] + w + b[:, k:] - total[:, None]) * c[:, None]
                known = found >= 0
                into += np.bincount(found[known], use[known], len(into))
                if k == 1:
                    rest = ~known & (letters > 0) & np.isfinite(use)
                    for code in np.unique(letters[rest]).tolist():
                        np.add.at(into, self.bytes[list(chr(code).encode("utf-8", "replace"))], use[rest & (letters == code)].sum())


def _marked(words: list[str]) -> tuple[list[str], list[int]]:
    """Words as they stand in the lattice, behind a space mark, and the places of the long ones."""
    marked = [SPACE + w.replace("\0", "\ufffd") for w in words]  # an array's padding is the zero letter
    return marked, [i for i, w in enumerate(marked) if len(w) > LONG]


def _alike(words: list[str], long: list[int], rows: int = 2048, letters: int = 60_000) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words of about one length together, all but the long ones, with their places; few at a time where they are longer."""
    left = set(long)
    flat = sorted((i for i in range(len(words)) if i not in left), key=lambda i: len(words[i]))
    at = 0
    while at < len(flat):
        n = rows
        while n > 1 and len(words[flat[min(at + n, len(flat)) - 1]]) * n > letters:
            n //= 2
        part = flat[at : at + n]
        at += n
        yield np.array(part), [words[i] for i in part]


def read_vocabulary(path: str) -> tuple[dict[str, int], list[int], np.ndarray]:
    """Pieces, the byte pieces, and starting log probabilities: Zipf's law on the file's scores. The last id is the end."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    special = {i for i in range(n) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
    pieces = {sp.id_to_piece(i): i for i in range(n) if i not in special}
    weight = np.array([1 / (10 + abs(sp.get_score(i))) if i not in special else 1e-6 for i in range(n)] + [0.01])
    return pieces, byte, np.log(weight / weight.sum())


def word_types(docs: DataFrame) -> DataFrame:
    """``(word, c, every)`` over ``docs(held_out, text)``: occurrences in training rows and in all rows; the empty word is a text's end."""
    schema = pa.schema([("word", pa.binary()), ("c", pa.int64()), ("every", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, trained = Counter(), Counter()

        def rows() -> Iterator[tuple]:
            for w, n in seen.items():
                yield w, trained.get(w, 0), n
            seen.clear()
            trained.clear()

        for batch in batches:
            for held, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                words = text.lower().split()
                words.append(END)
                seen.update(words)
                if not held:
                    trained.update(words)
                if len(seen) > FLUSH:
                    yield from emit(rows(), schema)
        yield from emit(rows(), schema)

    counts = docs.select("held_out", "text").mapInArrow(run, "word binary, c long, every long")
    return stored(counts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every")), "word-types")


def fit(types: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces and the end. Only expected uses per piece, bounded by the vocabulary, reach the driver."""
    spark: SparkSession = types.sparkSession
    pieces, byte, log_p = read_vocabulary(vocabulary)
    ends = types.where(F.octet_length("word") == 0).agg(F.sum("c")).first()[0] or 0
    schema = pa.schema([("piece", pa.int32()), ("uses", pa.float64())])
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, byte, log_p))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, uses = Lattice(*sent.value), np.zeros(len(sent.value[2]))  # noqa: B023
            for batch in batches:
                lattice.expect([w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()], batch.column(1).to_numpy(), uses)
            yield from emit(((i, u) for i, u in enumerate(uses.tolist()) if u), schema)

        trained = types.where("c > 0 and octet_length(word) > 0").select("word", "c")
        found = trained.mapInArrow(run, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.full(len(log_p), TINY)
        for r in found:
            uses[r["piece"]] += r["uses"]
        uses[-1] += ends
        log_p = np.log(uses / uses.sum())
        sent.unpersist()
    return log_p


def score_texts(docs: DataFrame, *, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row per input row.

    Rows whose CRC-32 of the id as text leaves ``held`` modulo ``folds`` are held out; a null id counts as the empty text.
    Tokens are the words, A-Z lowered, and an end. ``base_score`` is add-one smoothing over tokens, ``score`` the lattice
    model's, both log10. Null and empty texts consist of their end. Rows with equal ids stay apart; an empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == held
    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc"), out.alias("held_out"), F.col(text_col).alias("text"))
    types = word_types(picked)
    total = types.agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v"), F.sum("every").alias("every")).first()
    n, v, every = total["n"] or 0, total["v"] or 0, total["every"] or 0
    log_p = fit(types, vocabulary)
    pieces, byte, _ = read_vocabulary(vocabulary)
    sent = spark.sparkContext.broadcast((pieces, byte, log_p))
    below = math.log10(n + v + 1)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*sent.value)
        end = float(sent.value[2][-1])
        for batch in batches:
            words = batch.column(0).to_pylist()
            s = np.where([not w for w in words], end, lattice.log_probs([w.decode("utf-8", "replace") for w in words])) / LN10
            base = np.log10(batch.column(1).to_numpy() + 1.0) - below
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base), pa.array(s), batch.column(1), batch.column(2)], names=["word", "base", "score", "c", "every"])

    weighed = stored(types.select("word", "c", "every").mapInArrow(weigh, "word binary, base double, score double, c long, every long"), "word-scores")
    frequent = F.col("every") >= max(1, math.ceil(every / HEAD))
    head = weighed.where(frequent).select("word", "base", "score", "c").toLocalIterator()  # HEAD rows at most
    table = spark.sparkContext.broadcast({bytes(r["word"]): (r["base"], r["score"], r["c"] > 0) for r in head})
    fields = [("row", pa.int64()), ("doc", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("times", pa.int64())]
    schema = pa.schema(fields)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value

        for batch in batches:
            numbers = batch.column(0).to_pylist()
            size, found, base, score = [], [], [], []
            rare_row, rare_word, rare_times = [], [], []
            for row, text in zip(numbers, texts_of(batch), strict=True):
                words = text.lower().split()
                words.append(END)
                k, b, s = 0, 0.0, 0.0
                for w, n in Counter(words).items():
                    got = known.get(w)
                    if got is None:
                        rare_row.append(row)
                        rare_word.append(w)
                        rare_times.append(n)
                    else:
                        b += n * got[0]
                        s += n * got[1]
                        k += n * got[2]
                size.append(len(words))
                found.append(k)
                base.append(b)
                score.append(s)
                if len(rare_row) > OUT_ROWS:
                    yield from rare_rows(rare_row, rare_word, rare_times)
                    rare_row, rare_word, rare_times = [], [], []
            m = len(numbers)
            cols = [*(batch.column(i) for i in range(3)), size, found, base, score, pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            yield from rare_rows(rare_row, rare_word, rare_times)

    def rare_rows(row: list, word: list, times: list) -> Iterator[pa.RecordBatch]:
        if row:
            cols = [pa.array(row, pa.int64()), *(pa.nulls(len(row), f.type) for f in list(schema)[1:7]), pa.array(word, pa.binary()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ddl = "row long, doc long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, times long"
    parts = stored(picked.select("row", "doc", "held_out", "text").mapInArrow(add, ddl), "token-rows")
    rare = parts.where("word is not null").select("row", "word", "times").join(weighed.where(~frequent), "word")
    k = F.col("times")
    rest = rare.groupBy("row").agg(F.sum(k * F.col("base")).alias("b"), F.sum(k * F.col("score")).alias("s"), F.sum(F.when(F.col("c") > 0, k).otherwise(0)).alias("k"))
    return parts.where("word is null").join(rest, "row", "left").select(
        F.col("doc").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
