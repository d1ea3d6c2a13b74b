"""Token ids and token counts of whole texts for a word-end BPE vocabulary.

Two things live here. ``WordSplit`` cuts a text into pre-tokens exactly as the library does. ``RankMerger`` counts the
tokens of pre-tokens by rank-synchronous array merging: all pre-tokens of a batch lie in one ragged numpy array of
symbols, in each round every sequence merges its own lowest-rank pair, at once for all sequences, and the symbols that
survive are counted. Rounds over the whole array would be many for a long sequence, so sequences above ``LONG`` symbols lie
in a linked array of their own, where a round visits only the places that hold the lowest rank and those next to them.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Recent, texts_of

#: Characters on which this module's splitting and the library's provably agree: printable ASCII, ASCII white space and
#: the precomposed letters U+00C0 to U+017F but for the two signs in between and the dotted capital I.
_PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7eÀ-ÖØ-öø-įıĲ-ſ]*")
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\\sa-zß-öø-ſ0-9]+")
#: Chunks that a worker remembers, and the longest that it does; bounds on memory, not on what is counted.
REMEMBERED, LONGEST = 250_000, 100
#: Symbols above which a sequence is merged in the linked array.
LONG = 128


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordSplit:
    """Pre-tokens of a text, special strings apart, as the tokenizer file says."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        spec = json.load(open(path, encoding="utf-8"))
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.marks = {t[:2] for t in added}

    def words(self, chunk: bytes) -> list[str] | None:
        """Pre-tokens, lower-cased, of a text without white space; None if only ``other`` can tell."""
        text = chunk.decode("utf-8", "replace")
        if _PLAIN.fullmatch(text) is None or any(m in text for m in self.marks):
            return None
        return _WORDS.findall(text.lower())

    def other(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, in the byte alphabet, and the number of special strings of any text."""
        parts = self.added.split(text) if self.added else [text]
        out: list[str] = []
        for part in parts:
            if part:
                norm = self.library.normalizer.normalize_str(part)
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        return out, len(parts) - 1


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte value: Latin-1's visible characters stand for themselves, the other bytes for U+0100 onwards."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class RankMerger:
    """Rank-synchronous merging of many pre-tokens at once."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))["model"]
        self.vocab: dict[str, int] = spec["vocab"]
        self.end: str = spec["end_of_word_suffix"] or ""
        self.size = max(self.vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], dtype=np.int64)
        code = left * self.size + right
        order = np.argsort(code, kind="stable")
        self.codes, self.ranks = code[order], order.astype(np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)[order]
        self.letters = byte_alphabet()

    def symbols(self, word: str) -> list[int]:
        """A pre-token in the byte alphabet as initial symbols, its last one with the word end."""
        return [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.end]]

    def in_bytes(self, word: str) -> str:
        return "".join(self.letters[b] for b in word.encode())

    def merge(self, words: list[str]) -> list[list[int]]:
        """Surviving symbols of each pre-token (byte alphabet; none is empty)."""
        first = [self.symbols(w) for w in words]
        out: list[list[int]] = [[] for _ in words]
        for merge, chosen in ((self._short, [i for i, x in enumerate(first) if len(x) <= LONG]), (self._linked, [i for i, x in enumerate(first) if len(x) > LONG])):
            if chosen:
                for i, x in zip(chosen, merge([first[i] for i in chosen]), strict=True):
                    out[i] = x
        return out

    def _linked(self, first: list[list[int]]) -> list[list[int]]:
        """Long sequences in one linked array: the lowest rank's places merge, their neighbours get new ranks."""
        sizes = np.array([len(x) for x in first], dtype=np.int64)
        sym = np.fromiter((s for x in first for s in x), dtype=np.int64, count=int(sizes.sum()))
        n = len(sym)
        seq = np.repeat(np.arange(len(first)), sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[np.cumsum(sizes) - 1] = n  # the place behind the last one ends every sequence
        before[np.r_[0, np.cumsum(sizes)[:-1]]] = -1
        ends = np.r_[sym, -1]  # a pair with the end is none
        after = np.r_[after, n]
        place = np.full(n, -1)  # of each position's pair in the table of merges, -1 for none
        alive = np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def rank(at: np.ndarray) -> None:
            right = ends[after[at]]
            code = ends[at] * self.size + right
            found = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            place[at] = np.where((self.codes[found] == code) & (right >= 0), found, -1)
            at = at[place[at] >= 0]
            if not len(at):
                return
            at = at[np.argsort(self.ranks[place[at]], kind="stable")]
            own = self.ranks[place[at]]
            cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(own)], strict=True):
                r = int(own[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(at[a:b])

        rank(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            parts = waiting.pop(r)
            pos = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            pos = pos[alive[pos] & (place[pos] >= 0)]
            pos = pos[self.ranks[place[pos]] == r]
            if not len(pos):
                continue
            if len(pos) > 1:  # runs of overlapping pairs (a a a): every other one merges, from the left
                fresh = np.r_[True, after[pos[:-1]] != pos[1:]]
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0))
                pos = pos[(np.arange(len(pos)) - run) % 2 == 0]
            gone = after[pos]
            ends[pos] = self.made[place[pos]]
            alive[gone] = False
            after[pos] = after[gone]
            last = after[pos] < n
            before[after[pos][last]] = pos[last]
            left = before[pos]
            rank(np.unique(np.r_[pos, left[left >= 0]]))
        sym, seq = ends[:n][alive], seq[alive]
        cuts = np.searchsorted(seq, np.arange(len(first) + 1))
        return [sym[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _short(self, first: list[list[int]]) -> list[list[int]]:
        """Short sequences in one ragged array, all at once in every round."""
        sizes = np.array([len(x) for x in first], dtype=np.int64)
        sym = np.fromiter((s for x in first for s in x), dtype=np.int64, count=int(sizes.sum()))
        seq = np.repeat(np.arange(len(first)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            code = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            known = (self.codes[at] == code) & (seq[:-1] == seq[1:])
            rank = np.full(len(sym), np.iinfo(np.int64).max)
            rank[:-1][known] = self.ranks[at[known]]
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(sym)])
            lowest = np.repeat(low, lengths)
            over = lowest == np.iinfo(np.int64).max
            if over.any():  # these sequences have no pair left
                done.append((seq[over], sym[over]))
                keep = ~over
                # flags of kept symbols stay right: whole sequences go
                sym, seq, rank, lowest = sym[keep], seq[keep], rank[keep], lowest[keep]
                at = np.r_[at, 0][keep]
                if not len(sym):
                    break
            else:
                at = np.r_[at, 0]
            hit = rank == lowest
            # runs of overlapping hits (a a a): every other one merges, from the left
            pos = np.flatnonzero(hit)
            if len(pos) > 1:
                fresh = np.r_[True, np.diff(pos) > 1]
                run = np.maximum.accumulate(np.where(fresh, np.arange(len(pos)), 0))
                pos = pos[(np.arange(len(pos)) - run) % 2 == 0]
            sym = sym.copy()
            sym[pos] = self.made[at[pos]]
            gone = np.zeros(len(sym), dtype=bool)
            gone[pos + 1] = True
            sym, seq = sym[~gone], seq[~gone]
        out: list[list[int]] = [[] for _ in first]
        for s, v in done:
            cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(s)], strict=True):
                out[s[a]] = v[a:b].tolist()
        return out

    def counts(self, words: list[str]) -> list[int]:
        return [len(x) for x in self.merge(words)]


class TokenCounter:
    """Token counts of texts, with a bounded memory of chunks (texts between ASCII white space) seen."""

    def __init__(self, path: str) -> None:
        self.split, self.merger = WordSplit(path), RankMerger(path)
        self.seen = Recent(REMEMBERED)

    def count(self, texts: list[bytes]) -> list[int]:
        """A group of texts at a time, so that all their new pre-tokens merge in one ragged array."""
        parts = [t.lower().split() for t in texts]
        fresh = self.seen.unknown(c for chunks in parts for c in chunks)
        new = {c: self.split.words(c) for c in fresh}
        words = list({w for ws in new.values() if ws for w in ws})
        size = dict(zip(words, self.merger.counts([self.merger.in_bytes(w) for w in words]), strict=True))
        seen = self.seen.young
        seen.update((c, None if ws is None else sum(map(size.__getitem__, ws))) for c, ws in new.items())
        out = []
        for text, chunks in zip(texts, parts, strict=True):
            try:
                out.append(sum(map(seen.__getitem__, chunks)))
            except TypeError:  # None: a chunk that is not plain
                rest, extra = self.split.other(text.decode("utf-8", "replace"))
                out.append(sum(self.merger.counts(rest)) + extra)
        for c in fresh:
            if len(c) > LONGEST:
                del seen[c]
        return out


def groups_of(texts: list[bytes], size: int = 2_000_000) -> Iterator[list[bytes]]:
    """Consecutive texts, up to about so many bytes together; a longer one alone."""
    out: list[bytes] = []
    total = 0
    for t in texts:
        if out and total + len(t) > size:
            yield out
            out, total = [], 0
        out.append(t)
        total += len(t)
    if out:
        yield out


@lru_cache(maxsize=2)
def counter_of(path: str) -> TokenCounter:
    """One per worker process and vocabulary: what it has seen serves the worker's next task too."""
    return TokenCounter(path)


def token_counts(docs: DataFrame, *, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: ``(id, n_bytes, n_tokens, over_limit)``, a row per input row.

    Null text counts as empty (0 bytes, 0 tokens); null and repeated ids stay as they are; other columns are not read.
    ``vocabulary`` is the path of a tokenizer file that every worker can open. No shuffle.
    """
    schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for batch in batches:
            raw = texts_of(batch)
            n = [c for g in groups_of(raw) for c in counter.count(g)]
            cols = [batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", *schema.names])

    out = picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


@lru_cache(maxsize=2)
def id_bytes(path: str) -> Callable[[bytes], bytes]:
    """A function from a UTF-8 text to its ids, as little-endian 32-bit words, by the library.

    The library's model encodes the pre-tokens of each plain chunk and the ids of frequent chunks are remembered; a text with any other chunk goes to the library whole.
    """
    split = WordSplit(path)
    letters = byte_alphabet()
    encode = split.library.model.tokenize
    seen = Recent(REMEMBERED)

    def chunk_ids(chunk: bytes) -> bytes | None:
        words = split.words(chunk)
        if words is None:
            return None
        return b"".join(t.id.to_bytes(4, "little") for w in words for t in encode("".join(letters[b] for b in w.encode())))

    def ids(text: bytes) -> bytes:
        chunks = text.lower().split()
        new = seen.unknown(chunks)
        known = seen.young
        for c in new:
            known[c] = chunk_ids(c)
        try:
            return b"".join(map(known.__getitem__, chunks))
        except TypeError:
            found = split.library.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
            return np.array(found, dtype="<u4").tobytes()
        finally:
            for c in new:
                if len(c) > LONGEST:
                    del known[c]

    return ids
