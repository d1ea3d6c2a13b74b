"""Token counts and packing against the library and brute force."""

import random
import time
import zlib

import numpy as np

from tidelog.llm import packing as P
from tidelog.llm import tokens as T

PATH = T.public_path("word_bpe_49k.json")
ODD = [
    "", "a", "Σας ΣΑΣ İstanbul", "é x", "<|endoftext|>hi<|startoftext|>", "<|endoftext|", "日本語 テキスト123", "a" * 13, "\x1c\x85\xa0x", "don't we'll I'VE",
    "!!!???--- a1b2", "ǅ ŉ ẞ ß", "x" * 5000, "'s('s)", "👍🏽 ok", "‍​", "½²", "café Å", "tab\tand\nnew\r\nline",
]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_counts_and_ids_equal_the_library(spark, sf_dir):
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    counter = T.TokenCounter(PATH)
    assert counter.count([t.encode() for t in texts]) == [len(x) for x in want]
    ids = T.id_bytes(PATH)
    assert [ids(t.encode()) for t in texts] == [np.array(x, dtype="<u4").tobytes() for x in want]


def test_token_counts_edge_cases(spark):
    rows = [(1, "Hello world"), (1, "Hello world"), (None, None), (3, ""), (4, "word " * 3000)]
    docs = spark.createDataFrame([(a, b, 5) for a, b in rows], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in T.token_counts(docs, vocabulary=PATH).collect()), key=repr)
    assert got == sorted([(1, 11, 2, False), (1, 11, 2, False), (None, 0, 0, False), (3, 0, 0, False), (4, 15000, 3000, True)], key=repr)
    assert T.token_counts(docs.limit(0), vocabulary=PATH).count() == 0


def laid_out(counts, capacity):
    """Sequences of a plan, each checked to be gapless and within the capacity."""
    plan = P.plan_packing(counts, capacity)
    rows, found, total = sorted(plan.rows), {}, {}
    for i, (n, rank, per, to, offset) in enumerate(rows):
        end = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == n else counts[n]
        for q in range(rank, end):
            found.setdefault(to + (q - rank) // per, []).append((offset + (q - rank) % per * n, n))
            total[n] = total.get(n, 0) + 1
    assert total == counts and len(found) == plan.sequences
    for pieces in found.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
        assert sum(3 * n > capacity for _, n in pieces) <= 2
    return len(found)


def test_plans_are_gapless_and_close_to_the_bound():
    rng = random.Random(1)
    for capacity in (1, 2, 3, 7, 30, 100):
        for _ in range(60):
            laid_out({n: rng.randint(1, 9) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}, capacity)
    counts = {n: rng.randint(1, 40) for n in range(1, 513)}
    least = max(sum(n * c for n, c in counts.items()) / 512, sum(c for n, c in counts.items() if 2 * n > 512))
    assert laid_out(counts, 512) <= 1.02 * least
    assert laid_out({5: 3, 6: 3, 9: 1}, 11) == 4  # pairs 6 with 5, and 9 alone


def test_pack_round_trip(spark):
    rows = [(1, "Hello world " * 900), (2, None), (2, ""), (3, "short one"), (None, "no id"), (4, "x " * 4096), (5, "y " * 2047)]
    docs = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, length int")
    got = P.pack(docs, vocabulary=PATH).collect()
    lib = library()
    want = []
    for doc, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids + [0]
        for i, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((doc, i, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) == -(-sum(w[3] for w in want) // 2048)
    assert P.pack(docs.limit(0), vocabulary=PATH).count() == 0


def test_long_words_are_counted_as_the_library_does():
    rng = np.random.default_rng(8)
    counter = T.TokenCounter(PATH)
    words = ["".join(rng.choice(list("abcdest"), n)) for n in (127, 128, 129, 130, 1000, 20_000, 300_000)]
    words += ["a" * 1001, "ab" * 700 + "a" * 33, "na" * 5001, "é" * 3000, "日本語" * 900, "!" * 500 + "a" * 300]
    start = time.perf_counter()
    got = counter.count([w.encode() for w in words])
    assert time.perf_counter() - start < 5
    assert got == [len(library().encode(w, add_special_tokens=False).ids) for w in words]
    assert counter.count([" ".join(words).encode()]) == [sum(got)]
