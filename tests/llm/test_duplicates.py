"""SimHash groups and I-Match fingerprints against brute force."""

import hashlib

import numpy as np
import pytest
import xxhash

from tidelog.llm import imatch as I
from tidelog.llm import simhash as S
from tidelog.llm.components import components


def plain_fingerprint(text, width=4):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] if len(w) >= width else [b" ".join(w)] if w else []
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in sh) for k in range(64)]
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(sh))


def groups(values, distance):
    part = list(range(len(values)))

    def find(x):
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                part[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize(("distance", "longest"), [(0, 2048), (3, 2), (4, 2048), (4, 2), (5, 2)])
def test_links_connect_as_all_pairs_do(spark, distance, longest):
    rng = np.random.default_rng(3)
    values = set()
    for base in rng.integers(0, 2**63, 15):
        for _ in range(10):
            v = int(base)
            for k in rng.choice(64, rng.integers(0, 7), replace=False):
                v ^= 1 << int(k)
            values.add(v)
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    nodes = spark.createDataFrame([(x, [x]) for x in signed], "node long, fps array<long>")
    root = {r["node"] % 2**64: r["root"] for r in components(S.fingerprint_links(nodes, distance=distance, longest=longest)).collect()}
    got, want = {}, {}
    for v, g in zip(values, groups(values, distance), strict=True):
        got.setdefault(root.get(v, v), set()).add(v)
        want.setdefault(g, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \t\n"), (None, "one two"), (10**6 + 3, "ONE two"), (10**6 + 3, "three"), (10**6 + 4, "a b " * 5000)], "doc_id long, text string")
    both = docs.union(odd)
    rows = both.collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    part = groups(fps, 4)
    low = {}
    for r, g in zip(rows, part, strict=True):
        if r["doc_id"] is not None:
            low[g] = min(low.get(g, r["doc_id"]), r["doc_id"])
    want = sorted(repr((r["doc_id"], f"{f:016x}", low.get(g))) for r, f, g in zip(rows, fps, part, strict=True))
    got = S.near_duplicates(both.selectExpr("*", "1 AS fp", "2 AS node")).collect()
    assert sorted(repr(tuple(r)) for r in got) == want
    assert S.near_duplicates(both.limit(0)).count() == 0


def test_pipeline_parameters_find_near_copies(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(5000)]
    rows, n = [], 0
    for i in range(60):
        w = list(rng.choice(words, 300))
        rows.append((2 * i, " ".join(w)))
        for k in rng.choice(300, 5, replace=False):
            w[k] = "edited"
        rows.append((2 * i + 1, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(docs, width=2, distinct=True, distance=5, seeds=(42, 43, 44)).collect()}
    n = sum(got[2 * i + 1] == 2 * i for i in range(60))
    assert n >= 57 and all(got[2 * i] == 2 * i for i in range(60))


def test_fingerprints_and_edits(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(I, "BUCKET", 20)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, "é😀x"), (10**6 + 1, "é😀x"), (10**6 + 2, "zzz qqq"), (10**6 + 3, "zzz qqq")], "doc_id long, text string")
    both = docs.union(odd)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in both.collect()))
    got = sorted(I.fingerprints_and_edits(both.selectExpr("*", "1 AS tail")).collect(), key=lambda r: (r["doc_id"], r["edited_sha256"]))
    want = []
    for i, (doc, text) in enumerate(rows):
        m = len(text) // 2
        new = text[: len(text) - m] + rows[(i + 1) % len(rows)][1][:m]
        want.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest()))
    assert sorted(want) == [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got]
    by_text = {}
    for r, (_, text) in zip(sorted(got, key=lambda r: r["doc_id"]), rows, strict=True):
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_edited"] == 1) == (r["fingerprint"] == r["edited_fingerprint"])
    assert sum(r["near_edited"] for r in got) > 10 * sum(r["near_next"] for r in got if r["doc_id"] < 10**6)
    assert I.fingerprints_and_edits(both.limit(0)).count() == 0
    one = I.fingerprints_and_edits(odd.limit(1)).first()
    assert one["near_next"] == 1.0


def test_lexicon_is_the_band(spark):
    docs = spark.createDataFrame([(i, f"all {'half' if i % 2 else ''} few{i // 3} one{i}") for i in range(300)], "doc_id long, text string")
    terms = set(I.build_lexicon(docs, rarest=0.01, commonest=0.4).terms.tolist())
    assert terms == {xxhash.xxh64_intdigest(f"few{i}".encode()) for i in range(100)}
