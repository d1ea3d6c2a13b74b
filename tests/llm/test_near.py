"""The pipeline's stages that drop rows, against brute force on shingle sets and on words."""

import numpy as np

from tidelog.llm import near as N
from tidelog.llm import simhash as S


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, n):
    out = list(words)
    for k in rng.choice(len(words), n, replace=False):
        out[k] = f"new{rng.integers(10**6)}"
    return out


def survivors(rows):
    """Rows that stay: of each component of links the one of the smallest id, null last, then the first."""
    sets = [plain_set(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and similarity(sets[i], sets[j]) >= 0.8:
                old = part[i]
                part = [part[j] if p == old else p for p in part]
    return [min((r for r, q in zip(rows, part, strict=True) if q == p), key=lambda r: (r[0] is None, r[0] or 0)) for p in sorted(set(part))]


def drop(spark, rows):
    import corpus_pipeline as C

    return [tuple(r) for r in C.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]


def test_near_dedup_drops_near_copies_and_nothing_else(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(40):
        base = list(rng.choice(vocabulary, int(rng.integers(60, 400))))
        rows.append((10 * i, " ".join(base)))
        rows += [(10 * i + k + 1, " ".join(edited(rng, base, max(1, round(part * len(base)))))) for k, part in enumerate((0.01, 0.02, 0.03, 0.045, 0.06, 0.09))]
    rows += [(1000, "four WORDS of text"), (1001, "four words of  text"), (1002, None), (1003, " "), (1004, "one two three four five six")]
    sims = [similarity(plain_set(rows[7 * i][1]), plain_set(rows[7 * i + k][1])) for i in range(40) for k in range(1, 7)]
    assert sum(0.8 <= s < 0.86 for s in sims) >= 20 and sum(0.7 <= s < 0.8 for s in sims) >= 20
    assert sorted(drop(spark, rows)) == sorted(survivors(rows))


def test_long_lists_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(N, "MORE", 2)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, int(rng.integers(1, 8))))) for i in range(60)]
    assert sorted(drop(spark, rows)) == sorted(survivors(rows))


def test_nodes_near_a_large_group_do_not_meet_all_of_it(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(150)]
    texts = [base] + [edited(rng, base, int(rng.integers(1, 4))) for _ in range(120)] + [edited(rng, base, int(rng.integers(4, 9))) for _ in range(180)]
    pool = [(int(rng.integers(150)), f"pool{i}") for i in range(8)]  # changes that many texts have
    for _ in range(60):
        out = list(base)
        for k in rng.choice(8, int(rng.integers(3, 7)), replace=False):
            out[pool[k][0]] = pool[k][1]
        texts.append(out)
    texts += [texts[int(rng.integers(121, 301))][: int(rng.integers(110, 150))] for _ in range(40)]
    texts += [edited(rng, texts[int(rng.integers(121, 301))], 1) for _ in range(40)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    looked, alike = [], N._alike

    def counted(pairs, sketches, sets):
        looked.append(pairs.count())
        return alike(pairs, sketches, sets)

    monkeypatch.setattr(N, "_alike", counted)
    want = sorted(survivors(rows))
    assert sorted(drop(spark, rows)) == want and len(want) > 100
    assert sum(looked) < 50 * len(rows)


def test_near_copies_that_are_not_linked_meet_few_of_their_group(spark, monkeypatch):
    rng = np.random.default_rng(12)
    texts = []
    for group, least in (("a", 1), ("b", 2)):  # the second has no text that is near to most others
        base = [f"{group}{i}" for i in range(150)]
        texts += [base] * (least == 1) + [edited(rng, base, int(rng.integers(least, 9))) for _ in range(400)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    looked, alike = [], N._alike

    def counted(pairs, sketches, sets):
        looked.append(pairs.count())
        return alike(pairs, sketches, sets)

    monkeypatch.setattr(N, "_alike", counted)
    want = sorted(survivors(rows))
    assert sorted(drop(spark, rows)) == want and 300 < len(want) < 700
    assert sum(looked) < 10 * len(rows)


def test_simhash_candidates_connect_as_all_pairs_do(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(edited(rng, base, int(rng.integers(0, 12)))) for _ in range(80)] + [" ".join(rng.choice(base, 90)) for _ in range(20)]
    fps = [S.fingerprint(t.encode(), 2, distinct=True) for t in texts]
    near = {(i, j) for i in range(100) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    pairs = {(r["b"], r["a"]) for r in N.simhash_pairs(spark.createDataFrame(list(enumerate(signed)), "node long, fp long")).collect()}
    assert len(near) > 100 and pairs <= near

    def parts(links):
        part = list(range(100))
        for i, j in links:
            old, new = part[i], part[j]
            part = [new if p == old else p for p in part]
        return {frozenset(i for i in range(100) if part[i] == p) for p in part}

    assert parts(pairs) == parts(near)


def test_near_copies_go_by_their_fingerprints_without_bands(spark, monkeypatch):
    monkeypatch.setattr(N, "band_lists", lambda own: spark.createDataFrame([], "key long, node long, n int, row long"))
    rng = np.random.default_rng(10)
    rows = []
    for i in range(20):
        base = list(rng.choice([f"w{k}" for k in range(3000)], 300))
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(edited(rng, base, 1)))]
    rows.append((100, " ".join(edited(rng, rows[0][1].split(), 30))))  # no near-copy
    fps = [S.fingerprint(t.encode(), 2, distinct=True) for _, t in rows]
    far = {2 * i + 1 for i in range(20) if (fps[2 * i] ^ fps[2 * i + 1]).bit_count() > 4}
    assert len(far) < 5 and {i for i, _ in drop(spark, rows)} == {*range(0, 40, 2), 100, *far}


def test_rows_of_one_id_are_judged_apart(spark):
    rng = np.random.default_rng(7)
    a, b, c = (" ".join(rng.choice([f"w{i}" for i in range(500)], 80)) for _ in range(3))
    rows = [(5, a), (5, b), (3, b), (7, a), (None, c), (None, c), (None, a), (None, "some other text")]
    assert sorted(drop(spark, rows), key=repr) == sorted([(5, a), (3, b), (None, c), (None, "some other text")], key=repr)


def test_decontamination_drops_contaminated_rows_only(spark, sf_dir):
    import corpus_pipeline as C

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    item = max((r["text"] for r in items.collect()), key=lambda t: len(t or ""))
    clean = [(None, "a clean text"), (1, "another clean text"), (None, None), (2, "third"), (2, "third")]
    docs = spark.createDataFrame([*clean, (None, f"before {item}"), (1, item)], "doc_id long, text string")
    got = [tuple(r) for r in C.benchmark_decontamination(spark, docs, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted(clean, key=repr)
