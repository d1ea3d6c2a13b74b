"""Language-model scores, the quality classifier and the pipeline."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import lm as L
from tidelog.llm import quality as Q
from tidelog.llm.tokens import public_path

PIECES = public_path("piece_bpe_32k.model")


def test_lattice_sums_over_all_segmentations():
    pieces = {L.SPACE: 0, "a": 1, "b": 2, "ab": 3, f"{L.SPACE}a": 4, "ba": 5}
    p = np.array([0.2, 0.2, 0.1, 0.2, 0.1, 0.1] + [0.1 / 256] * 256)
    lattice = L.Lattice(pieces, list(range(6, 262)), np.log(p))

    def brute(s):
        total = 0.0
        for cuts in itertools.product((0, 1), repeat=len(s) - 1):
            parts, at = [], 0
            for i, c in enumerate((*cuts, 1)):
                if c:
                    parts.append(s[at : i + 1])
                    at = i + 1
            total += math.prod(p[pieces[x]] if x in pieces else 0.0 for x in parts)
        return total

    for w in ("a", "ab", "abab", "bbaab"):
        assert lattice.log_prob(w) == pytest.approx(math.log(brute(L.SPACE + w)))
    assert lattice.log_prob("é") == pytest.approx(math.log(p[0]) + 2 * math.log(0.1 / 256))
    uses = np.zeros(262)
    lattice.expect(["abab"], np.array([3.0]), uses)
    eps, base = 1e-5, lattice.log_prob("abab")
    for k in range(6):  # expected uses are the derivative by the log probability
        q = np.log(p).copy()
        q[k] += eps
        assert uses[k] == pytest.approx(3 * (L.Lattice(pieces, list(range(6, 262)), q).log_prob("abab") - base) / eps, abs=1e-3)


def test_scores_match_brute_force(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 300)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6, None), (None, ""), (10**6 + 1, "new words here"), (10**6 + 1, "new words here"), (10**6 + 2, "long " * 4000)], "doc_id long, text string")
    both = docs.union(odd)
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b""]) for r in both.collect()]
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows}
    train = Counter(w for d, ws in rows if not held[d] for w in ws)
    n, v = sum(train.values()), len(train)
    want = sorted(
        (repr(d), held[d], len(ws), sum(w in train for w in ws), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws), 5)) for d, ws in rows
    )
    out = L.score_texts(both.selectExpr("*", "1 AS base", "2 AS word"), vocabulary=PIECES).collect()
    got = sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in out)
    assert got == want
    assert all(r["score"] < 0 for r in out)
    pairs = {r["score"] for r in out if r["doc_id"] == 10**6 + 1}
    assert max(pairs) - min(pairs) < 1e-9
    assert L.score_texts(both.limit(0), vocabulary=PIECES).count() == 0


def test_words_of_any_length_go_through_one_lattice(monkeypatch):
    pieces, byte, start = L.read_vocabulary(PIECES)
    lattice = L.Lattice(pieces, byte, start)
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdetionsh日é"), n)) for n in (1, 45, 398, 399, 400, 401, 1942, 10_000)]
    times = np.arange(1.0, 9.0)
    by_place, uses = lattice.log_probs(words), np.zeros(len(start))
    lattice.expect(words, times, uses)
    monkeypatch.setattr(L, "AT_ONCE", 37)
    pieced = lattice.log_probs(words)
    monkeypatch.setattr(L, "LONG", 10**9)
    whole, all_uses = lattice.log_probs(words), np.zeros(len(start))
    lattice.expect(words, times, all_uses)
    assert np.allclose(by_place, whole, rtol=1e-12) and np.allclose(pieced, whole, rtol=1e-12) and np.allclose(uses, all_uses, rtol=1e-9)


def test_score_is_the_sum_over_a_texts_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10**6, "x" * 1942 + " tail"), (10**6 + 1, "")], docs.schema))
    got = {r["doc_id"]: r["score"] for r in L.score_texts(docs, vocabulary=PIECES).collect()}
    types = L.word_types(docs.selectExpr("crc32(string(doc_id)) % 7 = 2 AS held_out", "text"))
    log_p = L.fit(types, PIECES)
    pieces, byte, _ = L.read_vocabulary(PIECES)
    lattice = L.Lattice(pieces, byte, log_p)
    for r in docs.collect():
        words = [w.decode() for w in (r["text"] or "").encode().lower().split()]
        assert got[r["doc_id"]] == pytest.approx((float(lattice.log_probs(words).sum() if words else 0.0) + log_p[-1]) / math.log(10), rel=1e-9)


def test_fitting_raises_the_likelihood(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("false AS held_out", "text")
    types = L.word_types(docs)
    pieces, byte, start = L.read_vocabulary(PIECES)
    sample = [(r["word"].decode(), r["c"]) for r in types.where("octet_length(word) > 0").limit(500).collect()]
    times = np.array([c for _, c in sample])
    total = lambda lp: float(times @ L.Lattice(pieces, byte, lp).log_probs([w for w, _ in sample]))
    one, two = L.fit(types, PIECES, 1), L.fit(types, PIECES, 2)
    assert total(start) < total(one) < total(two)


def test_held_out_accuracy(spark):
    """Held-out labels of the next larger table."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = Q.train(docs, labels.where("doc_id % 4 <> 0"))
    scores = Q.quality_scores(docs, labels, model=model).select("doc_id", "keep", "doc_quality", "doc_toxic")
    rows = scores.join(labels.where("doc_id % 4 = 0").selectExpr("doc_id", "quality AS q", "toxic AS t"), "doc_id").collect()
    assert len(rows) > 80
    assert sum((r["doc_quality"] >= 0.5) == (r["q"] == 1) for r in rows) >= 0.97 * len(rows)
    good = [r for r in rows if r["q"] == 1 and r["t"] == 0]
    assert sum(r["keep"] for r in good) >= 0.97 * len(good)
    bad = [r for r in rows if r["q"] == 0]
    assert sum(not r["keep"] for r in bad) >= 0.95 * len(bad)


def test_sparse_sites_shrink_to_the_level_above(spark):
    rows = [("big", "p", 3.0, -3.0)] * 400 + [("poor", "p", -3.0, -3.0)] * 200 + [("poor", "q", -3.0, -3.0)] + [("tiny", "p", -3.0, -3.0)] + [(None, None, 3.0, 3.0)]
    ev = spark.createDataFrame(rows, "host string, path string, __quality double, __toxic double")
    got = {(r["host"], r["path"]): r for r in Q.site_posteriors(ev).collect()}
    rate = got["big", "p"]["__quality_rate"]
    assert len(got) == 5
    assert got["poor", "p"]["__quality_path"] < got["tiny", "p"]["__quality_path"] < rate < got["big", "p"]["__quality_path"]
    assert abs(got["poor", "q"]["__quality_path"] - got["poor", "q"]["__quality_host"]) < abs(got["poor", "q"]["__quality_path"] - rate)


def shrunk(groups, column):
    """Rate, host and path posteriors of ``groups{(host, path): [probabilities]}`` by plain arithmetic."""
    p = {g: np.array([x[column] for x in v]) for g, v in groups.items()}
    rate = float(np.clip(np.concatenate([*p.values()]).mean(), 1e-4, 1 - 1e-4))

    def strength(k, n, above):
        k, n, above = map(np.asarray, (k, n, above))
        spread, noise, inner = (n * (k / n - above) ** 2).sum(), (above * (1 - above)).sum(), (n * above * (1 - above)).sum()
        return min(10_000.0, max(1.0, (inner / n.sum()) / max((spread - noise) / n.sum(), 1e-9)))

    names = sorted({h for h, _ in p}, key=str)
    hn = {h: sum(len(v) for g, v in p.items() if g[0] == h) for h in names}
    hk = {h: sum(v.sum() for g, v in p.items() if g[0] == h) for h in names}
    w = strength([hk[h] for h in names], [hn[h] for h in names], [rate] * len(names))
    host = {h: (hk[h] + w * rate) / (hn[h] + w) for h in names}
    groups = [*p]
    w = strength([p[g].sum() for g in groups], [len(p[g]) for g in groups], [host[g[0]] for g in groups])
    return rate, host, {g: (p[g].sum() + w * host[g[0]]) / (len(p[g]) + w) for g in groups}


def test_scores_against_plain_arithmetic(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = Q.train(docs, labels)
    rows = docs.collect()
    sig = lambda x: 1 / (1 + np.exp(-x))
    odds = {r["doc_id"]: model.log_odds((r["text"] or "").encode()) for r in rows}
    groups = {}
    for r in rows:
        groups.setdefault((r["source"], r["lang"]), []).append([sig(x) for x in odds[r["doc_id"]]])
    sites = [shrunk(groups, i) for i in range(2)]
    site = {r["doc_id"]: (r["source"], r["lang"]) for r in rows}
    got = Q.quality_scores(docs, labels, model=model).collect()
    assert len(got) == len(rows)
    logit = lambda x: np.log(x / (1 - x))
    for r in got:
        g = site[r["doc_id"]]
        q, t = (float(sig(odds[r["doc_id"]][i] + logit(sites[i][2][g]) - logit(sites[i][0]))) for i in range(2))
        want = (q, t, sites[0][1][g[0]], sites[0][2][g])
        assert np.allclose([r["quality"], r["toxic"], r["host_quality"], r["path_quality"]], want, atol=1e-9)
        assert r["keep"] == (q >= 0.5 and t < 0.5)


def test_columns_of_any_name_are_kept(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"__quality": F.lit(1), "__keep": F.lit("x"), "host": F.lit(2), "__h": F.lit(3)})
    model = Q.train(docs, labels)
    got = Q.kept(docs, labels, model=model)
    plain = Q.quality_scores(docs, labels, model=model).where("keep")
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == {r["doc_id"] for r in plain.collect()}
    assert {(r["__quality"], r["__keep"], r["host"], r["__h"]) for r in got.collect()} == {(1, "x", 2, 3)}


def test_quality_edge_cases(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = Q.train(docs, labels)
    odd = spark.createDataFrame([(1, None, None, "en", "x"), (None, "", "s", None, "x"), (2, "a b", "s", "en", "x"), (2, "a b", "s", "en", "x"), (3, "w " * 9000, "s", "en", "x")], "doc_id long, text string, source string, lang string, host string")
    got = Q.quality_scores(odd, labels, model=model).collect()
    assert len(got) == 5 and all(0 <= r["quality"] <= 1 and r["keep"] is not None for r in got)
    assert Q.quality_scores(odd.limit(0), labels, model=model).count() == 0
    bare = Q.train(docs, labels.limit(0))
    assert Q.quality_scores(odd, labels.limit(0), model=bare).count() == 5


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    extra = docs.limit(3).selectExpr("doc_id + 1000000 AS doc_id", "text", "lang", "source", "n_chars")
    start = docs.unionByName(extra)
    now, ids, sizes = start, {}, []
    for name, stage in C.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns
        ids[name] = {r[0] for r in now.select("doc_id").collect()}
        sizes.append(len(ids[name]))
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > 0
    kept = ids["quality_classifier"]
    judged = [(labels[i] == (1, 0), i in kept) for i in labels]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)
    assert not any(i >= 1_000_000 and i - 1_000_000 in ids["simhash_near_dedup"] for i in ids["simhash_near_dedup"])
    assert now.where("text rlike '[0-9a-f]{24,}'").count() == 0
    packed = C.STAGES[-1][1](spark, now, sf_dir)
    assert {r[0] for r in packed.select("doc_id").collect()} == ids["secret_scans"]
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0


def test_pipeline_run(spark, sf_dir):
    import corpus_pipeline as C

    out = C.run(spark, sf_dir)
    assert out.count() > 50 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
