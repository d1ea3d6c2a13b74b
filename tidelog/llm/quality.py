"""Quality classifier with hierarchical empirical Bayes over sites.

Two document classifiers, for quality and for toxicity, are fitted to a bounded hash sample of labelled rows. Their evidence is
then set against what is known of a document's site: soft counts of all documents are grouped by host and by path, a path's
rate is shrunk toward its host's and a host's toward the global rate, by as much as the rates' own spread says (method of
moments), so that sparse sites fall back on the level above. A document's log odds are those of its text plus the site's
posterior log odds less the global ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import Recent, emit, stored, texts_of

#: Labelled rows that the classifiers are fitted to, at most about; a parameter of ``train``.
SAMPLE = 8000
BUCKETS = 1 << 20
#: Word features that the toxicity classifier keeps.
WORDS = 256
SITES_BROADCAST = 500_000
#: Log odds of one document's text count within these.
CLIP = 12.0
#: Words that a worker remembers the features of; see ``Recent``.
REMEMBERED = 100_000

_JUNK = re.compile(rb"[^\sA-Za-z0-9.,;:'\"()\-\x80-\xff]")
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")


def shape(text: bytes) -> list[float]:
    """Measures of a text's form, each between about 0 and 10, defined for any text."""
    n = max(1, len(text))
    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    upper = sum(map(text.count, (bytes([c]) for c in range(65, 91))))
    digits = sum(map(text.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9")))
    tally = Counter(words)
    junk = len(_JUNK.findall(text))
    line_tally = Counter(lines)
    top = tally.most_common(3)
    bare = sum(c for w, c in tally.items() if not w[:1].isalnum() and w[0] < 128)
    ending = sum(c for w, c in tally.items() if w[-1:] in b"!$%&#*?|<>{}~^=+@_" and len(w) > 1)
    return [
        float(np.log1p(len(words))), min(10.0, n / k / 2), 10 * upper / n, 10 * digits / n, 10 * junk / n, 10 * bare / k, 10 * ending / k,
        10 * text.count(b"!") / n, 10 * text.count(b"|") / n, 10 * (text.count(b".") + text.count(b",")) / k, 10 * len(tally) / k,
        10 * (top[0][1] / k if top else 0), 10 * sum(c for _, c in top) / k, 10 * (m - len(line_tally)) / m, float(np.log1p(m)),
        min(10.0, len(words) / m / 10), 10 * sum(c for x, c in line_tally.items() if c > 1) / m, float(len(words) < 5), 10 * sum(1 for w in tally if w.isupper()) / max(1, len(tally)),
    ]


def features_of(word: bytes) -> list[int]:
    """Hashes of a word and of its beginnings of 5 to 7 letters: insults come compounded, too."""
    out = [xxhash.xxh32_intdigest(word, 1) % BUCKETS]
    letters = word.decode("utf-8", "replace")
    out += [xxhash.xxh32_intdigest(letters[:k].encode(), 2) % BUCKETS for k in (5, 6, 7) if len(letters) >= k]
    return out


def weight(count: int, words: int) -> float:
    """How strongly a feature that ``count`` of a text's words have counts."""
    return min(5.0, float(np.log2(1 + 100 * count / words)))


def word_features(text: bytes) -> dict[int, float]:
    words = _WORD.findall(text.lower())
    tally: Counter[int] = Counter()
    for w, c in Counter(words).items():
        for f in features_of(w):
            tally[f] += c
    return {f: weight(c, len(words)) for f, c in tally.items()}


def logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 400) -> np.ndarray:
    """Weights, the intercept last, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-6
    for _ in range(min(rounds, 60)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Classifier:
    """Both document classifiers. ``words`` are the sorted word features that the second one uses."""

    mean: np.ndarray
    scale: np.ndarray
    quality: np.ndarray
    words: np.ndarray
    toxic: np.ndarray

    def __post_init__(self) -> None:
        object.__setattr__(self, "place", {int(f): i for i, f in enumerate(self.words)})
        object.__setattr__(self, "seen", Recent(REMEMBERED))

    def log_odds(self, text: bytes) -> tuple[float, float]:
        x = (np.array(shape(text)) - self.mean) / self.scale
        z = np.clip(np.r_[x, x * x, 1.0], -50, 50)
        q = float(z @ self.quality)
        words = _WORD.findall(text.lower())
        tally: Counter[int] = Counter()
        times = Counter(words)
        for w in self.seen.unknown(times):
            self.seen.young[w] = tuple(self.place[f] for f in features_of(w) if f in self.place)
        known = self.seen.young
        for w, c in times.items():
            for f in known[w]:
                tally[f] += c
        t = float(self.toxic[-1]) + sum(self.toxic[f] * weight(c, len(words)) for f, c in tally.items())
        return float(np.clip(q, -CLIP, CLIP)), float(np.clip(t, -CLIP, CLIP))


def fit(quality: np.ndarray, toxic: np.ndarray, shapes: np.ndarray, chosen: np.ndarray, weights: np.ndarray) -> Classifier:
    """Fit both classifiers: on shapes, and on the weights of the chosen word features."""
    mean, scale = shapes.mean(0), shapes.std(0) + 0.05
    x = (shapes - mean) / scale
    q = logistic(np.clip(np.c_[x, x * x], -50, 50), quality, 1.0)
    return Classifier(mean, scale, q, chosen, logistic(weights, toxic, 0.3))


def choose_words(sample: DataFrame, *, words: int = WORDS) -> np.ndarray:
    """Word features that weigh most in toxic rows of ``sample(q, t, text)`` against the others: at most ``words``, sorted."""
    schema = pa.schema([("f", pa.int32()), ("in1", pa.float64()), ("in0", pa.float64()), ("rows1", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[float]] = {}

        def rows() -> Iterator[tuple]:
            for f, (one, zero, n) in sums.items():
                yield f, one, zero, int(n)
            sums.clear()

        for batch in batches:
            for t, text in zip(batch.column(1).to_pylist(), texts_of(batch), strict=True):
                for f, w in word_features(text).items():
                    at = sums.setdefault(f, [0.0, 0.0, 0])
                    at[1 - t] += w
                    at[2] += t
                if len(sums) > 200_000:
                    yield from emit(rows(), schema)
        yield from emit(rows(), schema)

    n = sample.agg(F.sum("t").alias("n1"), F.sum(1 - F.col("t")).alias("n0")).first()
    sums = sample.mapInArrow(run, "f int, in1 double, in0 double, rows1 long").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("in1", "in0", "rows1")))
    odds = F.log((F.col("in1") + 0.2) / ((n["n1"] or 0) + 1)) - F.log((F.col("in0") + 0.2) / ((n["n0"] or 0) + 1))
    top = sums.where("rows1 >= 2").withColumn("odds", odds).where("odds > 1.5").orderBy((F.round(F.col("in1") * F.col("odds"), 6)).desc(), "f").limit(words)
    return np.sort(np.array([r["f"] for r in top.collect()], dtype=np.int64))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fit to at most about ``sample`` labelled rows, drawn by a hash of their ids. Ids with several labels take the majority."""
    by_id = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.avg("quality") >= 0.5).cast("int").alias("q"), (F.avg("toxic") >= 0.5).cast("int").alias("t"))
    by_id = by_id.where("q is not null and t is not null")
    n = by_id.count()
    drawn = by_id.where(F.expr(f"pmod(xxhash64(id), {max(1, -(-n // sample))}) = 0"))
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id").select("q", "t", "text")  # about `sample` rows
    rows = stored(joined, "labelled")
    chosen = choose_words(rows)
    place = {int(f): i for i, f in enumerate(chosen)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            found = [[(place[f], w) for f, w in word_features(t).items() if f in place] for t in texts]
            cols = [batch.column(0), batch.column(1), pa.array([shape(t) for t in texts], pa.list_(pa.float64())), pa.array(found, pa.map_(pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["q", "t", "shape", "words"])

    got = rows.mapInArrow(run, "q int, t int, shape array<double>, words map<int,double>").toArrow()
    k = len(shape(b""))
    if not got.num_rows:
        return Classifier(np.zeros(k), np.ones(k), np.r_[np.zeros(2 * k), 2.0], np.array([], dtype=np.int64), np.array([-2.0]))
    m = np.zeros((got.num_rows, len(chosen)))
    for i, found in enumerate(got["words"].to_pylist()):
        for f, w in found:
            m[i, f] = w
    flat = got["shape"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return fit(got["q"].to_numpy().astype(float), got["t"].to_numpy().astype(float), flat, chosen, m)


def with_evidence(docs: DataFrame, model: Classifier, *, text_col: str = "text", quality: str = "__quality", toxic: str = "__toxic", keep_text: bool = True) -> DataFrame:
    """All columns of ``docs``, the text only if wanted, and the log odds of the text alone in two more; stored, so that each
    text is scored once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights
    names = [c for c in docs.columns if keep_text or c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = [sent.value.log_odds(t) for t in texts_of(batch, text_col)]
            cols = [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array([q for q, _ in odds], pa.float64()), pa.array([t for _, t in odds], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, quality, toxic])

    schema = docs.select(*(f"`{c}`" for c in names)).schema.add(quality, "double").add(toxic, "double")
    out = stored(docs.mapInArrow(run, schema), "evidence")
    sent.unpersist()
    return out


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(rates: DataFrame, k: str, n: str, above: str) -> Column:
    """Prior weight, in rows, from the spread of group rates around the level above: method of moments, between 1 and 10,000."""
    r = F.col(k) / F.col(n)
    w = F.sum(n)
    spread = F.sum(F.col(n) * F.pow(r - F.col(above), 2)) / w
    noise = F.sum(F.col(above) * (1 - F.col(above))) / w
    inner = F.sum(F.col(n) * F.col(above) * (1 - F.col(above))) / w
    return F.greatest(F.lit(1.0), F.least(F.lit(10_000.0), inner / F.greatest(spread - noise, F.lit(1e-9))))


def site_posteriors(evidence: DataFrame, *, columns: tuple[str, ...] = ("__quality", "__toxic")) -> DataFrame:
    """``(host, path, ...)`` with each column's host and path posterior rate and the global rate, from ``evidence(host, path, ...)``.

    All rows count, each with its own probability. Sums are taken before the shuffle, so a hot host is one row of each task.
    """
    sums = [F.sum(sigmoid(F.col(c))).alias(f"{c}_k") for c in columns]
    paths = stored(evidence.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), *sums), "sites")
    out = paths
    total = paths.agg(F.sum("n").alias("n"), *(F.sum(f"{c}_k").alias(f"{c}_k") for c in columns)).first()
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *(F.sum(f"{c}_k").alias(f"{c}_hk") for c in columns))
    out = out.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    for c in columns:
        n = total["n"] or 0.0
        rate = min(1 - 1e-4, max(1e-4, (total[f"{c}_k"] or 0.0) / n)) if n else 0.5
        hosts = hosts.withColumn("above", F.lit(rate))
        weight = hosts.agg(_strength(hosts, f"{c}_hk", "host_n", "above").alias("w")).first()["w"] or 1.0
        out = out.withColumn(f"{c}_host", (F.col(f"{c}_hk") + weight * rate) / (F.col("host_n") + weight))
        weight = out.agg(_strength(out, f"{c}_k", "n", f"{c}_host").alias("w")).first()["w"] or 1.0
        out = out.withColumn(f"{c}_path", (F.col(f"{c}_k") + weight * F.col(f"{c}_host")) / (F.col("n") + weight)).withColumn(f"{c}_rate", F.lit(rate))
    keep = [f"{c}_{x}" for c in columns for x in ("host", "path", "rate")]
    return stored(out.select("host", "path", *keep), "site-posteriors")


def judged(docs: DataFrame, labels: DataFrame, *, model: Classifier | None = None, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """All columns of ``docs``, without the text if so wanted, and, under names that start with ``__``, the evidence, the
    posteriors and ``__keep``. No column of ``docs`` may start so.

    ``host`` and ``path`` default to the columns ``source`` and ``lang``. Null sites are a site like any other. Null text
    counts as empty. Kept: rows whose quality is likelier than not and whose toxicity is not. Texts are scored once, into a
    stored table; sites' sums and the join of their posteriors read that.
    """
    model = model or train(docs, labels, id_col=id_col, text_col=text_col)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    placed = docs.withColumns({"__host": host.cast("string"), "__path": path.cast("string")})
    rows = with_evidence(placed, model, text_col=text_col, keep_text=keep_text)
    sites = site_posteriors(rows.select(F.col("__host").alias("host"), F.col("__path").alias("path"), "__quality", "__toxic"))
    sites = sites.withColumnsRenamed({"host": "__h", "path": "__p"})
    if sites.count() <= SITES_BROADCAST:
        sites = F.broadcast(sites)
    both = rows.join(sites, F.col("__host").eqNullSafe(F.col("__h")) & F.col("__path").eqNullSafe(F.col("__p")), "left")
    for c in ("__quality", "__toxic"):
        site = logit(F.col(f"{c}_path")) - logit(F.col(f"{c}_rate"))
        both = both.withColumn(f"{c}_posterior", sigmoid(F.col(c) + site))
    return both.withColumn("__keep", (F.col("__quality_posterior") >= 0.5) & (F.col("__toxic_posterior") < 0.5)).drop("__h", "__p")


def kept(docs: DataFrame, labels: DataFrame, **what: object) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with their columns, whatever these are called."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    columns = {"text_col": names["text"], "id_col": names["doc_id"], "host": F.col(names["source"]), "path": F.col(names["lang"])}
    rows = judged(docs.toDF(*names.values()), labels, **columns, **what)
    return rows.where("__keep").select(*(F.col(new).alias(old) for old, new in names.items()))


def quality_scores(docs: DataFrame, labels: DataFrame, *, model: Classifier | None = None, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: ``(id, quality, toxic, doc_quality, doc_toxic, host_quality, path_quality, keep)``, probabilities all.

    Rows with null or repeated ids are judged each by itself; an empty table gives no rows; without labels everything that
    is not toxic by the prior is kept. Other columns are not used.
    """
    model = model or train(docs, labels, id_col=id_col, text_col=text_col)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    used = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    rows = judged(used, labels, model=model, host=F.col("host"), path=F.col("path"), keep_text=False)
    return rows.select(
        F.col("id").alias(id_col), F.col("__quality_posterior").alias("quality"), F.col("__toxic_posterior").alias("toxic"), sigmoid(F.col("__quality")).alias("doc_quality"),
        sigmoid(F.col("__toxic")).alias("doc_toxic"), F.col("__quality_host").alias("host_quality"), F.col("__quality_path").alias("path_quality"), F.col("__keep").alias("keep"),
    )
