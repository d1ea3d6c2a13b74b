"""Secret scans in DataFrame operations only: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order models over the token alphabet are trained from labelled samples: random strings (values that the fixed
patterns found in the documents, and a generated sample) and ordinary identifiers (words of a hash sample of the
documents, joined the ways identifiers are). A token whose letters are far likelier under the first is a span of kind
``markov``, unless it overlaps a span of a fixed pattern.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns of the kinds, in the order in which spans at one place are listed.
PATTERNS = {
    "assign": "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{16,}()",
    "hex": "[0-9a-f]{24,}()",
}
KINDS = [*PATTERNS, "markov"]
#: Letters that tokens consist of.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Rows of documents, and generated strings, that the models are trained on, at most about.
SAMPLE_DOCS, SAMPLE_STRINGS = 2000, 4000
#: A token is random if its log-likelihood ratio is at least this, and at least this for each letter.
RATIO, RATIO_EACH = 12.0, 0.25
#: Matches whose spans are gathered at a time; see ``_placed``.
TOGETHER = 256
MASK = "[SECRET]"
SPAN = "struct<start:int,kind:int,stop:int>"


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of letter pairs, row by row over the alphabet."""

    ratios: tuple[float, ...]

    @property
    def shortest(self) -> int:
        """Fewest letters that a token must have to be random, by the highest ratio of any pair."""
        most = max(self.ratios)
        return next((n for n in range(2, 1000) if (n - 1) * most >= max(RATIO, RATIO_EACH * n)), 1000)

    def column(self) -> Column:
        return F.split(F.lit(",".join(f"{x:.4f}" for x in self.ratios)), ",").cast("array<double>")


def found(text: Column, pattern: str, kind: str, good: Callable[[Column, Column], Column]) -> Column:
    """Leftmost non-overlapping matches as spans, in code points, of which ``good(match, group)`` is true."""
    # the text before each match is matched too, so that lengths add up to places; the end stops the last search at once
    whole = F.lit(f"(?s)(.*?)(?:({pattern})|\\z)")
    before, match, value = (F.regexp_extract_all(text, whole, F.lit(i)) for i in (1, 2, 3))
    three = F.arrays_zip(before.alias("b"), match.alias("m"), value.alias("v"))
    measured = F.transform(three, lambda x: F.struct(F.length(x["b"]).alias("b"), F.length(x["m"]).alias("m"), ((F.length(x["m"]) > 0) & good(x["m"], x["v"])).alias("good")))
    return F.when(F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False)), _placed(measured, KINDS.index(kind))).otherwise(F.array().cast(f"array<{SPAN}>"))


def _placed(measured: Column, kind: int) -> Column:
    """Spans of the good ones of ``array<struct<b, m, good>>``, by the lengths before them. Spark copies what an aggregate has
    gathered at each step, so it gathers ``TOGETHER`` at a time and then the groups, or many spans would cost their square."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def span(low: Column, high: Column) -> Column:
        return F.struct(low.alias("start"), F.lit(kind).alias("kind"), high.alias("stop"))

    def add(acc: Column, x: Column) -> Column:
        low = acc["at"] + x["b"]
        high = low + x["m"]
        return F.struct(high.alias("at"), F.when(x["good"], F.array_append(acc["spans"], span(low, high))).otherwise(acc["spans"]).alias("spans"))

    def join(acc: Column, x: Column) -> Column:
        moved = F.transform(x["spans"], lambda s: span(acc["at"] + s["start"], acc["at"] + s["stop"]))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    def all_of(x: Column) -> Column:
        groups = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x["all"]) - 1) / TOGETHER)).cast("int"))
        return F.aggregate(F.transform(groups, lambda i: F.aggregate(F.slice(x["all"], i * TOGETHER + 1, F.lit(TOGETHER)), start, add)), start, join, lambda acc: acc["spans"])

    # as a part of one value, the array is made once; named in the lambda it would be made for every group
    return F.transform(F.array(F.struct(measured.alias("all"))), all_of)[0]


def base_spans(text: Column) -> Column:
    parts = [found(text, p, kind, (lambda m, v: F.length(v) >= 6) if kind == "assign" else (lambda m, v: F.lit(True))) for kind, p in PATTERNS.items()]
    return F.array_sort(F.concat(*parts))


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of letter pairs of ``strings(s)``: ``(pair, n)``; at most one row for each pair of the alphabet."""
    pair = F.explode(F.regexp_extract_all(F.col("s"), F.lit("(?s)(?=(..))"), F.lit(1))).alias("pair")
    return strings.select(pair).groupBy("pair").agg(F.count("*").alias("n"))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit both models. Only counts of letter pairs, of which there are few, come to the driver."""
    spark: SparkSession = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.select(id_col).count()
    chosen = docs.where(F.expr(f"pmod(xxhash64({id_col}), {max(1, total // SAMPLE_DOCS)}) = 0")).select(text.alias("text"))

    kept = F.transform(base_spans(F.col("text")), lambda s: F.substr("text", s["start"] + 1, s["stop"] - s["start"]))
    labelled = chosen.select(F.explode(kept).alias("s")).select(F.regexp_replace("s", "^.*[^A-Za-z0-9+/_=-]", "").alias("s"))
    h = F.sha2(F.col("id").cast("string"), 256)
    made = [h, F.substr(h, F.lit(1), F.lit(32)), F.base64(F.unhex(h)), F.upper(F.substr(F.base64(F.unhex(h)), F.lit(1), F.lit(20))), F.regexp_replace(F.base64(F.unhex(h)), "[+/=]", "")]
    strings = spark.range(SAMPLE_STRINGS // len(made)).select(F.explode(F.array(*made)).alias("s"))
    random = {r["pair"]: r["n"] for r in _pairs(labelled.union(strings)).collect()}

    words = F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]{2,}"), F.lit(0))
    base = chosen.select(words.alias("w")).where(F.size("w") > 2)
    triple = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.slice("w", i + 1, F.lit(3)))
    three = base.select(F.explode(triple).alias("w"))
    shape = F.abs(F.xxhash64("w")) % 8
    joined = [F.array_join("w", c) for c in ("_", "-", "/", "")] + [F.array_join(F.transform("w", F.initcap), ""), F.upper(F.array_join("w", "_"))]
    joined += [F.concat(F.array_join("w", "_"), (F.abs(F.xxhash64("w")) % 100).cast("string")), F.array_join("w", "=")]
    case = F.when(shape == 0, joined[0])
    for i, c in enumerate(joined[1:], 1):
        case = case.when(shape == i, c)
    # words by themselves, whole numbers and dates are ordinary, too
    single = base.select(F.explode("w").alias("s"))
    numbers = spark.range(SAMPLE_STRINGS).select(F.substr(F.conv(F.substr(h, F.lit(1), F.lit(15)), 16, 10), F.lit(1), 4 + F.col("id") % 12).alias("s"))
    dates = spark.range(SAMPLE_STRINGS // 8).select(F.date_format(F.timestamp_seconds(F.col("id") * 3_333_333), "yyyy-MM-dd'T'HH").alias("s"))
    ordinary = {r["pair"]: r["n"] for r in _pairs(three.select(case.alias("s")).union(single).union(numbers).union(dates)).collect()}

    def log_p(counts: dict[str, int]) -> list[float]:
        out = []
        for a in ALPHABET:
            row = [counts.get(a + b, 0) + 0.5 for b in ALPHABET]
            out += [math.log(x / sum(row)) for x in row]
        return out

    ratios = [a - b for a, b in zip(log_p(random), log_p(ordinary), strict=True)]
    for i in range(len(ALPHABET)):  # a letter that goes on and on, as in rulers, is no sign of chance
        ratios[i * len(ALPHABET) + i] = min(0.0, ratios[i * len(ALPHABET) + i])
    return Model(tuple(ratios))


def log_ratio(token: Column, model: Model) -> Column:
    """Log-likelihood ratio of a token's letters, random against ordinary, given its first; one pass over its letters."""
    n = len(ALPHABET)
    table, letters = model.column(), F.lit(ALPHABET)

    def step(acc: Column, letter: Column) -> Column:
        code = F.instr(letters, letter)
        ratio = F.when(acc["last"] == 0, 0.0).otherwise(F.get(table, (acc["last"] - 1) * n + code - 1))
        return F.struct(code.alias("last"), (acc["sum"] + ratio).alias("sum"))

    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0)), start, step, lambda acc: acc["sum"])


def all_spans(text: Column, base: Column, model: Model) -> Column:
    """Base spans and those that the models add, by place, then kind."""
    token = f"[A-Za-z0-9+/_=-]{{{model.shortest},}}()"
    random = found(text, token, "markov", lambda m, v: log_ratio(m, model) >= F.greatest(F.lit(RATIO), RATIO_EACH * F.length(m)))
    # both lists are made once, as parts of one value; inside a lambda they would be made for every span
    both = F.array(F.struct(base.alias("base"), random.alias("random")))
    clear = lambda x: F.filter(x["random"], lambda s: ~F.exists(x["base"], lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return F.transform(both, lambda x: F.array_sort(F.concat(x["base"], clear(x))))[0]


def with_spans(docs: DataFrame, model: Model, *, text_col: str = "text", base: str = "__base", spans: str = "__spans") -> DataFrame:
    """``docs`` and its spans in two columns: those of the fixed patterns, and all."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn(base, base_spans(text)).withColumn(spans, all_spans(text, F.col(base), model))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_scan(docs: DataFrame, *, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: ``(id, n_assign, n_access, n_hex, base_sha256, spans, n_markov)``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind. Null and empty texts have none: counts
    0, an empty list and the digest of the empty string. Null and repeated ids stay as they are; an empty table gives no
    rows; other columns are not read. No shuffle: a row is scanned where it is read.
    """
    model = model or train(docs, id_col=id_col, text_col=text_col)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = with_spans(picked, model)
    kind = lambda k, spans="__base": F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(k))).cast("long")
    return rows.select(
        F.col("id").alias(id_col), *(kind(k).alias(f"n_{k}") for k in PATTERNS), F.sha2(_listed(F.col("__base")), 256).alias("base_sha256"),
        _listed(F.col("__spans")).alias("spans"), kind("markov", "__spans").alias("n_markov"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch of overlapping spans replaced by one mask."""
    out = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.struct(F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK)).alias("out"), s["stop"].alias("at"))
        more = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))
        return F.when((s["start"] >= acc["at"]), fresh).otherwise(more)

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, out, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text)))))
