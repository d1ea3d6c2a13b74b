"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

The index holds a posting ``(row, position, term)`` for every document word that some benchmark item uses, written once to
the shared folder. A window of an item (``width`` consecutive words) is sought from its two rarest terms by the corpus
counts: the first one's postings, less its place in the item, give the places where the item could lie; the second one's
postings, less theirs, are intersected with those; what is left is intersected with the lists of all the window's other
terms. Consecutive item words that match at one place form runs, and runs as long as a window are exact occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import ascii_lower, stored

#: Between words: ASCII that is neither digit nor letter.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
#: Rows up to which a benchmark's small tables, or the rows found suspect, are broadcast; beyond it they are shuffled.
BROADCAST_ROWS = 1_000_000
#: Stands behind a document's last word in the index.
END = "\n"


def words_of(text: Column) -> Column:
    """Words of a text, letters as they are; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def lowered(word: Column) -> Column:
    """A-Z lowered: ``lower`` where it can do nothing else, which is the fast way for most words."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(ascii_lower(word))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def positional_index(docs: DataFrame, vocabulary: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Postings ``(row, pos, term)`` of the words in ``vocabulary(word, term)``; term 0 ends each row: its pos is the number
    of words, and only there ``doc`` is set."""
    terms = vocabulary.union(docs.sparkSession.createDataFrame([(END, 0)], "word string, term long"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    # the row's number comes before posexplode: in one select it would number the words
    words = rows.select("row", "doc", F.posexplode(F.concat(words_of(F.col("text")), F.array(F.lit(END)))).alias("pos", "word"))
    n = vocabulary.count()
    found = words.withColumn("word", lowered(F.col("word"))).join(_bounded(terms, n), "word")
    return stored(found.select("row", F.when(F.col("term") == 0, F.col("doc")).alias("doc"), "pos", "term"), "postings")


def occurrences(docs: DataFrame, items: DataFrame, *, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(index, runs)``: the index, and ``runs(row, item, first, last)`` of document word positions, both ends in, where at
    least ``width`` consecutive words of an item (all of a shorter item) stand."""
    listed = items.select(F.monotonically_increasing_id().alias("key"), F.col(item_col).alias("item"), F.transform(words_of(F.col(item_text)), lowered).alias("words"))
    listed = stored(listed.withColumn("n", F.size("words")).where("n > 0"), "items")
    used = listed.select(F.explode("words").alias("word")).distinct()
    vocabulary = stored(used.select("word", (F.monotonically_increasing_id() + 1).alias("term")), "vocabulary")
    index = positional_index(docs, vocabulary, id_col=id_col, text_col=text_col)

    counts = index.where("term > 0").groupBy("term").agg(F.count("*").alias("count"))
    placed = listed.select("key", "n", F.posexplode("words").alias("p", "word")).join(vocabulary, "word").drop("word")
    placed = stored(placed.join(counts, "term", "left"), "item-terms")
    w = F.lit(width)
    starts = F.expr(f"sequence(greatest(0, p - {width - 1}), least(p, greatest(0, n - {width})))")
    windows = placed.select("key", F.explode(starts).alias("s"), F.struct("count", "p", "term").alias("t"))
    windows = windows.groupBy("key", "s").agg(F.sort_array(F.collect_list("t")).alias("t"))  # width terms at most
    windows = windows.where(F.col("t")[0]["count"].isNotNull())  # nulls come first: a term that the corpus lacks
    pair = windows.select("key", "s", F.size("t").alias("k"), F.col("t")[0].alias("x"), F.coalesce(F.get("t", F.lit(1)), F.col("t")[0]).alias("y"))
    anchors = pair.groupBy("key", F.col("x.p").alias("p1"), F.col("x.term").alias("t1"), F.col("y.p").alias("p2"), F.col("y.term").alias("t2")).agg(
        F.min("s").alias("from"), F.max(F.col("s") + F.col("k") - 1).alias("to")
    )
    anchors = stored(anchors.withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    n_anchors = anchors.count()

    first = index.select("row", "pos", F.col("term").alias("t1")).join(_bounded(anchors.select("anchor", "t1", "p1", "p2", "t2"), n_anchors), "t1")
    first = first.select("row", "anchor", (F.col("pos") - F.col("p1")).alias("at"), (F.col("pos") - F.col("p1") + F.col("p2")).alias("pos"), F.col("t2").alias("term"))
    seconds = index.select("row", "pos", "term").join(_bounded(anchors.select(F.col("t2").alias("term")).distinct(), n_anchors), "term", "left_semi")
    near = stored(first.join(seconds, ["row", "pos", "term"]).select("row", "anchor", "at"), "candidates")

    suspect = near.select("row").distinct()
    rest = index.select("row", "pos", "term").join(_bounded(suspect, suspect.count()), "row", "left_semi")
    sought = near.join(_bounded(anchors.select("anchor", "key", "from", "to"), n_anchors), "anchor")
    sought = sought.select("row", "key", "at", F.explode(F.sequence("from", "to")).alias("p")).distinct()
    sought = sought.join(_bounded(placed.select("key", "p", "term", "n"), placed.count()), ["key", "p"])
    hits = sought.withColumn("pos", F.col("at") + F.col("p")).join(rest, ["row", "pos", "term"])
    by = W.partitionBy("row", "key", "at").orderBy("p")
    runs = hits.withColumn("run", F.col("p") - F.row_number().over(by)).groupBy("row", "key", "at", "run")
    runs = runs.agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("n").alias("n"))
    runs = runs.where(F.col("last") - F.col("first") + 1 >= F.least("n", w))
    named = runs.join(_bounded(listed.select("key", "item"), listed.count()), "key")
    return index, stored(named.select("row", "item", "first", "last"), "runs")


def contamination(docs: DataFrame, items: DataFrame, *, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row per input row: ``(id, n_words, n_hit, n_items, items_sha256, contaminated)``.

    ``n_hit`` counts words inside any occurrence, each once; the digest is of the ids of occurring items, each once, sorted
    as strings, joined by commas (of the empty string if there are none). Null or empty texts have no words; items without
    words occur nowhere; rows with equal ids stay apart; an item without an id hits words but is not listed. Without
    documents there are no rows. Other columns are not read.
    """
    index, runs = occurrences(docs, items, width=width, id_col=id_col, text_col=text_col, item_col=item_col, item_text=item_text)
    words = runs.select("row", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    which = runs.select("row", F.col("item").cast("string").alias("item")).distinct().groupBy("row")
    which = which.agg(F.count("item").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("listed"))
    rows = index.where("term = 0").select("row", F.col("doc").alias(id_col), F.col("pos").cast("long").alias("n_words"))
    out = rows.join(words, "row", "left").join(which, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("listed", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def proximity(docs: DataFrame, items: DataFrame, *, gap: int = 3, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Near matches: ``(id, item, first, last)`` where runs of one item lie at most ``gap`` other words apart, joined up.

    Exact runs of ``width`` words are the seeds; with small ``width`` this finds phrases with words put in, left out or
    replaced. A row per joined stretch.
    """
    index, runs = occurrences(docs, items, width=width, id_col=id_col, text_col=text_col, item_col=item_col, item_text=item_text)
    by = W.partitionBy("row", "item").orderBy("first", "last")
    before = F.max("last").over(by.rowsBetween(W.unboundedPreceding, -1))
    parts = runs.withColumn("new", F.coalesce((F.col("first") - before > gap + 1).cast("int"), F.lit(1))).withColumn("part", F.sum("new").over(by))
    joined = parts.groupBy("row", "item", "part").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    named = index.where("term = 0").select("row", F.col("doc").alias(id_col))
    return joined.join(named, "row").select(id_col, "item", "first", "last")
