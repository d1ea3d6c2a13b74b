"""Documents to training sequences in five stages: quality, near-duplicates, benchmark passages, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last keep the columns of documents. Null
texts count as empty throughout. Rows with null or equal ids are rows of their own. An empty table passes as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, near, packing, quality, secrets
from tidelog.llm.common import load, remove_at_exit, scratch, stored, work_root
from tidelog.llm.tokens import public_path

VOCABULARY = "word_bpe_49k.json"


ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows stored with a number, which names a row whatever its id is."""
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    return rows.join(near.bounded(gone.select(F.col("row").alias(ROW))), ROW, "left_anti").drop(ROW)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the rows that the quality classifier does not reject; labels and the training rows come from the input folder."""
    labels = load(spark, sf_dir, "labels")
    model = quality.train(load(spark, sf_dir, "documents"), labels)
    return quality.kept(docs, labels, model=model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: that of the smallest id, a row without an id only if no row has one.

    Rows link if their texts share 0.8 of their five-word shingles (Jaccard), each link checked on the whole shingle sets;
    groups are the connected components. Candidates come from operator 9, by SimHash fingerprints and its index; parts that it
    leaves unjoined, since fingerprints miss some such pairs, are sought in bands of minimum hashes. Exactly the rows that were
    judged go, by their row number.
    """
    rows = _numbered(docs)
    return _without(rows, near.surplus(rows, row_col=ROW))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows in which ten consecutive words of a benchmark item stand, and no other row of their id."""
    rows = _numbered(docs)
    found = decontaminate.contamination(rows.select(ROW, "text"), load(spark, sf_dir, "benchmark"), id_col=ROW)
    return _without(rows, found.where("contaminated").select(F.col(ROW).alias("row")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mask; no row goes. ``n_chars`` follows the text where it changes."""
    model = secrets.train(docs)
    rows = secrets.with_spans(docs, model)
    text = secrets.redacted(F.col("text"), F.col("__spans"))
    names = {"text": text}
    if "n_chars" in docs.columns:
        names["n_chars"] = F.when(F.size("__spans") > 0, F.length(text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*(names[c].alias(c) if c in names else f"`{c}`" for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary=public_path(VOCABULARY))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = load(spark, sf_dir, "documents")
    base = f"{work_root(spark)}/tidelog/pipeline-{uuid.uuid4().hex}"
    remove_at_exit(spark, base)
    for name, stage in STAGES:
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{base}/{name}")
    return docs
