"""Connected components of an edge table, without collecting it: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import discard, stored


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    row = edges.agg(F.count("*").alias("n"), F.sum(h).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node of its component.

    In each step a node links what it sees to the smallest node that it sees: only minima per node are grouped, which
    Spark sums up before the shuffle, and the join on a hub's id is one that Spark can split. Steps needed grow with the
    logarithm of the number of nodes. Empty input: empty output.
    """
    now = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    while before[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        last, now = now, stored(small, "edges")
        discard(last)
        after = _state(now)
        if after == before:
            break
        before = after
    # converged: every edge leads from a root to a node of its component
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
