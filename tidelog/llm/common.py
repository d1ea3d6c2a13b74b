"""Shared plumbing of the training-data operators: input tables, the shared work folder, Arrow loops."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Python task handles between two Arrow messages to the JVM.
OUT_ROWS = 20_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in local mode a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'tidelog-work')}"
    return root.rstrip("/")


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder when the driver's JVM ends, whether or not the session was stopped before."""
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)


_opened: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are ``stored`` inside go when the block ends: for blocks that write out what they have made."""
    _opened.append([])
    try:
        yield
    finally:
        for path in _opened.pop():
            remove(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing.

    The table is removed at the end of the ``scratch`` block around it, if there is one, else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{work_root(spark)}/tidelog/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _opened:
        _opened[-1].append(path)
    remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidelog_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a stored table that nothing will read again."""
    remove(df.sparkSession, df._tidelog_path)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def emit(rows: Iterable[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches of bounded size."""
    buffer: list[tuple] = []
    for row in rows:
        buffer.append(row)
        if len(buffer) >= size:
            yield _batch(buffer, schema)
            buffer = []
    if buffer:
        yield _batch(buffer, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


class Recent:
    """A worker's memory of what it has worked out, for words mostly: at most about ``2 * most`` entries.

    When the young generation is full it becomes the old one, which is forgotten when the next is full; an entry that is
    used again comes back to the young one. Frequent words stay, whatever the number of rare ones.
    """

    __slots__ = ("most", "old", "young")

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def unknown(self, keys: Iterable) -> list:
        """Which of the keys are to be worked out and ``put``; all others are in ``young`` until the next call."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = []
        for k in set(keys).difference(young):
            if k in old:
                young[k] = old[k]
            else:
                out.append(k)
        return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else: ``lower`` alone would also change other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

