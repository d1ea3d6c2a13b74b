"""Small file operations through Hadoop's FileSystem, so that tables may lie wherever Spark can write."""

from __future__ import annotations

import os
import tempfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from tidelog.errors import CommitConflictError


def scratch_root(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: that of ``spark.checkpoint.dir``, in local mode a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or f"file://{os.path.join(tempfile.gettempdir(), 'tidelog-work')}").rstrip("/")


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def exists(self, p: str) -> bool:
        return self.fs.exists(self.path(p))

    def names(self, p: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(p))) if self.exists(p) else []

    def read(self, p: str) -> str:
        stream = self.fs.open(self.path(p))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, p: str, text: str) -> None:
        """Publish a file that must not be there yet: written aside, then renamed, which one writer alone can do."""
        aside = f"{p}.{self.jvm.java.util.UUID.randomUUID().toString()}.tmp"
        stream = self.fs.create(self.path(aside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self._move_new(self.path(aside), self.path(p))
        except Py4JJavaError as e:
            raise CommitConflictError(p) from e
        finally:
            self.delete(aside)

    def _move_new(self, source: object, target: object) -> None:
        """Rename that fails if the target is there. A local rename would replace it, so there the new name is a link, which the
        system makes only where nothing stands; elsewhere it is the file system's rename without overwriting."""
        uri = self.fs.makeQualified(target).toUri()
        if uri.getScheme() == "file":
            link = self.jvm.java.nio.file.Files.createLink
            link(self.jvm.java.io.File(uri.getPath()).toPath(), self.jvm.java.io.File(self.fs.makeQualified(source).toUri().getPath()).toPath())
            return
        kind = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(kind, 0)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, self.conf).rename(self.fs.makeQualified(source), self.fs.makeQualified(target), options)

    def delete(self, p: str) -> None:
        self.fs.delete(self.path(p), True)

    def copy(self, source: str, target: str) -> None:
        to = self.path(target).getFileSystem(self.conf)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path(source), to, self.path(target), False, True, self.conf)
