"""Folders that count only once they are whole.

A folder is written beside its place under a name of its own, moved there, and marked
last by a small file.  What lacks the mark is an interrupted attempt: it is not read, and the
next write puts a whole folder in its place.  Names that begin with an underscore are passed
over by Spark's readers, so a committed folder is read like any other.

Moving is one operation on HDFS and local disks; on a store that copies instead, the mark
still comes after the last file.  All of it goes through Hadoop's file systems, so any path
that Spark can write will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MARK = "_COMMITTED"


class Folder:
    """A path and the file system that holds it."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self.fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self) -> bool:
        return self.fs.exists(self._at(self.path))

    def committed(self) -> bool:
        return self.fs.exists(self._at(f"{self.path}/{MARK}"))

    def marked_at(self) -> int | None:
        """When the folder was committed, in milliseconds."""
        return self.fs.getFileStatus(self._at(f"{self.path}/{MARK}")).getModificationTime() if self.committed() else None

    def delete(self, path: str | None = None) -> None:
        self.fs.delete(self._at(path or self.path), True)

    def write(self, fill: Callable[[str], None]) -> None:
        """``fill(folder)`` writes into a new folder, which then takes the place of this one.

        If it fails, what is at the place stays as it was."""
        staging = f"{self.path}.attempt-{uuid.uuid4().hex}"
        try:
            fill(staging)
            if self.exists():
                # first the mark: from here on the old content no longer counts
                self.delete(f"{self.path}/{MARK}")
                self.delete()
            parent = self._at(self.path).getParent()
            self.fs.mkdirs(parent)
            if not self.fs.rename(self._at(staging), self._at(self.path)):
                raise OSError(f"could not move {staging} to {self.path}")
        except BaseException:
            self.delete(staging)
            raise
        self.fs.create(self._at(f"{self.path}/{MARK}"), True).close()


def is_committed(spark: SparkSession, path: str) -> bool:
    return Folder(spark, path).committed()


def require_committed(spark: SparkSession, path: str) -> str:
    """The path, or an error where its write was never finished."""
    if not is_committed(spark, path):
        raise FileNotFoundError(f"{path} holds no committed data")
    return path


def write_committed(spark: SparkSession, path: str, fill: Callable[[str], None], *, replace: bool = False) -> bool:
    """Writes ``path`` by ``fill`` unless it is committed already; True when it wrote.

    ``replace`` writes in any case."""
    folder = Folder(spark, path)
    if folder.committed() and not replace:
        return False
    folder.write(fill)
    return True
