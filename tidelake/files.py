"""Files of a data directory, through Hadoop's file systems: local, HDFS or a store."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Where all of a session's executors can read what others wrote: ``spark.checkpoint.dir``, or on one machine a temporary folder if that is not set."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found
    if not context.master.startswith("local"):
        raise ValueError("the session has no spark.checkpoint.dir: set it to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "tidelake-checkpoints")


class Files:
    """Paths are relative to ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.to_path = self.jvm.org.apache.hadoop.fs.Path  # looked up once: that takes several calls
        self.fs = self.to_path(root).getFileSystem(self.conf)
        self.fs.setVerifyChecksum(False)
        self.fs.setWriteChecksum(False)
        self.root = self.fs.makeQualified(self.to_path(root)).toString()

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *[p for p in parts if p]])

    def _at(self, *parts: str):
        # Built from a URI with a quoted path, so that names keep their characters.
        return self.to_path(self.path(*parts))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self._at(*parts))

    def mkdirs(self, *parts: str) -> None:
        self.fs.mkdirs(self._at(*parts))

    def names(self, *parts: str) -> list[str]:
        """Names in a directory, in order; none if it is not there."""
        if not self.exists(*parts):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(*parts)))

    def walk(self, *parts: str) -> list[str]:
        """Relative paths of all files below, in order; one listing."""
        if not self.exists(*parts):
            return []
        found, listing = [], self.fs.listFiles(self._at(*parts), True)
        while listing.hasNext():
            found.append(listing.next().getPath().toString())
        top = self.fs.makeQualified(self._at()).toString().rstrip("/") + "/"
        return sorted(f.removeprefix(top) for f in found)

    def bytes_in(self, *parts: str) -> int:
        return self.fs.getContentSummary(self._at(*parts)).getLength() if self.exists(*parts) else 0

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self._at(*parts))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read_if_there(self, *parts: str) -> str | None:
        """The text of a file, or None if it is not there, or no longer."""
        try:
            return self.read(*parts) if self.exists(*parts) else None
        except Py4JJavaError:
            if self.exists(*parts):
                return self.read(*parts)
            return None

    def modified(self, *parts: str) -> float | None:
        """Seconds since 1970 at which a file was written last, or None if it is not there."""
        try:
            return self.fs.getFileStatus(self._at(*parts)).getModificationTime() / 1000
        except Py4JJavaError:
            return None

    def write(self, text: str, *parts: str) -> None:
        stream = self.fs.create(self._at(*parts), True)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync() if hasattr(stream, "hsync") else None
        finally:
            stream.close()

    def create(self, text: str, *parts: str) -> bool:
        """Writes a file unless it is there; whether it was written. The file system decides, so only one of several callers succeeds."""
        try:
            stream = self.fs.create(self._at(*parts), False)
        except Exception:
            if self.exists(*parts):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def move(self, source: str, target: str) -> None:
        """rename() where the caller knows that the target is not there."""
        if not self.fs.rename(self._at(source), self._at(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def rename(self, source: str, target: str) -> None:
        """Fails if the target is there or the source is not."""
        if self.exists(target) or not self.fs.rename(self._at(source), self._at(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def replace(self, target: str, text: str) -> None:
        """Writes a file aside and puts it in place of the old one, in one step."""
        aside = f"{target}.{uuid.uuid4().hex}.tmp"
        self.write(text, aside)
        option = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.jvm.java.lang.reflect.Array.newInstance(option.getClass(), 1)
        options[0] = option
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self._at(aside), self._at(target), options)

    def delete(self, *parts: str) -> None:
        self.fs.delete(self._at(*parts), True)
