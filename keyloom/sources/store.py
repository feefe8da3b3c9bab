"""Small files and folders through Hadoop's file systems, so that a catalog may lie wherever Spark can write."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..errors import MissingError


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> bytes:
        if not self.exists(name):
            raise MissingError(f"{name} isn't stored")
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
        finally:
            stream.close()

    def _rename(self, beside: str, name: str, over: bool) -> None:
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        array = self.spark.sparkContext._gateway.new_array(kind, 1)
        array[0] = kind.OVERWRITE if over else kind.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(self._path(beside)), self._fs.makeQualified(self._path(name)), array)

    def _beside(self, name: str, data: bytes) -> str:
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._path(beside), True)
        try:
            stream.write(data)
        finally:
            stream.close()
        return beside

    def write(self, name: str, data: bytes) -> None:
        """Write a file whole or not at all: beside its place first, then renamed over it."""
        self._rename(self._beside(name, data), name, True)

    def publish(self, name: str, data: bytes) -> bool:
        """Write a file that doesn't exist yet, whole; False if it does. Of several writers one succeeds."""
        from py4j.protocol import Py4JJavaError

        if self.exists(name):
            return False
        beside = self._beside(name, data)
        try:
            self._rename(beside, name, False)
        except Py4JJavaError as e:
            self.delete(beside)
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if not s.getPath().getName().endswith((".crc", ".tmp")))

    def files(self, folder: str) -> dict[str, int]:
        """Every file below a folder, by its name from the root, with its size."""
        out, todo = {}, [folder]
        while todo:
            f = todo.pop()
            if self.exists(f):
                for s in self._fs.listStatus(self._path(f)):
                    name = f"{f}/{s.getPath().getName()}" if f else s.getPath().getName()
                    if s.isDirectory():
                        todo.append(name)
                    elif not name.endswith((".crc", ".tmp")):
                        out[name] = s.getLen()
        return out
