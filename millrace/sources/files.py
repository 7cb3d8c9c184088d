"""Small files on any file system that Spark reaches, through Hadoop's API."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _fs(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def exists(self, name: str) -> bool:
        return self._fs(name).exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self._fs(name).open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, new: bool = False) -> bool:
        """Write a file whole: to a temporary name, then renamed.

        ``new``: False if it is there already, decided by one atomic step: a hard link on a local disk, else a
        create that may not overwrite (atomic on HDFS, and on stores that have conditional writes).
        """
        fs, final = self._fs(name), self.path(name)
        local = final.toUri().getScheme() in (None, "file") and fs.getUri().getScheme() == "file"
        if new and not local:
            try:
                stream = fs.create(final, False)
            except Py4JJavaError as error:
                if "Exist" in error.java_exception.getClass().getSimpleName():
                    return False
                raise
            stream.write(bytearray(text.encode()))
            stream.close()
            return True
        temporary = self.path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(temporary, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if new:
            try:
                os.link(temporary.toUri().getPath(), final.toUri().getPath())
                return True
            except FileExistsError:
                return False
            finally:
                fs.delete(temporary, False)
        fs.delete(final, False)
        return fs.rename(temporary, final)

    def move(self, name: str, to: str) -> None:
        self._fs(name).rename(self.path(name), self.path(to))

    def list(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs(name).listStatus(self.path(name)))

    def delete(self, name: str) -> None:
        self._fs(name).delete(self.path(name), True)

    def make(self, name: str) -> None:
        self._fs(name).mkdirs(self.path(name))
