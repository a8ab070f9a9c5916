"""The few file operations that commits need, on whatever store Hadoop knows."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import SparkSession


class CommitTaken(RuntimeError):
    """Another writer has made the commit first."""


class Files:
    """Files and folders below a root."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.getUri().getScheme() == "file"
        self._io = jvm.org.apache.commons.io.IOUtils

    def _plain(self, path: str) -> str:
        return self._path(path).toUri().getPath()

    def create(self, path: str, text: str) -> None:
        """Create a file that doesn't exist, or raise ``CommitTaken``."""
        if self.local:
            os.makedirs(os.path.dirname(self._plain(path)), exist_ok=True)
            temp = f"{self._plain(path)}.{uuid.uuid4().hex}"
            with open(temp, "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(temp, self._plain(path))  # fails where the name is taken; the content is whole
            except FileExistsError as e:
                raise CommitTaken(path) from e
            finally:
                os.unlink(temp)
            return
        try:
            out = self.fs.create(self._path(path), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise CommitTaken(path) from e
            raise
        out.write(text.encode())
        out.close()

    def read(self, path: str) -> str:
        if self.local:
            with open(self._plain(path)) as f:
                return f.read()
        stream = self.fs.open(self._path(path))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        where = self._path(folder)
        if not self.fs.exists(where):
            return []
        return sorted(x.getPath().getName() for x in self.fs.listStatus(where))

    def age(self, folder: str) -> float:
        """Seconds since something was put into a folder."""
        return time.time() - self.fs.getFileStatus(self._path(folder)).getModificationTime() / 1000

    def remove(self, path: str) -> None:
        """Remove a file or folder, if it is there."""
        self.fs.delete(self._path(path), True)
