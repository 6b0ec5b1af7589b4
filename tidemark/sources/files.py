"""Files of a database on any file system that Spark can reach (through Hadoop's FileSystem)."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Age at which the claim of a commit that never came is void.
CLAIM_SECONDS = 600


class Files:
    """Paths are relative to ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def full(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """The file with its whole text, or nothing: False if it is there already, or another writer is about to make it.

        A claim, which only one writer can create, comes first; the text is written aside under a name of its own and then
        gets its name. A claim whose writer has died holds others up for ``CLAIM_SECONDS``.
        """
        claim = f"{name}.claim"
        if self.exists(name) or not (self._claimed(claim) or self._abandoned(claim) and self._claimed(claim)):
            return False
        staged = f"{name}.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(staged), False)
        out.write(bytearray(text.encode()))
        out.close()
        done = not self.exists(name) and self._fs.rename(self._path(staged), self._path(name))
        if not done:
            self.delete(staged)
        self.delete(claim)
        return done

    def _claimed(self, name: str) -> bool:
        path = self._path(name)
        if self._fs.getScheme() == "file":  # Hadoop's local files know no exclusive creation
            local = path.toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                os.close(os.open(local, os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            self._fs.create(path, False).close()
        except Py4JJavaError:
            if self.exists(name):
                return False
            raise
        return True

    def _abandoned(self, claim: str) -> bool:
        """Whether the claim is so old that its writer must be dead; then it is removed."""
        old = self.exists(claim) and time.time() - self._fs.getFileStatus(self._path(claim)).getModificationTime() / 1000 > CLAIM_SECONDS
        if old:
            self.delete(claim)
        return old


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="tidemark-")
