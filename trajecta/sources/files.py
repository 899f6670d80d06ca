"""Small files and folders of numbered commits, through Spark's storage layer."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from trajecta.session import delete_folder


class Folder:
    """A folder as the storage layer sees it; paths are relative to it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _system(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        """Names in the folder, sorted; none if it is not there."""
        system, path = self._system(), self._path()
        return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []

    def exists(self, name: str) -> bool:
        return self._system().exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._system().open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a whole file under a name that nobody has taken; False if it is taken.

        Readers see all of it or nothing: it is written under another name and renamed.
        """
        system, draft = self._system(), self._path(f".{uuid.uuid4().hex}")
        stream = system.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not system.exists(self._path(name)) and system.rename(draft, self._path(name)):
            return True
        system.delete(draft, False)
        return False

    def delete(self, name: str) -> None:
        delete_folder(self.spark, f"{self.root}/{name}")

    def delete_if_empty(self, name: str) -> None:
        system, path = self._system(), self._path(name)
        if system.exists(path) and not system.listStatus(path):
            system.delete(path, False)
