"""Small files of any Hadoop file system, as the driver sees them: local folders, clusters and object stores alike."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder and the files directly in it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
        self._jvm, self._path = jvm, jvm.org.apache.hadoop.fs.Path
        root = self._path(path)
        self.fs = root.getFileSystem(conf)
        self.root = self.fs.makeQualified(root)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), conf)
        self._overwrite = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)  # noqa: SLF001
        self._overwrite[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE

    @property
    def uri(self) -> str:
        return self.root.toString()

    def at(self, name: str) -> str:
        return f"{self.uri}/{name}"

    def make(self) -> Folder:
        self.fs.mkdirs(self.root)
        return self

    def names(self) -> list[str]:
        """Names of the files and folders in it, sorted; none if it does not exist."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.root)) if self.fs.exists(self.root) else []

    def read(self, name: str) -> bytes | None:
        """The bytes of a file, ``None`` if there is none."""
        path = self._path(self.root, name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put(self, name: str, data: bytes) -> None:
        """Set the content of a file: readers see the old bytes or the new ones, whatever happens on the way."""
        fresh = self._path(self.root, f"_{uuid.uuid4().hex}")
        out = self.fs.create(fresh, False)
        try:
            out.write(data)
            out.hsync()
        finally:
            out.close()
        self._context.rename(fresh, self._path(self.root, name), self._overwrite)

    def move(self, old: str, new: str) -> bool:
        """Rename within the folder; whether it worked."""
        return bool(self.fs.rename(self._path(self.root, old), self._path(self.root, new)))

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(self.root, name), True)
