"""Small files in any store Spark reaches, by Hadoop's file API on the driver."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """One folder; ``create`` never replaces a file, so of two writers of one name a single one succeeds.

    That holds where a rename fails for a name that is taken (HDFS and the like).
    """

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._array = spark.sparkContext._gateway.new_array
        self._conf = spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        """Files and folders in it, sorted; none where it does not exist."""
        if not self._fs.exists(self._at("")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("")))

    def age_ms(self, name: str, now_ms: int) -> int:
        return now_ms - self._fs.getFileStatus(self._at(name)).getModificationTime()

    def newest_ms(self, name: str) -> int:
        """When something in a folder, or right below a folder in it, was last written."""
        latest = 0
        for status in (self._fs.getFileStatus(self._at(name)), *self._fs.listStatus(self._at(name))):
            latest = max(latest, status.getModificationTime())
            if status.isDirectory():
                latest = max([latest, *[s.getModificationTime() for s in self._fs.listStatus(status.getPath())]])
        return latest

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes the whole file, or nothing: False where the name is taken."""
        draft = self._at(f".{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft)
        stream.write(bytearray(text.encode()))
        stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options
        none = self._array(options.Rename, 1)
        none[0] = options.Rename.NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._at(name)), none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self._fs.delete(draft, False)
            return False

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def n_bytes(self, name: str = "") -> int:
        return self._fs.getContentSummary(self._at(name)).getLength() if self._fs.exists(self._at(name)) else 0
