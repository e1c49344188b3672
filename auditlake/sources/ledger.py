"""What is finished below a folder: one small file per batch, created exclusively and last.

Readers ask the ledger which batches exist, so a batch that was cut short is invisible and is simply run again, and an object
made anew on the same folder (a restart) finds everything that was finished before.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


class Ledger:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _path(self, name: str = "") -> tuple:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The finished batches in order; one listing."""
        path, fs = self._path()
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit() and s.getLen()) if fs.exists(path) else []

    def note(self, number: int) -> str:
        path, fs = self._path(f"{number:012d}")
        stream = fs.open(path)
        try:
            return str(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def add(self, number: int, note: str = "done") -> bool:
        """Finish a batch; false if it was finished before, by whomever. The creation is exclusive (compare and set)."""
        path, fs = self._path(f"{number:012d}")
        if fs.exists(path) and fs.getFileStatus(path).getLen():
            return False
        if fs.exists(path):  # cut short between creation and content
            fs.delete(path, False)
        try:
            stream = fs.create(path, False)
        except Exception:  # noqa: BLE001 - another process was first
            return False
        try:
            stream.write(bytearray(note.encode() or b"-"))
        finally:
            stream.close()
        return True
