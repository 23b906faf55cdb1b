"""Numbered manifests in a folder: what a set of files currently consists of, replaced as a whole and last."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifests:
    """The newest of `path`/NNNNNNNNNN.json is the current state; a state exists from the moment its file has its name.

    A commit writes its file under another name and renames it, which fails where that number is taken: of two writers
    that began from the same state one is refused.  The file system must rename atomically and not over files (as HDFS
    and local ones do).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str = ""):  # noqa: ANN202
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def read(self) -> tuple[int, dict]:
        """(number, state) of the newest manifest; (0, {}) where there is none yet."""
        fs, at = self._at()
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, {}
        number = max(numbers)
        fs, at = self._at(f"{number:010d}.json")
        source = fs.open(at)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()
        return number, json.loads(text)

    def commit(self, after: int, state: dict) -> int:
        """Make state the one that follows manifest number `after`."""
        fs, at = self._at(f"{after + 1:010d}.json")
        _, draft = self._at(f"{after + 1:010d}.{self.spark._jvm.java.util.UUID.randomUUID().toString()}.draft")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(state), "utf-8"))
        finally:
            out.close()
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise RuntimeError(f"{self.path}: another writer made state {after + 1}")
        for old in range(max(after - 8, 1), after - 7):  # some states back are kept for readers that began with them
            fs.delete(self._at(f"{old:010d}.json")[1], False)
        return after + 1


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
