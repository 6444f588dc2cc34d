"""Numbered JSON files in a shared folder, each written once and whole: the newest tells what is live."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Manifests:
    """A history of small JSON objects. Data files come first, their manifest last, so readers never see half a version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, name: str):  # noqa: ANN202  a Hadoop path
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        folder = self._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self._conf)
        if not files.exists(folder):
            return []
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        path = self._at(f"{number:012d}.json")
        stream = path.getFileSystem(self._conf).open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict] | None:
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else None

    def publish(self, number: int, content: dict) -> bool:
        """Write the object under its number; False if another writer has taken it. A reader sees all of it or nothing."""
        draft, final = self._at(f".{uuid.uuid4().hex}"), self._at(f"{number:012d}.json")
        files = draft.getFileSystem(self._conf)
        out = files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft.makeQualified(files.getUri(), files.getWorkingDirectory()), final.makeQualified(files.getUri(), files.getWorkingDirectory()), options)
        except Exception as error:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise
        return True


class Revision:
    """A counter of changes to a corpus, for those who keep something made of it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._kept = Manifests(spark, path)

    def now(self) -> int:
        return max(self._kept.numbers(), default=0)

    def bump(self) -> int:
        number = self.now() + 1
        while not self._kept.publish(number, {}):
            number += 1
        return number
