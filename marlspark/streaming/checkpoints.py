"""How far a sync has come: an append-only table of (name, at, note, seq) in the shared folder."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.sources.shared import scratch

SCHEMA = "name string, at timestamp, note string, seq long"
OVERLAP = dt.timedelta(seconds=120)


class Checkpoints:
    """The latest entry of a name counts; earlier ones stay as its history."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or scratch(spark, "checkpoints")

    def history(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as error:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def get(self, name: str) -> dt.datetime | None:
        return self.history().where(F.col("name") == name).agg(F.max_by("at", "seq").alias("at")).first()["at"]

    def put(self, name: str, at: dt.datetime, note: str = "") -> None:
        seq = self.history().where(F.col("name") == name).count()
        self.spark.createDataFrame([(name, at, note, seq)], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def window(self, name: str, now: dt.datetime, overlap: dt.timedelta = OVERLAP) -> tuple[dt.datetime | None, dt.datetime]:
        """(start, end] of the next run; no start means that everything is read."""
        last = self.get(name)
        return (None if last is None else last - overlap), now

    def advance(self, name: str, now: dt.datetime, failures: int, audited: bool = True, dry_run: bool = False) -> bool:
        """Move on after a run without failures whose audit is written; a dry run never does."""
        if failures or not audited or dry_run:
            return False
        self.put(name, now)
        return True


def in_window(rows: DataFrame, column: str, start: dt.datetime | None, end: dt.datetime) -> DataFrame:
    """Rows of (start, end]; times without a zone are those of the session."""
    at = lambda t: F.lit(t.isoformat()).cast(rows.schema[column].dataType)
    found = rows.where(F.col(column) <= at(end))
    return found if start is None else found.where(F.col(column) > at(start))
