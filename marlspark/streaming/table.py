"""A keyed table that survives restarts: rows in hash buckets, versions told by manifests.

A batch reads and writes only the buckets that its keys fall into. The new files come first; a manifest,
written last and under a number of its own, names the files of each bucket, the last batch of each source
and the checkpoint. A run that stops in between leaves files that no manifest names; whoever opens the
folder next reads the version before, and the batch can be given again. A batch that a source has already
given changes nothing.

Defined results: the row with the greatest order columns wins, and of such the one that is there first;
rows whose digest is known already are left out; a row with `gone` true takes its key out of what `read`
gives, but is kept, so that an older row, read once more, doesn't bring the key back; a batch without rows
only moves the batch number on.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.sources.manifest import Manifests
from marlspark.streaming.checkpoints import OVERLAP

BUCKETS = 64


class DurableTable:
    """schema must hold the keys, the order columns and `digest`; it may hold `gone` (boolean)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], schema: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.order, self.schema = spark, path.rstrip("/"), keys, order, schema
        self._kept = Manifests(spark, f"{self.path}/manifests")
        found = self._kept.latest()
        # Keys stay in the bucket that they were first dealt to.
        self.buckets = found[1]["buckets"] if found else buckets

    def _state(self) -> tuple[int, dict]:
        return self._kept.latest() or (0, {"buckets": self.buckets, "files": {}, "batches": {}, "checkpoint": None})

    @property
    def version(self) -> int:
        return self._state()[0]

    @property
    def checkpoint(self) -> dt.datetime | None:
        at = self._state()[1]["checkpoint"]
        return dt.datetime.fromisoformat(at) if at else None

    def _files(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{p}" for p in paths])

    def history(self) -> DataFrame:
        """The last row of every key, those that are gone too."""
        return self._files(sorted(self._state()[1]["files"].values()))

    def read(self) -> DataFrame:
        rows = self.history()
        return rows.where(~F.coalesce(F.col("gone"), F.lit(False))) if "gone" in rows.columns else rows

    def upsert(self, batch: DataFrame, number: int, source: str = "stream", checkpoint: dt.datetime | None = None) -> bool:
        """Merge a batch; False if `source` has given this one before. `checkpoint` moves on with it, in the same version."""
        version, state = self._state()
        if number <= state["batches"].get(source, -1):
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # `buckets` numbers at most
        files = dict(state["files"])
        if touched:
            known = self._files([files[str(b)] for b in touched if str(b) in files])
            columns = known.columns
            rest = [c for c in columns if c not in self.keys]
            fresh = batch.select(*columns).join(known.select(*self.keys, "digest"), [*self.keys, "digest"], "left_anti")
            rows = known.withColumn("there", F.lit(1)).unionByName(fresh.withColumn("there", F.lit(0)))
            merged = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*self.order, "there")).alias("r")).select(*self.keys, "r.*").select(*columns)
            name = f"data-{uuid.uuid4().hex}"
            merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
            files |= {str(b): f"{name}/bucket={b}" for b in touched}
        at = state["checkpoint"] if checkpoint is None else checkpoint.isoformat()
        if not self._kept.publish(version + 1, state | {"files": files, "batches": state["batches"] | {source: number}, "checkpoint": at}):
            raise RuntimeError("another writer has changed the table meanwhile; give the batch again")
        return True

    def advance(self, checkpoint: dt.datetime) -> None:
        """Move the checkpoint on by itself."""
        version, state = self._state()
        if not self._kept.publish(version + 1, state | {"checkpoint": checkpoint.isoformat()}):
            raise RuntimeError("another writer has changed the table meanwhile")


def synchronise(
    table: DurableTable,
    everything: Callable[[dt.datetime], DataFrame],
    changes: Callable[[dt.datetime, dt.datetime], DataFrame],
    clock: Callable[[], dt.datetime],
    failures: Callable[[DataFrame], int] = lambda rows: 0,
    audit: Callable[[DataFrame], None] | None = None,
    overlap: dt.timedelta = OVERLAP,
    dry_run: bool = False,
) -> dict:
    """One run of a sync: the first reads everything, activates that as the baseline, and catches up; later ones read changes.

    The cutoff is taken before reading, so that nothing written meanwhile falls between baseline and catch-up.
    A checkpoint moves on in the version that holds its rows, only without failures and after the audit is
    written; a dry run writes nothing. Batch numbers are those of the table's versions.
    """

    def run(rows: DataFrame, cutoff: dt.datetime, kind: str) -> int:
        if bad := failures(rows):
            raise RuntimeError(f"{bad} rows of the {kind} failed; the checkpoint isn't moved")
        if not dry_run:
            if audit is not None:
                audit(rows)
            table.upsert(rows, table.version, kind, cutoff)
        return rows.count()

    done = {"full": 0, "delta": 0}
    cutoff = clock()
    if table.checkpoint is None:
        baseline = everything(cutoff)
        if baseline.isEmpty():
            raise RuntimeError("the full read gave no rows; the checkpoint isn't made")
        done["full"] = run(baseline, cutoff, "full")
        if dry_run:
            return done
        cutoff = clock()
    done["delta"] = run(changes(table.checkpoint - overlap, cutoff), cutoff, "delta")
    return done
