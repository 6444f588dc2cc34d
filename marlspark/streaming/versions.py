"""File versions as keyed state: each file is judged against all that came before it in the stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that lists and maps of a key need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def decide(version: int, slug: str, checksum: str, latest: tuple[int, str] | None, known: str | None) -> str:
    """What to do with a file; latest: newest version and its slug; known: the checksum of the same version, if there is one."""
    if latest is None:
        return "CREATE" if version == 1 else "INITIAL_VERSION_MUST_BE_ONE"
    if known is not None:
        return "DUPLICATE" if known == checksum else "VERSION_CONTENT_CONFLICT"
    if version < latest[0]:
        return "OLDER_VERSION"
    return "NEW_VERSION" if slug == latest[1] else "DOCUMENT_NAME_MISMATCH"


class VersionState(StatefulProcessor):
    """Of each (source, document_code): the newest accepted version with its slug, and the checksum of every accepted version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "version int, slug string")
        self.checksums = handle.getMapState("checksums", "version int", "checksum string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        latest = tuple(self.latest.get()) if self.latest.exists() else None
        before, known, out = latest, {}, []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():  # the new files of one document
            version = int(row.version)
            if latest is not None and version not in known and self.checksums.containsKey((version,)):
                known[version] = self.checksums.getValue((version,))[0]
            outcome = decide(version, row.slug, row.checksum, latest, known.get(version))
            if outcome in ("CREATE", "NEW_VERSION"):
                latest, known[version] = (version, row.slug), row.checksum
                self.checksums.updateValue((version,), (row.checksum,))
            out.append((int(row.file_id), outcome))
        if latest != before:
            self.latest.update(latest)
        yield pd.DataFrame(out, columns=["file_id", "outcome"])

    def close(self) -> None:
        pass


def judged(files: DataFrame) -> DataFrame:
    """(file_id, outcome) of a stream of (source, document_code, seq, file_id, version, slug, checksum).

    Files of one batch are judged in order of seq; those of an earlier batch come before them whatever their seq.
    """
    columns = ["source", "document_code", "seq", "file_id", "version", "slug", "checksum"]
    return files.select(*columns).groupBy("source", "document_code").transformWithStateInPandas(VersionState(), "file_id long, outcome string", "Update", "None")
