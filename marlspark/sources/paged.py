"""A remote feed that gives pages behind a cursor, as a Spark data source.

    spark.dataSource.register(PagedFeed)
    spark.read.format("paged_feed").schema(...).option("fetch", "package.module:function").load()

`function(shard, cursor, page_size)` gives (rows, next cursor or None); rows are dicts. Pages of a shard
follow one another, shards are read side by side. Failed calls are tried again, later each time; after
that the task fails and Spark tries the task again.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ATTEMPTS, FIRST_WAIT = 4, 0.5


class FeedError(Exception):
    """What a feed answered instead of a page: its HTTP status, and the codes of errors within an answer."""

    def __init__(self, status: int | None = None, codes: tuple[str, ...] = ()) -> None:
        super().__init__(f"status {status}, codes {codes}")
        self.status, self.codes = status, codes


def may_pass(error: Exception) -> bool:
    """Whether a later call may go well: errors of transport, status 429 or 500 and above, answers that say THROTTLED."""
    status = getattr(error, "status", None) or getattr(error, "code", None)
    busy = isinstance(status, int) and (status == 429 or status >= 500)
    return busy or "THROTTLED" in getattr(error, "codes", ()) or (status is None and isinstance(error, (ConnectionError, TimeoutError)))


def patient(call: Callable, *args: object, attempts: int = ATTEMPTS, wait: float = FIRST_WAIT) -> object:
    """The call's result; errors that may pass are tried again after waits that double."""
    for attempt in range(attempts):
        try:
            return call(*args)
        except Exception as error:
            if attempt + 1 == attempts or not may_pass(error):
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError("attempts must be 1 or more")


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(int(self.options.get("shards", "1")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        size, wait = int(self.options.get("pagesize", "250")), float(self.options.get("wait", FIRST_WAIT))
        cursor = None
        while True:
            rows, cursor = patient(fetch, partition.value, cursor, size, wait=wait)
            for row in rows:
                yield tuple(row.get(f.name) for f in self.schema.fields)
            if cursor is None:
                return


class PagedFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "id string, updatedAt string, status string, payload string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))
