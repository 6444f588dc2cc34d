"""Pages behind cursors over rows stored in key order, with a filter in the scan.

Rows are dealt by range of their key into parts; a small list tells each part's least and greatest key. A
page starts at the part that its cursor points into and reads parts in order until it is full, so it costs
the parts it needs, wherever in the table it lies.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from marlspark.sources.shared import scratch

PART_ROWS = 10_000


def encode_cursor(value: object) -> str | None:
    """The value as JSON in url-safe base64 without padding."""
    if value is None:
        return None
    return base64.urlsafe_b64encode(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()).decode().rstrip("=")


def decode_cursor(cursor: str | None) -> object:
    return json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4))) if cursor else None


class KeyedPages:
    """Rows in order of a unique key that isn't null."""

    def __init__(self, rows: DataFrame, key: str, part_rows: int = PART_ROWS) -> None:
        self.spark, self.key, self.path = rows.sparkSession, key, scratch(rows.sparkSession, "pages")
        good = rows.where(F.col(key).isNotNull())
        parts = max(1, -(-good.count() // part_rows))
        dealt = good.repartitionByRange(parts, key).withColumn("part", F.spark_partition_id()).sortWithinPartitions(key)
        dealt.write.partitionBy("part").parquet(self.path)
        self.schema = good.schema
        stored = self.spark.read.schema(StructType([*self.schema.fields, StructField("part", IntegerType())])).parquet(self.path)
        bounds = stored.groupBy("part").agg(F.min(key).alias("least"), F.max(key).alias("most")).orderBy("part").collect()  # a row for each PART_ROWS rows
        self.parts = [(r["part"], r["least"], r["most"]) for r in bounds]
        self.read: list[int] = []

    def _part(self, part: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/part={part}")

    def walk(self, limit: int, where: Column | None = None, search: Column | None = None) -> DataFrame:
        """The rows that `page` gives from the first cursor to the last, with the number of their page from 1, in a few jobs.

        A row's page follows from its place in its part and how many rows of earlier parts match; the latter is
        a row for each part.
        """
        rows = self.spark.read.schema(StructType([*self.schema.fields, StructField("part", IntegerType())])).parquet(self.path)
        for condition in (where, search):
            rows = rows if condition is None else rows.where(condition)
        counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
        placed = rows.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(self.key))).join(F.broadcast(before), "part")
        return placed.select(*[f"`{f.name}`" for f in self.schema.fields], (F.floor((F.col("before") + F.col("at") - 1) / limit) + 1).cast("long").alias("page"))

    def page(self, limit: int, cursor: str | None = None, where: Column | None = None, search: Column | None = None) -> tuple[list[Row], str | None]:
        """The next `limit` rows and the cursor behind them, null at the end; `self.read` then has the parts that were read.

        `where` is part of the scan; `search` picks among what the scan gives. With `search` a cursor names the
        last row, which the next page leaves out, so that no match behind it is passed over; else the next row.
        """
        value = decode_cursor(cursor)
        offset, excluded = (value.get("offset"), value.get("exclude_point_id")) if isinstance(value, dict) else (value, None)
        key, found, self.read = F.col(self.key), [], []
        for part, _, most in self.parts:
            if offset is not None and most < offset:
                continue
            self.read.append(part)
            rows = self._part(part)
            scanned = rows if where is None else rows.where(where)
            if offset is not None:
                scanned = scanned.where(key >= offset)
            if excluded is not None:
                scanned = scanned.where(key != excluded)
            matching = scanned if search is None else scanned.where(search)
            if len(found) < limit:
                found += matching.orderBy(key).limit(limit - len(found)).collect()  # a page at most
            if len(found) >= limit:
                behind = scanned.where(key > found[-1][self.key]).agg(F.min(key)).first()[0]
                if behind is not None:
                    last = found[-1][self.key]
                    return found, encode_cursor({"offset": last, "exclude_point_id": last} if search is not None else behind)
        return found, None
