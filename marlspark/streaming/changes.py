"""Change streams: windows, idempotent writes, keyed state. All run as Structured Streaming queries with
`availableNow`; what a batch writes goes through `foreachBatch` and is written so that a repeated batch
changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlspark.sources.shared import scratch


def run_to_end(stream: DataFrame, write: Callable[[DataFrame, int], None], name: str, mode: str = "append", offsets: str | None = None, settings: dict[str, str] | None = None) -> None:
    """Process everything there is, batch by batch, and stop; `offsets` is a folder from which a later run goes on.

    `settings` hold for this query only.
    """
    spark = stream.sparkSession
    before = {key: spark.conf.get(key, None) for key in settings or {}}
    for key, value in (settings or {}).items():
        spark.conf.set(key, value)
    try:
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", offsets or scratch(spark, f"{name}-offsets")).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def append_to(spark: SparkSession, name: str) -> tuple[str, Callable[[DataFrame, int], None]]:
    """A folder and a writer that puts each batch into its own subfolder; a repeated batch replaces itself."""
    path = scratch(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return path, write


def fingerprinted(changes: DataFrame, columns: list[str]) -> DataFrame:
    return changes.withColumn("digest", F.sha2(F.to_json(F.struct(*sorted(columns))), 256))


def last_codes(events: DataFrame) -> DataFrame:
    """(product, code, changes) of a stream of (product, at, code): state kept for each product.

    Emits a product's row whenever a batch touches it; the row with the most changes is the last.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, code, changes = state.get if state.exists else (-1, None, 0)
        for rows in batches:
            best = rows.sort_values(["at", "event"]).iloc[-1]
            if int(best["at"]) >= at:
                at, code = int(best["at"]), str(best["code"])
            changes += len(rows)
        state.update((at, code, changes))
        yield pd.DataFrame([(int(key[0]), code, changes)], columns=["product", "code", "changes"])

    return events.groupBy("product").applyInPandasWithState(update, "product long, code string, changes long", "at long, code string, changes long", "update", GroupStateTimeout.NoTimeout)


def current_codes(events: DataFrame) -> DataFrame:
    """(product, at, event, code) of a stream of the same, where a null code removes the product and its state.

    Emits what a batch makes of each product that it touches. A late event that is older than a removal finds no
    state and is emitted too, so the row with the greatest (at, event) tells what holds.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for rows in batches:
            last = rows.sort_values(["at", "event"]).iloc[-1]
            found = (int(last["at"]), int(last["event"]), None if pd.isna(last["code"]) else str(last["code"]))
            best = found if best is None or found[:2] >= tuple(best[:2]) else best
        if best[2] is not None:
            state.update(tuple(best))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(int(key[0]), *best)], columns=["product", "at", "event", "code"])

    return events.groupBy("product").applyInPandasWithState(update, "product long, at long, event long, code string", "at long, event long, code string", "update", GroupStateTimeout.NoTimeout)
