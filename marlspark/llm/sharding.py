"""Shards from a consistent-hash ring with virtual nodes and bounded loads.

The ring has a fixed number of cells. Each shard owns the cells up to its virtual nodes; a row's key
hashes to a cell. Loads are bounded: where a shard is full, the rows left over go on clockwise to the
next virtual node whose shard has room. Which rows of a cell go where is decided on the cells' counts
alone (fewer than twice as many numbers as the ring has cells, a parameter), so the driver never sees
rows; a window over each cell then ranks its rows and gives each its shard and slot. Cells of several times
the mean are split by a random number a row, so no window holds all rows of one key.

With the tightest bound (the default) shard sizes are at most one apart, law `rows`. With a load factor
over 1 fewer rows move when shards are added, and shards hold at most that times the mean.

Defined results: a null text has size 1 and the CRC of no bytes; a null doc_id is a key of its own;
repeated rows are placed one by one (equal rows are interchangeable); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspark.llm.common import small_table, written

CELLS = 8192
VIRTUAL_NODES = 64
#: Cells of more than so many times the mean number of rows are split.
SPLIT = 4


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") % cells
    return sorted((at(s, v), s) for s in range(shards) for v in range(virtual_nodes))


def allot(counts: dict[tuple[int, int], int], shards: int, load_factor: float | None = None, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> list[dict]:
    """Which ranks of each part of a cell go to which shard, and the slot of the first; counts: rows by (cell, part)."""
    total = sum(counts.values())
    if load_factor is None:
        room = [total // shards + (s < total % shards) for s in range(shards)]
    else:
        room = [math.ceil(total * max(1.0, load_factor) / shards)] * shards
    used, nodes = [0] * shards, ring(shards, virtual_nodes, cells)
    starts, out = [c for c, _ in nodes], []
    for cell, part in sorted(counts):
        rank, p = 0, bisect_left(starts, cell)
        while rank < counts[cell, part]:
            shard = nodes[p % len(nodes)][1]
            if take := min(counts[cell, part] - rank, room[shard] - used[shard]):
                out.append({"cell": cell, "part": part, "lo": rank, "hi": rank + take, "shard": shard, "first": used[shard]})
                used[shard] += take
                rank += take
            p += 1
    return out


def shard_documents(docs: DataFrame, shards: int = 16, load_factor: float | None = None, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: this law has none) of each row."""
    spark = docs.sparkSession
    whole = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"), F.xxhash64(F.col("doc_id")).alias("key"))
    # Written once, so that the number by which rows of one key are told apart stays what it is.
    numbered = keyed.withColumn("cell", F.pmod("key", F.lit(cells)).cast("int")).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    rows = written(numbered, "shard-rows")
    by_cell = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    # A cell of several times the mean, as one key may have, is ranked in parts; all parts are fewer than twice the cells.
    mean = max(1, -(-sum(by_cell.values()) // cells))
    split = [{"cell": cell, "parts": -(-n // mean)} for cell, n in by_cell.items() if n > SPLIT * mean]
    counts = {(cell, 0): n for cell, n in by_cell.items() if n <= SPLIT * mean}
    if split:
        parts = F.broadcast(small_table(spark, split, "cell int, parts int"))
        rows = rows.join(parts, "cell", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod("salt", F.col("parts"))).cast("int"))
        counts |= {(r["cell"], r["part"]): r["n"] for r in rows.where(F.col("parts").isNotNull()).groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")).collect()}
    else:
        rows = rows.withColumn("part", F.lit(0))
    plan = F.broadcast(small_table(spark, allot(counts, shards, load_factor, virtual_nodes, cells), "cell int, part int, lo long, hi long, shard int, first long"))
    in_part = Window.partitionBy("cell", "part").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(in_part).cast("long") - 1)
    placed = ranked.join(plan, ["cell", "part"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows" if load_factor is None else "bounded").alias("law"),
        "shard",
        (F.col("first") + F.col("rank") - F.col("lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
