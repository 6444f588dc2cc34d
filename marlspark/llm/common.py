"""Helpers shared by the training-data operators."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: An odd number to hash with.
BASE = 0x9E3779B97F4A7C15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where there are no executors, as in tests.

    What a run writes there stays for as long as its results are read; whoever owns the folder clears it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        base = context.getCheckpointDir()
        if not base:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
            context.setCheckpointDir(base)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; every run takes its own."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys with a larger part of all rows than one in so many are joined by broadcast.
FREQUENT = 1024


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` joined with `counted`, which says in n how many rows each key has; both are read twice.

    Keys that hold more than one row in FREQUENT, fewer than that number of keys, go to every task, so no
    task gets all rows of one; the rest is shuffled.
    """
    limit = rows.count() // FREQUENT
    often = F.broadcast(counted.where(F.col("n") > limit))
    seldom = rows.join(often.select(*keys), keys, "left_anti").join(counted.where(F.col("n") <= limit), keys)
    return rows.join(often, keys).unionByName(seldom)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body` any number of times."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, in order; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few literal rows that lives in the plan itself, not in a Python RDD."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of BASE and of its inverse, modulo 2^64."""
    out = []
    for factor in (BASE, pow(BASE, -1, 1 << 64)):
        each = np.full(n, factor, dtype=np.uint64)
        each[0] = 1
        out.append(np.multiply.accumulate(each))
    return out[0], out[1]


def powers(least: int) -> tuple[np.ndarray, np.ndarray]:
    """At least so many powers of BASE and of its inverse, for hashes of all parts of an array by one running sum."""
    return _powers(1 << max(18, least.bit_length()))
