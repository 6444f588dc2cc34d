"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspark.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).collect()[0])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v: long); component is the smallest node reachable.

    Alternates large-star (a node's larger neighbours move to its smallest neighbour) and small-star (a
    node's smaller neighbours do) until nothing changes; every round is written, so no lineage builds up.
    Only two numbers a round reach the driver.
    """
    star = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v")).distinct(), "cc")
    state = _state(star)
    while state[0]:
        both = star.unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(first, "u")
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(first.select("u", F.col("m").alias("v")))
        star = written(small.where(F.col("u") != F.col("v")).distinct(), "cc")
        before, state = state, _state(star)
        if state == before:
            break
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
