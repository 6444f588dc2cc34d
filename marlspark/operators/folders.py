"""Folder trees as tables of (id, parent, name, folder): levels below roots, and the folders that must be there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspark.sources.shared import scratch

#: The folders below a department, and those below each of them.
SCOPES, STAGES = ("Public", "Private"), ("NEW", "DONE", "ERROR")
MAX_DEPTH = 32


def same_name(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit(""))))


def levels(items: DataFrame, roots: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(root, id, depth, path): everything below the roots (id); path holds the names from the root down.

    Each round joins the children of the last level, written so that no lineage builds up, until there are none.
    An id has one parent, so a cycle is below no root and never met, but where a root lies in it: such a branch
    ends where it comes back to its root. Deeper than `max_depth` is an error.
    """
    spark = items.sparkSession
    kept = items.select(F.col("parent").alias("above"), "id", "name")

    def stored(df: DataFrame) -> DataFrame:
        path = scratch(spark, "folder-level")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    found = [stored(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path")))]
    while not found[-1].isEmpty():
        if len(found) > max_depth + 1:
            raise ValueError(f"folders lie deeper than {max_depth}")
        last = found[-1].select("root", F.col("id").alias("above"), "depth", "path")
        below = last.join(kept, "above").where(F.col("id") != F.col("root"))
        found.append(stored(below.select("root", "id", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("name")).alias("path"))))
    return reduce(DataFrame.unionByName, found)


def _expected(parents: DataFrame, names: tuple[str, ...], items: DataFrame) -> DataFrame:
    """(root, above, at, id, n) for each name that must be below each parent (root, above, at): how many folders have it, and one of them."""
    wanted = parents.withColumn("name", F.explode(F.array(*map(F.lit, names))))
    there = items.where("folder AND NOT trashed").select(F.col("parent").alias("above"), same_name(F.col("name")).alias("same"), "id").groupBy("above", "same").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    met = wanted.withColumn("same", same_name(F.col("name"))).join(there, ["above", "same"], "left")
    return met.select("root", "above", F.concat("at", F.array("name")).alias("at"), "id", F.coalesce("n", F.lit(0)).alias("n"))


def structure(items: DataFrame, departments: DataFrame) -> DataFrame:
    """(root, path, id, problem) of each folder that a department (id) must have: scopes, and the stages below each.

    items: id, parent, name, folder, trashed. Names are compared without case and outer blanks; problem is
    MISSING, SEVERAL or null. Stages are only asked for below a scope that is there once.
    """
    none = F.array().cast("array<string>")
    scopes = _expected(departments.select(F.col("id").alias("root"), F.col("id").alias("above"), none.alias("at")), SCOPES, items)
    stages = _expected(scopes.where("n = 1").select("root", F.col("id").alias("above"), "at"), STAGES, items)
    problem = F.when(F.col("n") == 0, "MISSING").when(F.col("n") > 1, "SEVERAL")
    return scopes.unionByName(stages).select("root", F.array_join("at", "/").alias("path"), F.when(F.col("n") == 1, F.col("id")).alias("id"), problem.alias("problem"))
