"""Keyed writes as joins: insert what is new, update by rule, replace, remove; and state checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspark.sources.shared import scratch


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target with the source's rows of keys that it lacks (`ON CONFLICT DO NOTHING`)."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], replace: Callable[[Callable[[str], Column], Callable[[str], Column]], Column] | None = None) -> DataFrame:
    """The target with the source's rows; `replace(old, new)` says when an existing row gives way."""
    rest = [c for c in target.columns if c not in keys]
    old = target.select(*keys, *[F.col(c).alias(f"old_{c}") for c in rest], F.lit(True).alias("in_old"))
    new = source.select(*keys, *[F.col(c).alias(f"new_{c}") for c in rest], F.lit(True).alias("in_new"))
    allowed = F.lit(True) if replace is None else replace(lambda c: F.col(f"old_{c}"), lambda c: F.col(f"new_{c}"))
    take = F.col("in_new").isNotNull() & (F.col("in_old").isNull() | F.coalesce(allowed, F.lit(False)))
    return old.join(new, keys, "full_outer").select(*keys, *[F.when(take, F.col(f"new_{c}")).otherwise(F.col(f"old_{c}")).alias(c) for c in rest])


def replace_document(chunks: DataFrame, new: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """The chunks with all of the new documents' in place of their old ones; columns in `kept` keep the old value, if any."""
    old = chunks.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(f"old_{c}") for c in kept])
    merged = new.join(old, key, "left").select(*[F.coalesce(f"old_{c}", c).alias(c) if c in kept else F.col(c) for c in chunks.columns])
    return chunks.join(new.select(key).distinct(), key, "left_anti").unionByName(merged)


def patch(rows: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Rows with some columns set where the condition holds."""
    return rows.select(*[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def violations(rows: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """Keys with more than one row for which the condition holds; none if a partial unique index would stand."""
    return rows.where(condition).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def deletable(rows: DataFrame, key: str, **uses: DataFrame) -> DataFrame:
    """Rows with `refused`: the first of `uses` that holds the row's key (column `key`) and keeps it from being deleted; null if none."""
    for name, use in uses.items():
        rows = rows.join(use.select(key).distinct().withColumn(f"in_{name}", F.lit(name)), key, "left")
    return rows.withColumn("refused", F.coalesce(*[F.col(f"in_{n}") for n in uses])).drop(*[f"in_{n}" for n in uses])


def id_collisions(existing: DataFrame, new: DataFrame, id: str, key: str) -> DataFrame:
    """(id, keys): ids that stand for more than one key, among what is there and what comes; a write that has one must stop."""
    both = existing.select(id, key).unionByName(new.select(id, key)).distinct()
    return both.groupBy(id).agg(F.count(F.lit(1)).alias("keys")).where("keys > 1")


def free_names(files: DataFrame, taken: DataFrame, order: str) -> DataFrame:
    """`files` (stem, suffix, a unique order and more) with `stored`: a name of its own for each, with ` (n)` behind the stem if need be.

    taken: name. Files of one name get the least free numbers in their order, the first none, all at once; where
    such a name is an earlier file's own, this file and those behind it ask again, so there are few rounds.
    """
    group, digits = ["stem", "suffix"], r"^(.*) \((\d{1,9})\)(\.[^.]*)?$"
    rank = Window.partitionBy(*group).orderBy(order)
    waiting, held, done = files, taken.select("name"), None
    while not waiting.isEmpty():
        suffix = F.regexp_extract("name", r"^.+(\.[^.]+)$", 1)
        own = held.select(F.substr("name", F.lit(1), F.length("name") - F.length(suffix)).alias("stem"), suffix.alias("suffix"), F.lit(1).cast("long").alias("n"))
        behind = held.where(F.col("name").rlike(digits)).select(F.regexp_extract("name", digits, 1).alias("stem"), F.regexp_extract("name", digits, 3).alias("suffix"), F.regexp_extract("name", digits, 2).try_cast("long").alias("n"))
        numbers = own.unionByName(behind).groupBy(*group).agg(F.array_sort(F.collect_set("n")).alias("_held"))
        free = F.aggregate(F.coalesce("_held", F.array().cast("array<bigint>")), F.col("_k"), lambda n, h: F.when(h <= n, n + 1).otherwise(n))
        asked = waiting.withColumn("_k", F.row_number().over(rank).cast("long")).join(numbers, group, "left").withColumn("_n", free)
        named = asked.withColumn("stored", F.concat("stem", F.when(F.col("_n") > 1, F.concat(F.lit(" ("), F.col("_n").cast("string"), F.lit(")"))).otherwise(""), "suffix"))
        loses = named.withColumn("_loses", (F.row_number().over(Window.partitionBy("stored").orderBy(order)) > 1).cast("int"))
        told = _stored(loses.withColumn("_waits", F.max("_loses").over(rank.rowsBetween(Window.unboundedPreceding, 0)) > 0))
        good = told.where("NOT _waits").select(*files.columns, "stored")
        done = good if done is None else done.unionByName(good)
        held = held.unionByName(good.select(F.col("stored").alias("name")))
        waiting = told.where("_waits").select(*files.columns)
    return files.withColumn("stored", F.lit(None).cast("string")).limit(0) if done is None else done


def _stored(df: DataFrame) -> DataFrame:
    path = scratch(df.sparkSession, "names")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prunable(stored: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows that no row of `keep` lists."""
    return stored.join(keep.select(*keys).distinct(), keys, "left_anti")


def resolved_scopes(requests: DataFrame, types: DataFrame, groups: DataFrame) -> DataFrame:
    """`requests` (k, type_id, groups: null or a list) with `state` and `categories`.

    types: id, active; groups: id, type_id, active, code. The first that holds: TYPE_MISSING (unknown or not
    active), then by the groups in order GROUP_MISSING, GROUP_OF_OTHER_TYPE, PARENT_INACTIVE; NO_GROUPS, where
    a type is asked for that has none active. A request for neither is OK and has no categories. categories has
    the codes asked for, each once, or all active ones of the type.
    """
    known = types.select(F.col("id").alias("type_id"), F.col("active").alias("type_active"))
    parents = types.select(F.col("id").alias("parent"), F.col("active").alias("parent_active"))
    named = groups.select(F.col("id").alias("group_id"), F.col("type_id").alias("parent"), F.col("active").alias("group_active"), "code").join(parents, "parent", "left")
    asked = requests.select("k", "type_id", F.posexplode("groups").alias("i", "group_id")).join(named, "group_id", "left")
    wrong = F.when(~F.coalesce("group_active", F.lit(False)), "GROUP_MISSING").when(F.col("type_id") != F.col("parent"), "GROUP_OF_OTHER_TYPE").when(~F.coalesce("parent_active", F.lit(False)), "PARENT_INACTIVE")
    judged = asked.withColumn("wrong", wrong).groupBy("k").agg(
        F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.col("i"))).alias("wrong"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("i", "code"))), lambda x: x["code"])).alias("asked")
    )
    every = groups.where("active").groupBy("type_id").agg(F.array_sort(F.collect_set("code")).alias("every"))
    met = requests.join(known, "type_id", "left").join(judged, "k", "left").join(every, "type_id", "left")
    typed = F.col("type_id").isNotNull()
    state = F.when(typed & ~F.coalesce("type_active", F.lit(False)), "TYPE_MISSING").when(F.col("wrong").isNotNull(), F.col("wrong")).when(F.col("groups").isNull() & typed & F.col("every").isNull(), "NO_GROUPS").otherwise("OK")
    told = met.withColumn("state", state)
    chosen = F.when(F.col("groups").isNotNull(), F.col("asked")).when(typed, F.col("every"))
    return told.select("k", "type_id", "groups", "state", F.when(F.col("state") == "OK", chosen).alias("categories"))


def without(rows: DataFrame, key: str, ids: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """The rows less those whose key is in `ids` (column `key`) and those for which `where` holds; a null condition removes nothing."""
    left = rows if ids is None else rows.join(ids.select(key).distinct(), key, "left_anti").select(*rows.columns)
    return left if where is None else left.where(~F.coalesce(where, F.lit(False)))


def chosen(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns have the wanted values; a wanted null doesn't ask."""
    for column, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(column) == F.lit(value))
    return rows


def created(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """`new` with `conflict`: whether the key is there already, or an earlier row of `new` takes it. The others can be created."""
    there = existing.select(key).distinct().withColumn("_there", F.lit(True))
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return new.withColumn("_first", first == 1).join(there, key, "left").withColumn("conflict", F.col("_there").isNotNull() | ~F.col("_first")).drop("_there", "_first")
