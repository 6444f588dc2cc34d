"""Product catalog: grouping by code, statistics, payloads, differences, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspark.functions import text

#: Status by precedence; anything else is INACTIVE.
STATUSES = ("ACTIVE", "UNLISTED", "DRAFT", "ARCHIVED")


def in_order(value: Column, position: Column) -> Column:
    """Different non-blank values of a group, in order of first position."""
    pairs = F.array_sort(F.collect_list(F.when(F.length(F.trim(value)) > 0, F.struct(position.alias("p"), value.alias("v")))))
    return F.array_distinct(F.transform(pairs, lambda x: x["v"]))


def status_of(statuses: Column) -> Column:
    """The strongest status of a group."""
    upper = F.upper(F.trim(statuses))
    rank = F.lit(None).cast("int")
    for i, s in enumerate(STATUSES):
        rank = F.when(upper == s, i).otherwise(rank)
    return F.coalesce(F.get(F.array(*map(F.lit, STATUSES)), F.min(rank)), F.lit("INACTIVE"))


def inventory_status(quantities: Column, available: Column) -> Column:
    """in_stock if any variant is available, out_of_stock if all are known not to be, else unknown."""
    return F.when(F.coalesce(F.bool_or(available), F.lit(False)), "in_stock").when(F.count(quantities) == F.count(F.lit(1)), "out_of_stock").otherwise("unknown")


def stock(quantities: Column) -> Column:
    """Total stock; negative counts are nothing; null if no count is known."""
    return F.sum(F.when(quantities.isNotNull(), F.greatest(quantities, F.lit(0))))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with keys in alphabetical order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def sync_plan(remote: DataFrame, local: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, action): CREATE what is only remote, INACTIVATE what is only local, UPDATE or leave UNCHANGED the rest."""
    a = remote.select(key, F.col(digest).alias("a"))
    b = local.select(key, F.col(digest).alias("b"))
    action = F.when(F.col("b").isNull(), "CREATE").when(F.col("a").isNull(), "INACTIVATE").when(F.col("a") == F.col("b"), "UNCHANGED").otherwise("UPDATE")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, change_type, changes): fields that differ with both sides; nothing for rows that are equal.

    CREATED without an old row, INACTIVATED without a new one, STATUS_CHANGED if only `status` differs.
    """
    a = old.select(key, F.struct(*fields).alias("old"))
    b = new.select(key, F.struct(*fields).alias("new"))
    side = lambda s, f: F.col(f"{s}.{f}").cast("string")
    entries = F.array(*[F.struct(F.lit(f).alias("key"), F.struct(side("old", f).alias("before"), side("new", f).alias("after")).alias("value")) for f in sorted(fields)])
    changed = F.filter(entries, lambda e: ~e["value"]["before"].eqNullSafe(e["value"]["after"]))
    kind = (
        F.when(F.col("old").isNull(), "CREATED")
        .when(F.col("new").isNull(), "INACTIVATED")
        .when((F.size("changed") == 1) & (F.get("changed", F.lit(0))["key"] == "status"), "STATUS_CHANGED")
        .otherwise("UPDATED")
    )
    rows = a.join(b, key, "full_outer").withColumn("changed", changed).where(F.size("changed") > 0)
    return rows.select(key, kind.alias("change_type"), F.map_from_entries("changed").alias("changes"))


def match_variants(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local variants with their remote one: by external id, else by legacy id, else by (sku, color, size) if that is unique.

    local and remote: external_id, legacy_id, sku, color, size; local also local_id, remote remote_id.
    Ids that several remote rows share go to the smallest remote_id. Color and size are compared case, accents and
    punctuation aside; null is blank.
    """
    compared = {"sku": text.clean(F.col("sku")), "color": text.slug(F.col("color")), "size": text.slug(F.col("size"))}
    local, remote = local.withColumns(compared), remote.withColumns(compared)
    one = lambda *keys: remote.where(F.col(keys[0]).isNotNull()).groupBy(*keys)
    external = one("external_id").agg(F.min("remote_id").alias("by_external"))
    legacy = one("legacy_id").agg(F.min("remote_id").alias("by_legacy"))
    composite = one("sku", "color", "size").agg(F.min("remote_id").alias("by_composite"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    found = local.join(external, "external_id", "left").join(legacy, "legacy_id", "left").join(composite, ["sku", "color", "size"], "left")
    how = F.when(F.col("by_external").isNotNull(), "external_id").when(F.col("by_legacy").isNotNull(), "legacy_id").when(F.col("by_composite").isNotNull(), "composite").otherwise("missing")
    return found.select("local_id", F.coalesce("by_external", "by_legacy", "by_composite").alias("remote_id"), how.alias("how"))


def delta_action(known: Column, status: Column, old_status: Column, same_product: Column, same_images: Column) -> Column:
    """What a changed product needs: nothing, its status, its catalog row, or all of it."""
    active = status == "ACTIVE"
    return (
        F.when(~known & ~active, "SKIP_NEW_NONACTIVE")
        .when(~known, "CREATE_FULL")
        .when(same_product & same_images & (status == old_status), "SKIP_UNCHANGED")
        .when(same_product & same_images, "STATUS_ONLY")
        .when(same_images, "CATALOG_ONLY")
        .otherwise("FULL_RECONCILE")
    )


def numbered_page(rows: DataFrame, number: int, size: int, *order: Column, clamp: bool = True) -> DataFrame:
    """A page of the ordered rows with total, page and total_pages. The rows are counted first, as one number.

    With `clamp` there is at least one page, and numbers beyond the last mean the last; without it such a page is
    empty and no rows make no pages.
    """
    total = rows.count()
    pages = -(-total // size)
    if clamp:
        pages = max(1, pages)
        number = min(max(1, number), pages)
    long = lambda n: F.lit(n).cast("long")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).select("*", long(total).alias("total"), long(number).alias("page"), long(pages).alias("total_pages"))
