"""A product's pictures, urls, snapshots and status against what is stored of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspark.functions.text import clean, slug


#: The kinds of stored pictures.
RECOGNITION, MANAGED = "recognition", "shopify"


def source_kind(kind: Column, url: Column, path: Column) -> Column:
    """Who manages a stored picture: what it says itself, else RECOGNITION by its url or folder, else MANAGED."""
    folder = F.concat(F.lit("/"), F.replace(F.lower(clean(path)), F.lit("\\"), F.lit("/")))
    recognised = F.lower(clean(url)).startswith("recognition://") | folder.contains("/recognition/")
    return F.coalesce(F.nullif(F.lower(clean(kind)), F.lit("")), F.when(recognised, RECOGNITION).otherwise(MANAGED))


def reconcile_images(target: DataFrame, stored: DataFrame) -> DataFrame:
    """(product, checksum, color, point_id, state) of wanted and stored pictures, matched by checksum and color.

    target: product, checksum, color; stored: those, point_id and source_kind. A stored picture is `keep` (the
    smallest point_id of a wanted identity), `duplicate` (its others) or `stale`; a wanted identity without one is
    `missing`. Where a product has a wanted picture without checksum, its stale and duplicate ones are `undecided`.
    Stored pictures that others manage or that have no checksum are left out; null and blank are one.
    """
    key = ["product", "checksum", "color"]
    plain = [F.col("product"), clean(F.col("checksum")).alias("checksum"), clean(F.col("color")).alias("color")]
    wanted = target.select(*plain)
    open_products = wanted.where("checksum = ''").select("product").distinct().withColumn("open", F.lit(True))
    points = stored.where(F.col("source_kind") == MANAGED).select(*plain, "point_id").where("checksum <> ''")
    # Both sides are down to one row an identity before they meet; only the points' side may be skewed after.
    known = wanted.where("checksum <> ''").distinct().withColumn("wanted", F.lit(True))
    identities = known.join(points.groupBy(*key).agg(F.min("point_id").alias("first")), key, "full_outer")
    missing = identities.where(F.col("first").isNull()).select(*key, F.lit(None).cast(stored.schema["point_id"].dataType).alias("point_id"), F.lit("missing").alias("state"))
    surplus = lambda state: F.when(F.col("open").isNotNull(), "undecided").otherwise(state)
    state = F.when(F.col("wanted").isNull(), surplus("stale")).when(F.col("point_id") == F.col("first"), "keep").otherwise(surplus("duplicate"))
    return points.join(identities, key).join(open_products, "product", "left").select(*key, "point_id", state.alias("state")).unionAll(missing)


def url_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """A row for each product: sorted urls added, removed and unchanged, their counts, how many unchanged ones are
    embedded, and whether any must be. old: product, url, embedded; new: product, url. Blank urls don't count."""
    sides = old.select("product", clean(F.col("url")).alias("url"), F.lit(True).alias("was"), F.lit(False).alias("is"), F.coalesce("embedded", F.lit(False)).alias("embedded"))
    sides = sides.unionAll(new.select("product", clean(F.col("url")), F.lit(False), F.lit(True), F.lit(False)))
    urls = sides.groupBy("product", "url").agg(*[F.bool_or(c).alias(c) for c in ("was", "is", "embedded")])
    some = F.col("url") != ""
    kinds = {"added": some & ~F.col("was"), "removed": some & ~F.col("is"), "unchanged": some & F.col("was") & F.col("is")}
    return urls.groupBy("product").agg(
        *[F.array_sort(F.collect_list(F.when(c, F.col("url")))).alias(name) for name, c in kinds.items()],
        *[F.count_if(c).alias(f"n_{name}") for name, c in kinds.items()],
        F.count_if(kinds["unchanged"] & F.col("embedded")).alias("n_embedded"),
        (F.count_if(kinds["added"]) > 0).alias("must_embed"),
    )


def _ordered(rows: Column, keys: Callable[[Column], list[Column]], fields: Callable[[Column], dict[str, Column]]) -> Column:
    """Rows shaped to structs with fields in alphabetical order, sorted by keys, ties by the fields themselves."""

    def keyed(row: Column) -> Column:
        shaped = fields(row)
        return F.struct(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys(row))]).alias("k"), F.struct(*[shaped[n].alias(n) for n in sorted(shaped)]).alias("v"))

    return F.transform(F.array_sort(F.transform(F.coalesce(rows, F.array()), keyed)), lambda x: x["v"])


def variant_snapshot(variants: Column) -> Column:
    """What of the variants (external_id, sku, barcode, variant_title, color, size, price, compare_at_price) tells versions apart."""
    texts = ("external_id", "sku", "barcode", "variant_title", "color", "size")
    return _ordered(
        variants,
        lambda v: [clean(v[c]) for c in ("external_id", "color", "size", "sku")],
        lambda v: {c: clean(v[c]) for c in texts} | {c: v[c] for c in ("price", "compare_at_price")},
    )


def image_snapshot(images: Column) -> Column:
    """The same of images (external_id, color, source_url, alt_text, width, height, image_order); no order counts as 0."""
    texts = ("external_id", "color", "source_url", "alt_text")
    return _ordered(
        images,
        lambda i: [clean(i["color"]), F.coalesce(i["image_order"], F.lit(0)), clean(i["external_id"]), clean(i["source_url"])],
        lambda i: {c: clean(i[c]) for c in texts} | {c: i[c] for c in ("width", "height", "image_order")},
    )


def source_snapshot(sources: Column) -> Column:
    return _ordered(sources, lambda s: [clean(s["id"])], lambda s: {"id": clean(s["id"]), "status": F.upper(clean(s["status"]))})


def digest(value: Column) -> Column:
    """SHA-256 of a struct or array as JSON without spaces, nulls included."""
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}), 256)


def product_digest(product: Column, variants: Column, sources: Column, status: Column) -> Column:
    """A product's fingerprint without its stock; `product` holds the eight texts below."""
    texts = ("product_code", "title", "product_type", "description", "vendor", "material", "sole", "height")
    fields = {c: clean(product[c]) for c in texts} | {"status": status, "sources": source_snapshot(sources), "variants": variant_snapshot(variants)}
    return digest(F.struct(*[fields[c].alias(c) for c in sorted(fields)]))


def inactive(payload: Column, status: Column) -> Column:
    """A payload with its status set at all four places and not ready for retrieval; blank is INACTIVE. Null structs stay null."""
    value = F.coalesce(F.nullif(F.upper(clean(status)), F.lit("")), F.lit("INACTIVE"))
    for place in ("status", "public_info.status", "summary.status", "detail.product.status"):
        payload = payload.withField(place, value)
    return payload.withField("summary.ai_ready", F.lit(False))


def overwrite_availability(prices: Column, variants: Column) -> Column:
    """Price rows with the availability of the last variant of their color and size; others as they were."""

    def of_variant(p: Column) -> Column:
        same = F.filter(variants, lambda v: (clean(v["color"]) == clean(p["color"])) & (clean(v["size"]) == clean(p["size"])))
        return F.get(F.transform(F.slice(same, -1, 1), lambda v: F.coalesce(v["available"], F.lit(False))), F.lit(0))

    return F.transform(prices, lambda p: p.withField("available", F.coalesce(F.when(F.size(variants) > 0, of_variant(p)), p["available"])))


def option_value(options: Column, *names: str) -> Column:
    """The value of the first option with one of these names, case, accents and punctuation aside; empty if there is none."""
    named = F.filter(options, lambda o: F.array_contains(F.array(*[slug(F.lit(n)) for n in names]), slug(o["name"])))
    return clean(F.get(named, F.lit(0))["value"])


#: What shops call the options color and size.
COLOR, SIZE = ("Color", "Colour", "Màu", "Màu sắc"), ("Size", "Kích cỡ", "Cỡ")


def run_statistics(results: DataFrame) -> DataFrame:
    """One row of counts over a run's results: action, new_embeddings, removed."""
    action = clean(F.col("action"))
    counts = {"skipped": action.startswith("SKIP_"), "created": action == "CREATE_FULL", "updated": action.isin("CATALOG_ONLY", "FULL_RECONCILE"), "inactivated": action == "STATUS_ONLY"}
    return results.agg(
        F.count(F.lit(1)).alias("processed"),
        *[F.count_if(c).alias(name) for name, c in counts.items()],
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("new_embeddings", "removed")],
    )
