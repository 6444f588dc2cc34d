"""Rows that callers see, out of payloads kept as JSON; and what a failed import leaves of the active versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a payload may hold; fields that a row doesn't use aren't parsed.
CHUNK = "document_id bigint, source_key string, title string, category string, doc_type_id bigint, group_id bigint, heading string, section_path array<string>, chunk_index int, content string"
DOCUMENT = (
    "document_id bigint, source_key string, title string, category string, doc_type_id bigint, group_id bigint, document_code string, document_version int, drive_scope string, source_text string, source_checksum string, "
    "embedding_provider string, embedding_model string, embedding_dimension int, is_active boolean, created_at string, updated_at string, file_storage_key string, file_name string, file_mime_type string, file_size bigint, file_origin string"
)
PRODUCT = (
    "product_code string, title string, product_type string, vendor string, status string, created_at string, published_at string, new_at string, updated_at string, images array<struct<source_url: string>>, "
    "summary struct<product_code: string, title: string, product_type: string, status: string, colors: array<string>, variant_count: int, image_count: int, embedding_count: int, ai_ready: boolean, updated_at: string>, "
    "public_info struct<product_name: string, colors: array<string>, image_urls: array<string>>"
)


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _filled(value: Column) -> Column:
    """Null for an empty text, which counts as missing."""
    return F.nullif(value, F.lit(""))


def chunk_rows(points: DataFrame) -> DataFrame:
    """chunk_id and the fields of each chunk (id, payload, similarity), with an empty path, index 0 and empty content where they are missing."""
    defaults = {"section_path": F.array().cast("array<string>"), "chunk_index": F.lit(0), "content": F.lit("")}
    p = points.select(F.col("id").alias("chunk_id"), F.from_json("payload", CHUNK).alias("p"), "similarity")
    return p.select("chunk_id", *[F.coalesce(F.col(f"p.{n}"), defaults[n]).alias(n) if n in defaults else F.col(f"p.{n}").alias(n) for n in _names(CHUNK)], "similarity")


def document_rows(documents: DataFrame) -> DataFrame:
    """The 24 fields of each document (payload, chunk_count): ids as decimal text, since not all readers keep 64 bits; active unless it says otherwise."""
    p = documents.select(F.from_json("payload", DOCUMENT).alias("p"), "chunk_count")
    special = {"document_id": F.col("p.document_id").cast("string").alias("id"), "source_text": F.coalesce("p.source_text", F.lit("")).alias("source_text"), "is_active": F.coalesce("p.is_active", F.lit(True)).alias("is_active")}
    return p.select(*[special.get(n, F.col(f"p.{n}").alias(n)) for n in _names(DOCUMENT)], _filled(F.col("p.file_storage_key")).isNotNull().alias("has_local_file"), "chunk_count")


def product_summaries(points: DataFrame) -> DataFrame:
    """A line for each product (id, payload): every field from the first part of the payload that has it."""
    p = points.select(F.col("id").alias("point_id"), F.from_json("payload", PRODUCT).alias("p"))
    first = lambda *paths: F.coalesce(*[_filled(F.col(f"p.{x}")) for x in paths])
    some = lambda x: F.when(F.size(x) > 0, F.col(x))
    urls = F.filter(F.transform("p.images", lambda i: _filled(i["source_url"])), lambda u: u.isNotNull())
    return p.select(
        "point_id", first("product_code", "summary.product_code").alias("product_code"), first("title", "summary.title", "public_info.product_name").alias("title"), first("product_type", "summary.product_type").alias("product_type"),
        F.col("p.vendor").alias("vendor"), first("status", "summary.status").alias("status"), F.coalesce(F.array_join(F.coalesce(some("p.summary.colors"), F.col("p.public_info.colors")), ", "), F.lit("")).alias("colors"),
        *[F.coalesce(f"p.summary.{c}", F.lit(0)).alias(c) for c in ("variant_count", "image_count", "embedding_count")], F.coalesce("p.summary.ai_ready", F.lit(False)).alias("ai_ready"),
        *[F.col(f"p.{c}").alias(c) for c in ("created_at", "published_at", "new_at")], first("updated_at", "summary.updated_at").alias("updated_at"),
        F.coalesce(F.get(some("p.public_info.image_urls"), F.lit(0)), F.get(urls, F.lit(0))).alias("image_url"),
    )


def one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """The rows, failing where a key has more than one; a null key is none."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*rows.columns)).alias("r"))
    sure = F.assert_true(F.col("n") == 1, F.concat(F.lit("several rows of "), F.col(key).cast("string")))
    return counted.where(sure.isNull()).select("r.*")


def compensated(versions: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What imports leave: `versions` (id, active) and (import_id, status).

    imports: import_id, new_id (null if nothing was written), old_ids, failed. A good import has its new version
    active and the old ones not; a failed one has it the other way round. Its status is COMPENSATION_FAILED if a
    version that it must bring back or take away isn't there, else failed; with nothing written nothing changes.
    """
    wrote = imports.where("new_id IS NOT NULL")
    new = wrote.select("import_id", F.col("new_id").alias("id"), (~F.col("failed")).alias("now"))
    old = wrote.select("import_id", F.explode("old_ids").alias("id"), F.col("failed").alias("now"))
    asked = new.unionByName(old)
    there = asked.join(versions.select("id", F.lit(True).alias("there")), "id", "left")
    lost = there.groupBy("import_id").agg(F.bool_or(F.col("there").isNull()).alias("lost"))
    status = F.when(~F.col("failed"), "completed").when(F.coalesce("lost", F.lit(False)), "COMPENSATION_FAILED").otherwise("failed")
    last = asked.groupBy("id").agg(F.max_by("now", "import_id").alias("now"))
    after = versions.join(last, "id", "left").select("id", F.coalesce("now", "active").alias("active"))
    return after, imports.join(lost, "import_id", "left").select("import_id", status.alias("status"))
