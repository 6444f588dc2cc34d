"""Rows that callers see, out of payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.operators import merge, rows
from marlspark.plans.base import query, read
from marlspark.sources import tables


@query(
    """SELECT doc_id AS chunk_id, CASE WHEN doc_id % 5 > 0 THEN doc_id * 1000003 END AS document_id, source AS source_key, lang AS category, NULL::BIGINT AS group_id, coalesce(CASE WHEN doc_id % 4 > 0 THEN lang || '>' || source END, '') AS section_path,
       CASE WHEN doc_id % 3 > 0 THEN (doc_id % 7)::INTEGER ELSE 0 END AS chunk_index, length(CASE WHEN doc_id % 6 > 0 THEN text ELSE '' END) AS content_chars FROM documents"""
)
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks out of payloads that lack this or that."""
    key = F.col("doc_id")
    payload = F.to_json(F.struct(F.when(key % 5 > 0, key * 1000003).alias("document_id"), F.col("source").alias("source_key"), F.col("lang").alias("category"), F.when(key % 4 > 0, F.array("lang", "source")).alias("section_path"), F.when(key % 3 > 0, key % 7).alias("chunk_index"), F.when(key % 6 > 0, F.col("text")).alias("content")))
    found = rows.chunk_rows(read(spark, sf_dir, "documents").select(key.alias("id"), payload.alias("payload"), F.lit(None).cast("double").alias("similarity")))
    return found.select("chunk_id", "document_id", "source_key", "category", "group_id", F.array_join("section_path", ">").alias("section_path"), "chunk_index", F.length("content").cast("long").alias("content_chars"))


@query(
    """SELECT (o_orderkey * 9007199254740993 % 9223372036854775807)::BIGINT::VARCHAR AS id, 'k' || o_orderkey AS source_key, o_orderpriority AS category, CASE WHEN o_orderkey % 2 = 0 THEN 'text' ELSE '' END AS source_text, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 = 1 ELSE true END AS is_active,
       CASE WHEN o_orderkey % 4 = 1 THEN '' WHEN o_orderkey % 4 > 1 THEN 'named/' || o_orderkey END AS file_storage_key, o_orderkey % 4 > 1 AS has_local_file, (o_custkey % 9)::BIGINT AS chunk_count FROM (SELECT o_orderkey::HUGEINT AS o_orderkey, o_custkey, o_orderpriority FROM orders)"""
)
def document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents out of payloads, with ids beyond what a double holds."""
    key = F.col("o_orderkey")
    big = (key.cast("decimal(38,0)") * F.lit("9007199254740993").cast("decimal(20,0)") % F.lit("9223372036854775807").cast("decimal(20,0)")).cast("long")
    payload = F.to_json(F.struct(big.alias("document_id"), F.concat(F.lit("k"), key).alias("source_key"), F.col("o_orderpriority").alias("category"), F.when(key % 2 == 0, "text").alias("source_text"), F.when(key % 3 > 0, key % 3 == 1).alias("is_active"), F.when(key % 4 == 1, "").when(key % 4 > 1, F.concat(F.lit("named/"), key)).alias("file_storage_key")))
    found = rows.document_rows(read(spark, sf_dir, "orders").select(payload.alias("payload"), (F.col("o_custkey") % 9).alias("chunk_count")))
    return found.select("id", "source_key", "category", "source_text", "is_active", "file_storage_key", "has_local_file", "chunk_count")


@query(
    """SELECT p_partkey AS point_id, CASE WHEN p_partkey % 4 = 0 THEN 's' || p_partkey ELSE 'c' || p_partkey END AS product_code, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE p_type END AS title,
       CASE WHEN p_partkey % 5 = 0 THEN p_brand || ', ' || p_type WHEN p_partkey % 5 < 3 THEN p_type ELSE '' END AS colors, CASE WHEN p_partkey % 5 = 0 THEN p_size::INTEGER ELSE 0 END AS variant_count, p_partkey % 10 = 0 AS ai_ready,
       CASE WHEN p_partkey % 6 = 0 THEN 'https://a/' || p_partkey WHEN p_partkey % 6 < 4 THEN 'https://b/' || p_partkey END AS image_url FROM part"""
)
def product_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products out of payloads whose parts stand in for each other."""
    key, when = F.col("p_partkey"), F.when
    url = lambda host: F.concat(F.lit(f"https://{host}/"), key)
    summary = F.struct(when(key % 4 == 0, F.concat(F.lit("s"), key)).alias("product_code"), when(key % 3 == 1, F.col("p_brand")).alias("title"), when(key % 5 == 0, F.array("p_brand", "p_type")).when(key % 5 == 1, F.array().cast("array<string>")).alias("colors"), when(key % 5 == 0, F.col("p_size")).alias("variant_count"), when(key % 10 == 0, F.lit(True)).alias("ai_ready"))
    public = F.struct(F.col("p_type").alias("product_name"), when(key % 5 < 3, F.array("p_type")).alias("colors"), when(key % 6 == 0, F.array(url("a"), url("z"))).when(key % 6 == 1, F.array().cast("array<string>")).alias("image_urls"))
    images = when(key % 6 < 4, F.array(F.struct(F.lit("").alias("source_url")), F.struct(url("b").alias("source_url")), F.struct(url("c").alias("source_url"))))
    payload = F.to_json(F.struct(when(key % 4 == 0, "").otherwise(F.concat(F.lit("c"), key)).alias("product_code"), when(key % 3 == 0, F.col("p_name")).alias("title"), summary.alias("summary"), public.alias("public_info"), images.alias("images")))
    found = rows.product_summaries(read(spark, sf_dir, "part").select(key.alias("id"), payload.alias("payload")))
    return found.select("point_id", "product_code", "title", "colors", "variant_count", "ai_ready", "image_url")


@query(
    """WITH i AS (SELECT o_orderkey AS k, o_orderkey % 3 = 0 AS failed, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey END AS new_id, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey + 1000000000 END AS old_id FROM orders)
    SELECT k AS import_id, CASE WHEN NOT failed THEN 'completed' WHEN new_id IS NOT NULL AND old_id = -1 THEN 'COMPENSATION_FAILED' ELSE 'failed' END AS status,
           CASE WHEN new_id IS NULL THEN false ELSE NOT failed END AS new_active, CASE WHEN old_id = -1 THEN NULL WHEN new_id IS NULL THEN true ELSE failed END AS old_active FROM i"""
)
def import_compensation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What good and failed imports leave active."""
    key = F.col("o_orderkey")
    old = F.when(key % 7 == 0, F.lit(-1).cast("long")).otherwise(key + 1_000_000_000)
    imports = read(spark, sf_dir, "orders").select(key.alias("import_id"), F.when(key % 5 > 0, key).alias("new_id"), F.array(old).alias("old_ids"), (key % 3 == 0).alias("failed"))
    there = imports.select(F.col("import_id").alias("id"), F.lit(False).alias("active")).unionByName(imports.select(F.get("old_ids", F.lit(0)).alias("id"), F.lit(True).alias("active")).where("id > 0"))
    after, states = rows.compensated(there, imports)
    new = after.select(F.col("id").alias("import_id"), F.col("active").alias("new_active"))
    before = after.select((F.col("id") - 1_000_000_000).alias("import_id"), F.col("active").alias("old_active"))
    return states.join(new, "import_id", "left").join(before, "import_id", "left")


@query(
    """WITH p AS (SELECT p_partkey, list_filter(list_transform([CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE ' A' || p_size || ' ' END, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'B' || p_size END, CASE WHEN p_partkey % 7 = 0 THEN 'C' || p_size END], lambda v: trim(v)), lambda v: v <> '') AS codes FROM part)
    SELECT p_partkey, codes[1] AS code, len(codes) = 0 AS skipped FROM p"""
)
def first_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code that each product is grouped by, the first variant's that isn't blank; products without one are skipped."""
    key, size = F.col("p_partkey"), F.col("p_size")
    skus = [F.when(key % 2 == 0, "  ").otherwise(F.concat(F.lit(" A"), size, F.lit(" "))), F.when(key % 3 != 0, F.concat(F.lit("B"), size)), F.when(key % 7 == 0, F.concat(F.lit("C"), size))]
    products = read(spark, sf_dir, "part").select(key, F.struct(F.array(*[F.struct(s.cast("string").alias("sku")) for s in skus]).alias("nodes")).alias("variants"))
    return tables.product_code(products).select("p_partkey", F.col("product_code").alias("code"), F.col("product_code").isNull().alias("skipped"))


LISTED = "l AS (SELECT d.doc_id, coalesce('page ' || p.page_id, d.source) AS title, d.lang, coalesce(x.quality, 1) = 1 AS active FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN labels x ON x.doc_id = d.doc_id)"


@query(
    f"""WITH {LISTED} SELECT 'all' AS asked, doc_id, title FROM l UNION ALL SELECT 'german', doc_id, title FROM l WHERE lang = 'de' UNION ALL SELECT 'active french', doc_id, title FROM l WHERE lang = 'fr' AND active UNION ALL SELECT 'put out of use', doc_id, title FROM l WHERE NOT active"""
)
def document_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the file's title over their own, by what a caller asks for of language and state."""
    files = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(F.lit("page "), "page_id").alias("file_title"))
    state = read(spark, sf_dir, "labels").select("doc_id", "quality")
    rows_ = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(files, "doc_id", "left").join(state, "doc_id", "left")
    listed = rows_.select("doc_id", F.coalesce("file_title", "source").alias("title"), "lang", (F.coalesce("quality", F.lit(1)) == 1).alias("active"))
    asked = {"all": (None, None), "german": ("de", None), "active french": ("fr", True), "put out of use": (None, False)}
    out = None
    for name, (lang, active) in asked.items():
        part = merge.chosen(listed, lang=lang, active=active).select(F.lit(name).alias("asked"), "doc_id", "title")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND coalesce(lang, '') <> 'es'")
def points_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left when some ids and all of one language are deleted."""
    gone = read(spark, sf_dir, "labels").where("quality = 0")
    return merge.without(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", gone, F.col("lang") == "es").select("doc_id")
