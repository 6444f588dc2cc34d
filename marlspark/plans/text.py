"""Text queries: tokens, normal forms, ids, headings, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspark.functions import numeric, text
from marlspark.operators import chunking
from marlspark.plans.base import query, read


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


@query(r"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_terms FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents)")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and different tokens of each document."""
    rows = _docs(spark, sf_dir).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


@query(r"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY term")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and documents of every term."""
    each = _docs(spark, sf_dir).select("doc_id", F.explode_outer(text.tokens(F.col("text"))).alias("term")).where("term IS NOT NULL").groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


@query("SELECT doc_id, sha256(trim(regexp_replace(replace(strip_accents(lower(text)), 'đ', 'd'), '[^a-z0-9]+', ' ', 'g'))) AS form FROM documents")
def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query form of each text, as a digest."""
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.query_form(F.col("text")), 256).alias("form"))


FOLD = "replace(strip_accents(replace(lower(text), 'ß', 'ss')), 'đ', 'd')"


@query(f"SELECT doc_id, sha256(trim(regexp_replace({FOLD}, '[^a-z0-9]+', '-', 'g'), '-')) AS slug, sha256(trim(regexp_replace({FOLD}, '\\s+', ' ', 'g'))) AS search, sha256(trim(regexp_replace({FOLD}, '[^a-z0-9]+', ' ', 'g'))) AS spaced FROM documents")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug, search form and spaced form of each text, as digests."""
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.slug(t), 256).alias("slug"), F.sha2(text.search_form(t), 256).alias("search"), F.sha2(text.spaced(t), 256).alias("spaced"))


@query("SELECT doc_id, CAST(greatest(('0x' || substr(sha256('document:' || doc_id), 1, 16))::UBIGINT & 9223372036854775807::UBIGINT, 1) AS BIGINT) AS id FROM documents")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stable id of each document."""
    return _docs(spark, sf_dir).select("doc_id", numeric.stable_id("document", F.col("doc_id")).alias("id"))


@query(
    """WITH p AS (SELECT p_partkey, 'P' || p_partkey AS code, md5(p_name) AS checksum, p_brand AS color FROM part)
    SELECT p_partkey, CAST((('0x' || substr(sha256(code || chr(0) || checksum || chr(0) || color || chr(0) || ''), 1, 16))::UBIGINT & 4611686018427387903::UBIGINT) | 4611686018427387904::UBIGINT AS BIGINT) AS image_id FROM p"""
)
def image_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point id of each part's picture."""
    parts = read(spark, sf_dir, "part")
    return parts.select("p_partkey", numeric.image_id(F.concat(F.lit("P"), "p_partkey"), F.md5("p_name"), F.col("p_brand")).alias("image_id"))


@query("SELECT page_id AS doc_id, 0 AS line, 1 AS level, 'markdown' AS reason, substr(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), 1, 500) AS text FROM pages WHERE trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) <> ''")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the pages, whose titles are put before their text as Markdown."""
    title = F.concat(F.lit("# "), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), F.lit("\n"))
    body = F.regexp_replace(F.regexp_extract("html", "(?s)</h1>(.*)</article>", 1), "<[^>]*>", "\n")
    return chunking.heading_rows(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(title, body).alias("text")))


@query()
def chunk_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows within sections."""
    return chunking.fixed_chunks(_docs(spark, sf_dir))


@query()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,200 characters, cut at the safest place."""
    return chunking.recursive_chunks(_docs(spark, sf_dir))


@query()
def chunk_adaptive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, broken by meaning where they are too long."""
    return chunking.adaptive_chunks(_docs(spark, sf_dir))


BLANK = r"[\s\p{Z}]+"


@query(rf"SELECT doc_id, sha256(regexp_replace(text, '{BLANK}', '', 'g')) AS said, true AS fits, true AS numbered FROM documents WHERE regexp_replace(text, '{BLANK}', '', 'g') <> ''")
def chunk_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each document, put together, say what it says, white space aside; none is too long, and they are numbered from 0."""
    pieces = chunking.recursive_chunks(_docs(spark, sf_dir))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: F.regexp_replace(x["content"], BLANK, "")), "")
    sums = pieces.groupBy("doc_id").agg(F.sha2(said, 256).alias("said"), (F.max(F.length("content")) <= chunking.SIZE).alias("fits"), (F.max("chunk_index") + 1 == F.count(F.lit(1))).alias("numbered"))
    return sums.select("doc_id", "said", "fits", "numbered")


@query(
    """WITH d AS (SELECT doc_id, trim(replace(text, chr(10), ' '), ' ') AS t FROM documents), n AS (SELECT doc_id, t, length(t) AS n FROM d WHERE length(t) > 0)
    SELECT doc_id, true AS inside, true AS reaches, true AS fits, n <= 1200 AS single FROM n"""
)
def fixed_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of each document as one line: all are parts of it, the first begins and the last ends it, none is too long, and a short one is its only window."""
    line = F.btrim(F.translate("text", "\n", " "), F.lit(" "))
    docs = _docs(spark, sf_dir).select("doc_id", line.alias("text"))
    windows = chunking.fixed_chunks(docs, headings=False).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("w"))
    met = windows.join(docs, "doc_id")
    first, last = F.get("w", F.lit(0))["content"], F.element_at("w", -1)["content"]
    inside = F.forall("w", lambda x: F.contains(F.col("text"), x["content"]))
    return met.select("doc_id", inside.alias("inside"), (F.startswith("text", first) & F.endswith("text", last)).alias("reaches"), F.forall("w", lambda x: F.length(x["content"]) <= chunking.SIZE).alias("fits"), (F.size("w") == 1).alias("single"))


@query()
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, units and thresholds that breaking by meaning meets in each document."""
    return chunking.adaptive_stats(_docs(spark, sf_dir))


@query(
    r"""WITH u AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\n\s*\n+'), lambda x: trim(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')), lambda x: length(x) > 0)) AS p FROM documents)
    SELECT doc_id, count(*) AS n, CAST(max(length(p)) AS INTEGER) AS longest FROM u GROUP BY doc_id"""
)
def paragraph_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each document, here its sentences set apart, and the length of the longest."""
    apart = F.replace("text", F.lit(". "), F.lit(".\n \n"))
    return _docs(spark, sf_dir).select("doc_id", F.explode(chunking.paragraphs(apart)).alias("p")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("p")).alias("longest"))


@query(
    """WITH o AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings),
    d AS (SELECT label, round(1 - greatest(-1, least(1, list_dot_product(v, w))), 6) AS gap FROM o WHERE w IS NOT NULL)
    SELECT label, count(*) AS n, round(quantile_cont(gap, 0.8), 6) AS threshold, count(*) FILTER (WHERE gap >= t) AS breaks
    FROM d JOIN (SELECT label, quantile_cont(gap, 0.8) AS t FROM d GROUP BY label) USING (label) GROUP BY label"""
)
def percentile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of consecutive vectors, their 80th percentile and how many reach it, by label."""
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = read(spark, sf_dir, "embeddings").withColumn("before", F.lag("embedding").over(order)).where(F.col("before").isNotNull())
    gaps = rows.select("label", F.round(1 - numeric.cosine(F.col("embedding"), F.col("before")), 6).alias("gap"))
    threshold = gaps.groupBy("label").agg(F.percentile("gap", 0.8).alias("t"))
    return gaps.join(threshold, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.first("t"), 6).alias("threshold"), F.count_if(F.col("gap") >= F.col("t")).alias("breaks"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
    w AS (SELECT doc_id, length(string_agg(line, '|') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS n FROM l)
    SELECT doc_id, CAST(max(n) AS INTEGER) AS widest, CAST(min(n) AS INTEGER) AS narrowest FROM w GROUP BY doc_id"""
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of three lines: the widest and the narrowest of each document."""
    lines = _docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("l"))
    wide = F.transform(F.col("l"), lambda x, i: F.length(F.array_join(F.slice(F.col("l"), F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), "|")))
    return lines.select("doc_id", wide.alias("w")).select("doc_id", F.array_max("w").alias("widest"), F.array_min("w").alias("narrowest"))


@query(
    """SELECT doc_id, sha256(source || chr(10) || lang || ' > ' || coalesce(CAST(n_chars AS VARCHAR), '') || chr(10) || text) AS digest,
       CASE WHEN length(text) BETWEEN 1 AND 20000 THEN 'ok' WHEN length(text) = 0 THEN 'empty' ELSE 'too_long' END AS state FROM documents"""
)
def ingest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The indexed text of each document, as a digest, and whether its length is within bounds."""
    n = F.length("text")
    shown = text.search_text(F.col("source"), F.array("lang", F.col("n_chars").cast("string")), F.lit(None).cast("string"), F.col("text"))
    state = F.when(n.between(1, 20000), "ok").when(n == 0, "empty").otherwise("too_long")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(shown, 256).alias("digest"), state.alias("state"))
