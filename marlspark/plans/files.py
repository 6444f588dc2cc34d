"""File intake queries. Orders are files: their names are put together from order columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.operators import files, merge
from marlspark.plans.base import query, read

NAMES = """n AS (SELECT o_orderkey, ['HR', 'IT', 'K TOÁN', 'ĐT'][o_orderkey % 4 + 1] || '-' || ['QT', 'HD', 'XX', 'BM'][o_orderkey // 4 % 4 + 1] || '-' || lpad(CAST(o_custkey % 200 AS VARCHAR), 3, '0') || '_'
  || CASE WHEN o_orderkey % 19 = 0 THEN 'bad name' ELSE 'Don-hang-' || o_custkey END || '_V' || o_orderkey % 5 || '.' || ['pdf', 'DOCX', 'md', 'pptx'][o_orderkey // 16 % 4 + 1] AS name,
  CASE WHEN o_orderkey % 7 = 0 THEN 'HR' END AS expected FROM orders),
g AS (SELECT *, regexp_extract(trim(name), '^([A-ZĐ][A-ZĐ0-9_]*)-([A-Z]{2,10})-([0-9]{3})_([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)_V([1-9][0-9]*)\\.([A-Za-z0-9]+)$', ['d', 'k', 's', 'slug', 'v', 'x']) AS m FROM n),
p AS (SELECT o_orderkey, name, m, replace(m.d, 'Đ', 'D') AS dep, CASE WHEN name = '' OR contains(name, '/') THEN 'INVALID_FILENAME' WHEN m.d = '' THEN 'INVALID_FILENAME_FORMAT' WHEN expected IS NOT NULL AND replace(m.d, 'Đ', 'D') <> expected THEN 'DEPARTMENT_MISMATCH'
  WHEN m.k NOT IN ('QT', 'QD', 'CS', 'HD', 'BM', 'BC', 'KH', 'TL') THEN 'UNSUPPORTED_DOCUMENT_KIND' WHEN m.s = '000' THEN 'INVALID_SEQUENCE' WHEN lower(m.x) NOT IN ('pdf', 'docx', 'xlsx', 'csv', 'txt', 'md') THEN 'UNSUPPORTED_EXTENSION' END AS error FROM g)"""


def named(orders: DataFrame) -> DataFrame:
    """Orders with a file name and its parts, which a generator works out once a row, however many are used."""
    key = F.col("o_orderkey")
    pick = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    quarter, sixteenth = F.floor(key / 4), F.floor(key / 16)
    slug = F.when(key % 19 == 0, "bad name").otherwise(F.concat(F.lit("Don-hang-"), F.col("o_custkey")))
    name = F.concat(
        pick(["HR", "IT", "K TOÁN", "ĐT"], key % 4), F.lit("-"), pick(["QT", "HD", "XX", "BM"], quarter % 4), F.lit("-"), F.lpad((F.col("o_custkey") % 200).cast("string"), 3, "0"),
        F.lit("_"), slug, F.lit("_V"), key % 5, F.lit("."), pick(["pdf", "DOCX", "md", "pptx"], sixteenth % 4),
    )
    rows = orders.select(key, "o_custkey", "o_orderstatus", name.alias("name"), F.when(key % 7 == 0, "HR").alias("expected"))
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "name", F.explode(F.array(files.parse_name(F.col("name"), F.col("expected")))).alias("p"))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(read(spark, sf_dir, "orders"))


@query(f"WITH {NAMES} SELECT o_orderkey, error, CASE WHEN error IS NULL THEN dep || '-' || m.k || '-' || m.s END AS document_code, CASE WHEN error IS NULL THEN TRY_CAST(m.v AS INTEGER) END AS version, CASE WHEN error IS NULL THEN replace(m.slug, '-', ' ') END AS title, CASE WHEN error IS NULL THEN lower(m.x) END AS extension FROM p")
def parse_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each file name, or the first thing wrong with it."""
    return _named(spark, sf_dir).select("o_orderkey", "p.error", "p.document_code", "p.version", "p.title", "p.extension")


@query("SELECT r_name AS folder, replace(regexp_replace(upper(r_name), '\\s+', '_', 'g'), '-', '') AS code, lower(replace(regexp_replace(upper(r_name), '\\s+', '_', 'g'), '-', '')) || '_public' AS group_code, 'Phòng ' || r_name || ' Public' AS group_name FROM region")
def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Department codes of folders named `CODE – name`, with their public group."""
    rows = read(spark, sf_dir, "region").select("r_name", files.department(F.concat("r_name", F.lit(" – Phòng "), "r_name")).alias("d"))
    return rows.select(F.col("r_name").alias("folder"), "d.code", F.concat(F.lower("d.code"), F.lit("_public")).alias("group_code"), F.concat("d.name", F.lit(" Public")).alias("group_name"))


VERSIONS = f"""{NAMES}, f AS (SELECT p.o_orderkey AS file_id, o_custkey % 3 AS source, dep || '-' || m.k || '-' || m.s AS document_code, TRY_CAST(m.v AS INTEGER) AS version, m.slug, o_orderstatus, CAST(o.o_orderkey % 3 AS VARCHAR) AS checksum FROM p JOIN orders o ON o.o_orderkey = p.o_orderkey WHERE error IS NULL),
d AS (SELECT * FROM f WHERE o_orderstatus = 'F'), w AS (SELECT * FROM f WHERE o_orderstatus <> 'F')"""


def versions(orders: DataFrame) -> DataFrame:
    """Orders with a good file name as versions of documents."""
    return named(orders).where("p.error IS NULL").select(
        F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") % 3).alias("source"), "p.document_code", "p.version", "p.slug", "o_orderstatus", (F.col("o_orderkey") % 3).cast("string").alias("checksum")
    )


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(read(spark, sf_dir, "orders"))


@query(
    f"""WITH {VERSIONS}, l AS (SELECT source, document_code, max(version) AS latest FROM d GROUP BY ALL), ls AS (SELECT l.*, max(slug) AS latest_slug FROM l JOIN d ON d.source = l.source AND d.document_code = l.document_code AND d.version = l.latest GROUP BY ALL),
    e AS (SELECT source, document_code, version, min(checksum) AS old FROM d GROUP BY ALL)
    SELECT w.file_id, CASE WHEN latest IS NULL AND w.version = 1 THEN 'CREATE' WHEN latest IS NULL THEN 'INITIAL_VERSION_MUST_BE_ONE' WHEN e.old = w.checksum THEN 'DUPLICATE' WHEN e.old IS NOT NULL THEN 'VERSION_CONTENT_CONFLICT'
      WHEN w.version < latest THEN 'OLDER_VERSION' WHEN w.slug <> latest_slug THEN 'DOCUMENT_NAME_MISMATCH' ELSE 'NEW_VERSION' END AS outcome
    FROM w LEFT JOIN ls ON ls.source = w.source AND ls.document_code = w.document_code LEFT JOIN e ON e.source = w.source AND e.document_code = w.document_code AND e.version = w.version"""
)
def version_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each new file, given the versions that are done."""
    rows = _versions(spark, sf_dir)
    done = rows.where("o_orderstatus = 'F'")
    return files.decide_versions(rows.where("o_orderstatus <> 'F'"), done).select("file_id", "outcome")


@query(f"WITH {VERSIONS} SELECT file_id, row_number() OVER (PARTITION BY source, document_code ORDER BY version DESC, file_id) = 1 AS active FROM d")
def activation_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one active version of each document."""
    return files.activate(_versions(spark, sf_dir).where("o_orderstatus = 'F'")).select("file_id", "active")


@query(f"WITH {NAMES}, s AS (SELECT p.o_orderkey, CASE WHEN error IS NOT NULL THEN 'error' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'new' ELSE 'skipped' END AS s FROM p JOIN orders USING (o_orderkey)) SELECT o_orderkey, CASE WHEN s IN ('completed', 'skipped') THEN 'DONE' WHEN s = 'error' THEN 'ERROR' END AS destination FROM s")
def move_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder that each file goes to."""
    rows = _named(spark, sf_dir)
    status = F.when(F.col("p.error").isNotNull(), "error").when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "new").otherwise("skipped")
    return rows.select("o_orderkey", files.destination(status).alias("destination"))


@query(
    """WITH t AS (SELECT o_orderkey AS k, o_orderstatus AS s, 'old' AS name FROM orders WHERE o_orderkey % 4 <> 0), n AS (SELECT o_orderkey AS k, 'N' AS s, 'found' AS name FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT coalesce(t.k, n.k) AS k, CASE WHEN n.k IS NOT NULL AND (t.k IS NULL OR t.s NOT IN ('F', 'P')) THEN n.s ELSE t.s END AS s, CASE WHEN n.k IS NOT NULL AND (t.k IS NULL OR t.s NOT IN ('F', 'P')) THEN n.name ELSE t.name END AS name FROM t FULL JOIN n ON t.k = n.k"""
)
def discovery_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found files over known ones, but not over those in work or done."""
    orders = read(spark, sf_dir, "orders")
    known = orders.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.lit("old").alias("name"))
    found = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.lit("N").alias("s"), F.lit("found").alias("name"))
    return merge.upsert(known, found, ["k"], lambda old, new: ~old("s").isin("F", "P"))
