"""What comes from outside, checked: codes, names, file names, urls, ids, scopes; and sorted choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.functions import names
from marlspark.operators import merge
from marlspark.plans.base import query, read

CODES = """CASE p_partkey % 6 WHEN 0 THEN ' ' || replace(lower(p_name), ' ', '-') || ' ' WHEN 1 THEN upper(p_name) WHEN 2 THEN '_x' || p_partkey WHEN 3 THEN repeat('a', 90 + p_partkey % 20) WHEN 4 THEN NULL ELSE 'k' || p_partkey || '_' || p_size END"""


@query(
    f"""WITH c AS (SELECT p_partkey, trim(coalesce({CODES}, '')) AS code, trim(CASE WHEN p_partkey % 5 = 0 THEN '   ' WHEN p_partkey % 5 = 1 THEN repeat(p_name, 1 + p_partkey % 40) ELSE p_name END) AS name FROM part)
    SELECT p_partkey, CASE WHEN regexp_full_match(code, '[a-z0-9][a-z0-9_-]{{0,99}}') THEN code END AS code, CASE WHEN length(name) BETWEEN 1 AND 200 THEN length(name) END AS name_chars FROM c"""
)
def taxonomy_validators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and names of categories that may be used."""
    key, name = F.col("p_partkey"), F.col("p_name")
    code = (
        F.when(key % 6 == 0, F.concat(F.lit(" "), F.replace(F.lower(name), F.lit(" "), F.lit("-")), F.lit(" "))).when(key % 6 == 1, F.upper(name)).when(key % 6 == 2, F.concat(F.lit("_x"), key)).when(key % 6 == 3, F.repeat(F.lit("a"), (90 + key % 20).cast("int")))
        .when(key % 6 == 4, None).otherwise(F.concat(F.lit("k"), key, F.lit("_"), "p_size"))
    )
    given = F.when(key % 5 == 0, "   ").when(key % 5 == 1, F.repeat(name, (1 + key % 40).cast("int"))).otherwise(name)
    return read(spark, sf_dir, "part").select("p_partkey", names.taxonomy_code(code).alias("code"), F.length(names.taxonomy_name(given)).cast("long").alias("name_chars"))


@query(
    """WITH f AS (SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN 'CON' WHEN 1 THEN ' re:port? ' WHEN 2 THEN 'a/b\\c' || o_custkey % 50 ELSE 'file' || o_custkey % 300 END AS n, CASE o_orderkey % 9 WHEN 0 THEN '.exe' WHEN 1 THEN '.PDF' ELSE '.md' END AS s FROM orders),
    g AS (SELECT k, CASE k % 8 WHEN 0 THEN '_CON' WHEN 1 THEN 're_port_ ' WHEN 2 THEN 'c' || regexp_extract(n, '([0-9]+)$', 1) ELSE n END AS stem, s FROM f WHERE s <> '.exe'),
    r AS (SELECT *, row_number() OVER (PARTITION BY stem, s ORDER BY k) + CASE WHEN stem = 'file7' AND s = '.md' THEN 1 ELSE 0 END AS n FROM g)
    SELECT k, stem || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || s AS stored FROM r"""
)
def stored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name of its own for each file that is stored; one name is taken already."""
    key = F.col("o_orderkey")
    stem = F.when(key % 8 == 0, "CON").when(key % 8 == 1, " re:port? ").when(key % 8 == 2, F.concat(F.lit("a/b\\c"), F.col("o_custkey") % 50)).otherwise(F.concat(F.lit("file"), F.col("o_custkey") % 300))
    name = F.concat(stem, F.when(key % 9 == 0, ".exe").when(key % 9 == 1, ".PDF").otherwise(".md"))
    files = read(spark, sf_dir, "orders").select(key.alias("k"), names.stored_parts(name).alias("p")).where("p IS NOT NULL").select("k", "p.stem", "p.suffix")
    return merge.free_names(files, spark.range(1).select(F.lit("file7.md").alias("name")), "k").select("k", "stored")


HOSTS = ["example.com", "user:pw@example.com", "LOCALHOST:80", "10.1.2.3", "172.31.0.9:8080", "172.32.0.9", "printer.local.", "[::1]", "8.8.8.8", "@example.org", "192.168.0.1.example.com", "100.64.0.1"]


@query(
    f"""WITH u AS (SELECT page_id, {HOSTS}[page_id % 12 + 1] AS h FROM pages)
    SELECT page_id, CASE WHEN page_id % 13 = 0 THEN 'INVALID' WHEN h = 'user:pw@example.com' THEN 'CREDENTIALS' WHEN h IN ('LOCALHOST:80', '10.1.2.3', '172.31.0.9:8080', 'printer.local.', '[::1]', '100.64.0.1') THEN 'LOCAL' END AS reason FROM u"""
)
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why urls of pictures may not be fetched."""
    host = F.get(F.array(*map(F.lit, HOSTS)), (F.col("page_id") % 12).cast("int"))
    url = F.concat(F.when(F.col("page_id") % 13 == 0, "ftp").otherwise("https"), F.lit("://"), host, F.lit("/a.png?u=http://10.0.0.1"))
    return read(spark, sf_dir, "pages").select("page_id", names.unsafe_url(url).alias("reason"))


@query(
    """WITH k AS (SELECT doc_id % 3 = 0 AS fresh, doc_id % 400 AS id, coalesce(source, '-') || CASE WHEN doc_id % 7 = 0 THEN '/x' ELSE '' END AS key FROM documents)
    SELECT id, count(DISTINCT key) AS keys FROM k GROUP BY id HAVING count(DISTINCT key) > 1"""
)
def document_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that stand for several source keys, among documents that are there and those that come."""
    key = F.concat(F.coalesce("source", F.lit("-")), F.when(F.col("doc_id") % 7 == 0, "/x").otherwise(""))
    rows = read(spark, sf_dir, "documents").select((F.col("doc_id") % 400).alias("id"), key.alias("key"), (F.col("doc_id") % 3 == 0).alias("fresh"))
    return merge.id_collisions(rows.where("NOT fresh"), rows.where("fresh"), "id", "key")


@query(
    """WITH t AS (SELECT r_regionkey AS id, r_regionkey <> 3 AS active FROM region), g AS (SELECT n_nationkey AS id, n_regionkey AS type_id, n_nationkey % 7 <> 5 AS active, lower(n_name) AS code FROM nation),
    q AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 7 END AS type_id, CASE WHEN c_custkey % 5 > 1 THEN [c_nationkey, c_custkey % 30] WHEN c_custkey % 4 = 0 THEN [c_nationkey] END AS groups FROM customer),
    a AS (SELECT k, q.type_id, unnest(groups) AS group_id, unnest(range(len(groups))) AS i FROM q WHERE groups IS NOT NULL),
    b AS (SELECT a.k, a.i, g.code, CASE WHEN g.id IS NULL OR NOT g.active THEN 'GROUP_MISSING' WHEN a.type_id IS NOT NULL AND g.type_id <> a.type_id THEN 'GROUP_OF_OTHER_TYPE' WHEN NOT p.active THEN 'PARENT_INACTIVE' END AS error FROM a LEFT JOIN g ON g.id = a.group_id LEFT JOIN t p ON p.id = g.type_id),
    c AS (SELECT k, arg_min(error, i) FILTER (WHERE error IS NOT NULL) AS error, list_distinct(list(code ORDER BY i)) AS codes FROM b GROUP BY k),
    d AS (SELECT q.k, string_agg(g.code, ',' ORDER BY g.code) AS codes FROM q JOIN g ON g.type_id = q.type_id AND g.active WHERE q.groups IS NULL GROUP BY q.k),
    s AS (SELECT q.k, CASE WHEN q.type_id IS NOT NULL AND (t.id IS NULL OR NOT t.active) THEN 'TYPE_MISSING' WHEN c.error IS NOT NULL THEN c.error WHEN q.groups IS NULL AND q.type_id IS NOT NULL AND d.codes IS NULL THEN 'NO_GROUPS' ELSE 'OK' END AS state, q.groups, q.type_id, c.codes AS asked, d.codes AS every FROM q LEFT JOIN t ON t.id = q.type_id LEFT JOIN c ON c.k = q.k LEFT JOIN d ON d.k = q.k)
    SELECT k, state, CASE WHEN state = 'OK' THEN CASE WHEN groups IS NOT NULL THEN array_to_string(list_sort(asked), ',') WHEN type_id IS NOT NULL THEN every END END AS categories FROM s"""
)
def scope_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories of each request's document type and groups, or the first thing wrong with them."""
    key = F.col("c_custkey")
    types = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), (F.col("r_regionkey") != 3).alias("active"))
    groups = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("type_id"), (F.col("n_nationkey") % 7 != 5).alias("active"), F.lower("n_name").alias("code"))
    asked = F.when(key % 5 > 1, F.array(F.col("c_nationkey").cast("long"), key % 30)).when(key % 4 == 0, F.array(F.col("c_nationkey").cast("long")))
    requests = read(spark, sf_dir, "customer").select(key.alias("k"), F.when(key % 4 > 0, key % 7).alias("type_id"), asked.alias("groups"))
    return merge.resolved_scopes(requests, types, groups).select("k", "state", F.array_join(F.array_sort("categories"), ",").alias("categories"))


@query("SELECT 'type' AS field, string_agg(v, '|' ORDER BY lower(v), v) AS choices FROM (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE lower(p_type) END AS v FROM part) UNION ALL SELECT 'status', string_agg(v, '|' ORDER BY lower(v), v) FROM (SELECT DISTINCT upper(trim(p_brand)) AS v FROM part)")
def filter_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a table can be filtered by, sorted without regard to case."""
    kind = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type"))
    pairs = F.array(F.struct(F.lit("type").alias("field"), F.trim(kind).alias("v")), F.struct(F.lit("status").alias("field"), F.upper(F.trim("p_brand")).alias("v")))
    values = read(spark, sf_dir, "part").select(F.inline(pairs)).where("v <> ''").distinct()
    sorted_values = F.transform(F.array_sort(F.collect_list(F.struct(F.lower("v").alias("low"), "v"))), lambda x: x["v"])
    return values.groupBy("field").agg(F.array_join(sorted_values, "|").alias("choices"))


@query(
    """WITH a AS (SELECT page_id % 60 AS document_id, printf('p%04d-%03d-%s.png', (page_id % 9)::INTEGER, (page_id // 60 + 1)::INTEGER, substr(sha256(url), 1, 12)) AS name, page_id FROM pages)
    SELECT document_id, name FROM a WHERE page_id % 4 = 1"""
)
def assets_to_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pictures of documents that their latest extraction doesn't list."""
    from marlspark.functions import web

    page = F.col("page_id")
    name = web.asset_name((page % 9).cast("int"), (F.floor(page / 60) + 1).cast("int"), F.sha2("url", 256))
    stored = read(spark, sf_dir, "pages").select((page % 60).alias("document_id"), name.alias("name"), page)
    return merge.prunable(stored, stored.where("page_id % 4 <> 1"), ["document_id", "name"]).select("document_id", "name")


@query(
    """WITH e AS (SELECT DISTINCT 'c' || p_partkey % 50 AS code FROM part WHERE p_partkey % 3 = 0), n AS (SELECT p_partkey, 'c' || p_partkey % 970 AS code FROM part WHERE p_partkey % 3 <> 0)
    SELECT p_partkey, code, code IN (SELECT code FROM e) OR row_number() OVER (PARTITION BY code ORDER BY p_partkey) > 1 AS conflict FROM n"""
)
def taxonomy_creates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which categories can be created, as each code is given once."""
    key = F.col("p_partkey")
    parts = read(spark, sf_dir, "part")
    there = parts.where(key % 3 == 0).select(F.concat(F.lit("c"), key % 50).alias("code"))
    return merge.created(there, parts.where(key % 3 != 0).select(key, F.concat(F.lit("c"), key % 970).alias("code")), "code", "p_partkey").select("p_partkey", "code", "conflict")
