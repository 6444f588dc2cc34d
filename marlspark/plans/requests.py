"""Queries around a request: its checks and scope, the overlay of metadata, details of what was found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.functions import text, web
from marlspark.operators import merge
from marlspark.plans.base import query, read


@query(
    """SELECT item_id, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN length(text) > 4000 THEN 'too_long' WHEN item_id % 25 > 20 THEN 'top_k' WHEN item_id % 3 = 0 AND item_id % 5 = 0 THEN 'both_scopes' ELSE 'ok' END AS state FROM benchmark"""
)
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether search requests are within bounds: text, number of results, one kind of scope."""
    i = F.col("item_id")
    state = F.when(F.length(F.trim("text")) == 0, "empty").when(F.length("text") > 4000, "too_long").when(i % 25 > 20, "top_k").when((i % 3 == 0) & (i % 5 == 0), "both_scopes").otherwise("ok")
    return read(spark, sf_dir, "benchmark").select("item_id", state.alias("state"))


@query(
    """SELECT r_regionkey AS type_id, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS categories, count(DISTINCT n_nationkey) AS groups
    FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY r_regionkey"""
)
def scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The active categories that a document type stands for, through its groups."""
    active = read(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_nationkey", "c_mktsegment").distinct()
    rows = active.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_regionkey").alias("type_id")).agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("categories"), F.count_distinct("n_nationkey").alias("groups"))


@query(
    """SELECT doc_id, coalesce(nullif(trim(url), ''), source) AS title, CASE WHEN page_id IS NULL THEN lang ELSE 'page' END AS category, page_id IS NOT NULL AS overlaid FROM documents LEFT JOIN pages ON page_id = doc_id"""
)
def metadata_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the file's metadata over their own, where there is any."""
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", F.lit(True).alias("known"))
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(pages, "doc_id", "left")
    return rows.select("doc_id", text.present(F.col("url"), F.col("source")).alias("title"), F.when(F.col("known"), "page").otherwise(F.col("lang")).alias("category"), F.col("known").isNotNull().alias("overlaid"))


@query(
    """WITH g AS (SELECT p_name AS code, list(p_type || '/' || p_size ORDER BY p_partkey) AS urls, arg_max(p_type || '/' || p_size, p_partkey) AS hit FROM part GROUP BY p_name),
    d AS (SELECT code, hit, list_filter(urls, lambda u: u <> hit) AS rest FROM g)
    SELECT code, hit, CAST(1 + len(rest) AS INTEGER) AS n, sha256(array_to_string(list_concat([hit], rest), '|')) AS urls FROM d"""
)
def detail_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's pictures with the one that was matched put first, once."""
    url = F.concat_ws("/", "p_type", "p_size")
    groups = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("code")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", url.alias("url")))), lambda x: x["url"]).alias("urls"), F.max_by(url, "p_partkey").alias("hit")
    )
    moved = F.concat(F.array("hit"), F.array_remove("urls", F.col("hit")))
    return groups.select("code", "hit", F.size(moved).alias("n"), F.sha2(F.array_join(moved, "|"), 256).alias("urls"))


@query(
    """WITH s AS (SELECT upper(p_name) AS code, strftime(min(l_shipdate), '%Y-%m-%d') AS shop FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
    c AS (SELECT p_name AS code, strftime(min(l_shipdate) FILTER (WHERE l_linenumber > 1), '%Y-%m-%d') AS known FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL)
    SELECT c.code, known, shop FROM c JOIN s ON lower(s.code) = lower(c.code) WHERE known IS DISTINCT FROM shop"""
)
def date_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products whose stored date differs from the shop's, matched by code, case aside."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    day = lambda c: F.date_format(F.min(c), "yyyy-MM-dd")
    shop = lines.groupBy(F.upper("p_name").alias("shop_code")).agg(day("l_shipdate").alias("shop"))
    known = lines.groupBy(F.col("p_name").alias("code")).agg(day(F.when(F.col("l_linenumber") > 1, F.col("l_shipdate"))).alias("known"))
    return known.join(shop, text.casefold(F.col("code")) == text.casefold(F.col("shop_code"))).where(~F.col("known").eqNullSafe(F.col("shop"))).select("code", "known", "shop")


@query(
    """SELECT c.c_custkey, o.o_orderkey, n_name AS department FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'P'"""
)
def running_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running jobs with their source and its department."""
    jobs = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    sources = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return jobs.join(sources, "c_custkey").join(read(spark, sf_dir, "nation"), "n_nationkey").select("c_custkey", "o_orderkey", F.col("n_name").alias("department"))


@query(
    """WITH t(a, b) AS (VALUES ('O', 'P'), ('P', 'F'), ('P', 'O')), s AS (SELECT o_orderkey, o_orderstatus AS a, ['O', 'P', 'F'][o_orderkey % 3 + 1] AS b FROM orders)
    SELECT o_orderkey, CASE WHEN t.a IS NOT NULL THEN s.b ELSE s.a END AS status, t.a IS NOT NULL AS moved FROM s LEFT JOIN t ON t.a = s.a AND t.b = s.b"""
)
def guarded_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after a wished change of state, of which only allowed ones happen."""
    wish = F.get(F.array(F.lit("O"), F.lit("P"), F.lit("F")), (F.col("o_orderkey") % 3).cast("int"))
    allowed = F.concat("o_orderstatus", wish).isin("OP", "PF", "PO")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", allowed.alias("moved"), wish.alias("wish"))
    return merge.patch(rows, F.col("moved"), o_orderstatus=F.col("wish")).select("o_orderkey", F.col("o_orderstatus").alias("status"), "moved")


@query(
    """WITH m(category, product_type) AS (VALUES ('shoe', 'PROMO'), ('shoe', 'STANDARD'), ('bag', 'ECONOMY')), p AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS t FROM part)
    SELECT p_partkey FROM p WHERE t IN (SELECT product_type FROM m WHERE category = 'shoe')"""
)
def category_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of the types that a detected category stands for."""
    mapping = F.map_from_arrays(F.array(F.lit("shoe"), F.lit("bag")), F.array(F.array(F.lit("PROMO"), F.lit("STANDARD")), F.array(F.lit("ECONOMY"))))
    parts = read(spark, sf_dir, "part").select("p_partkey", F.get(F.split("p_type", " "), F.lit(0)).alias("product_type"))
    types = parts.select("product_type").distinct().where(F.array_contains(F.try_element_at(mapping, F.lit("shoe")), F.col("product_type")))
    return parts.join(types, "product_type", "left_semi").select("p_partkey")


@query(
    """WITH v AS (SELECT p_name AS code, l_returnflag AS color, bool_or(l_quantity > 49) AS available FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
    SELECT code, '{' || string_agg('"' || color || '":{"available":' || available || '}', ',' ORDER BY color) || '}' AS payload FROM v GROUP BY code"""
)
def availability_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability by color as the payload's nested map, in JSON."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    colors = lines.groupBy(F.col("p_name").alias("code"), F.col("l_returnflag").alias("color")).agg(F.bool_or(F.col("l_quantity") > 49).alias("available"))
    entries = F.array_sort(F.collect_list(F.struct("color", F.struct("available").alias("value"))))
    return colors.groupBy("code").agg(F.to_json(F.map_from_entries(entries)).alias("payload"))


@query(
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"status":"' || CASE WHEN event_type = 'error' THEN 'INACTIVE' ELSE 'ACTIVE' END || '","k":' || coalesce(CAST(json_extract(props, '$.k') AS VARCHAR), 'null') || '}' AS payload FROM events"""
)
def payload_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested payloads with their status set, the rest as it was."""
    payload = F.struct(F.lit("ACTIVE").alias("status"), F.from_json("props", "k long")["k"].alias("k"))
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", payload.alias("p"))
    set_status = F.when(F.col("event_type") == "error", F.col("p").withField("status", F.lit("INACTIVE"))).otherwise(F.col("p"))
    return rows.select("event_id", F.col("p.k").alias("k"), F.to_json(set_status, {"ignoreNullFields": "false"}).alias("payload"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AS inside FROM events")
def utc_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps in UTC to the second, read back from text, and whether they are in a half-open range."""
    text_stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    at = web.utc(text_stamp)
    inside = (at >= F.expr("TIMESTAMP '2024-01-10 00:00:00'")) & (at < F.expr("TIMESTAMP '2024-01-20 00:00:00'"))
    return read(spark, sf_dir, "events").select("event_id", web.iso_seconds(at).alias("stamp"), inside.alias("inside"))
