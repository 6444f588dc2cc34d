"""Reconcile, audit and schedule queries. Parts are a product's pictures or payload (p_name: product, p_type and
p_size: url and checksum, p_brand: color), orders shop products with line items as their variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.functions import text, web
from marlspark.operators import audit, catalog, merge, reconcile, search
from marlspark.plans.base import query, read

PICTURES = """p AS (SELECT p_partkey AS id, p_name AS product, p_brand AS color, p_type || '/' || (p_size % 9) AS url FROM part),
t AS (SELECT DISTINCT product, CASE WHEN id % 97 = 0 THEN '' ELSE url END AS url, color FROM p WHERE id % 3 <> 0),
s AS (SELECT id, product, url, color FROM p WHERE id % 5 <> 0 AND id % 23 <> 0)"""


def _pictures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Wanted pictures, some without checksum, and stored ones, some of which recognition manages."""
    id_, url = F.col("p_partkey"), F.concat(F.col("p_type"), F.lit("/"), F.col("p_size") % 9)
    parts = read(spark, sf_dir, "part").select(F.col("p_name").alias("product"), id_.alias("point_id"), url.alias("url"), F.col("p_brand").alias("color"))
    target = parts.where("point_id % 3 <> 0").select("product", F.when(F.col("point_id") % 97 != 0, F.col("url")).alias("checksum"), "color")
    kind = reconcile.source_kind(F.lit(""), F.when(F.col("point_id") % 23 == 0, "Recognition://x"), F.concat(F.lit("data\\"), F.when(F.col("point_id") % 5 == 0, "recognition").otherwise("shop"), F.lit("\\1.png")))
    return target, parts.select("product", F.col("url").alias("checksum"), "color", "point_id", kind.alias("source_kind"))


@query(
    f"""WITH {PICTURES}, o AS (SELECT DISTINCT product FROM t WHERE url = ''), w AS (SELECT * FROM t WHERE url <> ''),
    k AS (SELECT s.*, w.url IS NOT NULL AS wanted, row_number() OVER (PARTITION BY s.product, s.url, s.color ORDER BY id) AS n, o.product IS NOT NULL AS undecided
          FROM s LEFT JOIN w ON w.product = s.product AND w.url = s.url AND w.color = s.color LEFT JOIN o ON o.product = s.product)
    SELECT product, url AS checksum, color, id AS point_id, CASE WHEN wanted AND n = 1 THEN 'keep' WHEN undecided THEN 'undecided' WHEN wanted THEN 'duplicate' ELSE 'stale' END AS state FROM k
    UNION ALL SELECT product, url, color, NULL, 'missing' FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.product = w.product AND s.url = w.url AND s.color = w.color)"""
)
def image_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is to be done with each picture: keep, missing, stale, duplicate or undecided."""
    return reconcile.reconcile_images(*_pictures(spark, sf_dir))


@query(
    """WITH p AS (SELECT p_name AS product, p_type || '/' || p_size AS url, p_partkey AS id FROM part),
    u AS (SELECT product, url, bool_or(id % 3 <> 0) AS was, bool_or(id % 4 <> 0) AS now, bool_or(id % 3 <> 0 AND id % 2 = 0) AS e FROM p GROUP BY ALL HAVING bool_or(id % 3 <> 0) OR bool_or(id % 4 <> 0))
    SELECT product, coalesce(string_agg(url, ',' ORDER BY url) FILTER (WHERE NOT was), '') AS added, coalesce(string_agg(url, ',' ORDER BY url) FILTER (WHERE NOT now), '') AS removed,
      sha256(coalesce(string_agg(url, ',' ORDER BY url) FILTER (WHERE was AND now), '')) AS unchanged, count(*) FILTER (WHERE NOT was) AS n_added, count(*) FILTER (WHERE NOT now) AS n_removed,
      count(*) FILTER (WHERE was AND now) AS n_unchanged, count(*) FILTER (WHERE was AND now AND e) AS n_embedded, count(*) FILTER (WHERE NOT was) > 0 AS must_embed FROM u GROUP BY product"""
)
def url_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's picture urls before and after, compared."""
    rows = read(spark, sf_dir, "part").select(F.col("p_name").alias("product"), F.concat_ws("/", "p_type", "p_size").alias("url"), "p_partkey")
    old = rows.where("p_partkey % 3 <> 0").select("product", "url", (F.col("p_partkey") % 2 == 0).alias("embedded"))
    changes = reconcile.url_changes(old, rows.where("p_partkey % 4 <> 0"))
    return changes.withColumns({"added": F.array_join("added", ","), "removed": F.array_join("removed", ","), "unchanged": F.sha2(F.array_join("unchanged", ","), 256)})


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


@query(
    """WITH v AS (SELECT l_partkey AS k, CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS e, l_returnflag AS c, l_linestatus AS z, CAST(l_suppkey AS VARCHAR) AS s, CAST(round(l_extendedprice * 100) AS BIGINT) AS x, CASE WHEN l_linenumber > 3 THEN CAST(round(l_tax * 100) AS BIGINT) END AS q FROM lineitem),
    j AS (SELECT k, string_agg('{"barcode":"","color":"' || c || '","compare_at_price":' || coalesce(CAST(q AS VARCHAR), 'null') || ',"external_id":"' || e || '","price":' || x || ',"size":"' || z || '","sku":"' || s || '","variant_title":""}', ',' ORDER BY e, c, z, s, q NULLS FIRST, x) AS v FROM v GROUP BY k)
    SELECT p_partkey, sha256('{"description":"","height":"","material":"' || p_type || '","product_code":"' || p_name || '","product_type":"' || p_type || '","sole":"","sources":[{"id":"1","status":"DRAFT"},{"id":"' || p_size + 2 || '","status":"ACTIVE"}],"status":"ACTIVE","title":"' || p_name || '","variants":[' || v || '],"vendor":"' || p_brand || '"}') AS digest
    FROM part JOIN j ON k = p_partkey"""
)
def product_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of products by sorted snapshots of their variants and sources."""
    of_variant = {"external_id": F.col("l_orderkey") * 10 + F.col("l_linenumber"), "sku": F.col("l_suppkey"), "barcode": F.lit(None), "variant_title": F.lit(" "), "color": F.concat(F.lit(" "), "l_returnflag"), "size": F.col("l_linestatus")}
    variant = F.struct(*[c.cast("string").alias(n) for n, c in of_variant.items()], _cents("l_extendedprice").alias("price"), F.when(F.col("l_linenumber") > 3, _cents("l_tax")).alias("compare_at_price"))
    variants = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_list(variant).alias("variants"))
    rows = read(spark, sf_dir, "part").join(variants, "p_partkey")
    empty = F.lit(None).cast("string")
    product = F.struct(
        F.col("p_name").alias("product_code"), F.col("p_name").alias("title"), F.col("p_type").alias("product_type"), empty.alias("description"),
        F.col("p_brand").alias("vendor"), F.concat("p_type", F.lit("\n")).alias("material"), empty.alias("sole"), empty.alias("height"),
    )
    source = lambda i, s: F.struct(i.cast("string").alias("id"), F.lit(s).alias("status"))
    sources = F.array(source(F.col("p_size") + 2, "active "), source(F.lit(1), "Draft"))
    return rows.select("p_partkey", reconcile.product_digest(product, F.col("variants"), sources, F.lit("ACTIVE")).alias("digest"))


@query(
    """WITH i AS (SELECT p_name, p_partkey AS k, p_brand AS c, p_type AS t, CASE WHEN p_size % 5 <> 0 THEN p_size END AS o FROM part)
    SELECT p_name AS code, sha256('[' || string_agg('{"alt_text":"' || t || '","color":"' || c || '","external_id":"' || k || '","height":2,"image_order":' || coalesce(CAST(o AS VARCHAR), 'null') || ',"source_url":"u","width":null}', ',' ORDER BY c, coalesce(o, 0), CAST(k AS VARCHAR)) || ']') AS digest FROM i GROUP BY p_name"""
)
def image_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each product's pictures, sorted by color and order."""
    picture = F.struct(
        F.col("p_partkey").cast("string").alias("external_id"), F.col("p_brand").alias("color"), F.lit(" u").alias("source_url"), F.col("p_type").alias("alt_text"),
        F.lit(None).cast("int").alias("width"), F.lit(2).alias("height"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("image_order"),
    )
    rows = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("code")).agg(F.collect_list(picture).alias("pictures"))
    return rows.select("code", reconcile.digest(reconcile.image_snapshot(F.col("pictures"))).alias("digest"))


@query(
    """SELECT p_partkey, replace('{"status":"#","public_info":{"name":"' || p_name || '","status":"#"},"summary":{"n":' || p_size || ',"status":"#","ai_ready":false},"detail":{"product":{"status":"#"},"n":' || p_size || '}}', '#',
      CASE p_size % 3 WHEN 0 THEN 'INACTIVE' WHEN 1 THEN 'ARCHIVED' ELSE 'DRAFT' END) AS payload FROM part"""
)
def inactive_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads taken out of use: status in all four places, no longer ready."""
    live = F.lit("ACTIVE").alias("status")
    payload = F.struct(
        live, F.struct(F.col("p_name").alias("name"), live).alias("public_info"), F.struct(F.col("p_size").alias("n"), live, F.lit(True).alias("ai_ready")).alias("summary"),
        F.struct(F.struct(live).alias("product"), F.col("p_size").alias("n")).alias("detail"),
    )
    wanted = F.when(F.col("p_size") % 3 == 0, "  ").when(F.col("p_size") % 3 == 1, " archived").otherwise("Draft")
    return read(spark, sf_dir, "part").select("p_partkey", payload.alias("payload"), wanted.alias("s")).select("p_partkey", F.to_json(reconcile.inactive(F.col("payload"), F.col("s"))).alias("payload"))


@query(
    """WITH v AS (SELECT l_orderkey AS product, l_returnflag AS c, l_linestatus AS z, arg_max(l_quantity > 25, (l_linenumber, l_quantity)) AS a FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL)
    SELECT p.l_orderkey AS product, l_returnflag AS color, l_linestatus AS size, coalesce(bool_or(a), false) AS available, count(*) AS n FROM lineitem p LEFT JOIN v ON product = p.l_orderkey AND c = l_returnflag AND z = l_linestatus GROUP BY ALL"""
)
def availability_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price rows of each product with the availability of its variants, of which the last decides."""
    row = F.struct("l_linenumber", "l_quantity", F.col("l_returnflag").alias("color"), F.col("l_linestatus").alias("size"), (F.col("l_quantity") > 25).alias("available"))
    price = F.struct(F.col("l_returnflag").alias("color"), F.concat("l_linestatus", F.lit(" ")).alias("size"), F.lit(False).alias("available"))
    groups = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("product")).agg(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") <= 3, row))).alias("variants"), F.collect_list(price).alias("prices"))
    rows = groups.select("product", F.inline(reconcile.overwrite_availability(F.col("prices"), F.col("variants"))))
    return rows.groupBy("product", "color", F.trim("size").alias("size")).agg(F.bool_or("available").alias("available"), F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 3 THEN l_returnflag ELSE '' END AS color, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE '' END AS size FROM lineitem")
def option_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Color and size of variants from options with names of their own."""
    option = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    name = F.get(F.array(*map(F.lit, ("MÀU sắc", "colour ", "Màu", "Chất liệu"))), F.col("l_linenumber") % 4)
    options = F.array(option(F.lit("Title"), F.lit("x")), option(name, F.concat(F.lit(" "), "l_returnflag")), option(F.when(F.col("l_linenumber") % 2 == 0, "Kích-cỡ"), F.col("l_linestatus")))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", options.alias("o"))
    return rows.select("l_orderkey", "l_linenumber", reconcile.option_value(F.col("o"), *reconcile.COLOR).alias("color"), reconcile.option_value(F.col("o"), *reconcile.SIZE).alias("size"))


SHOP = """x AS (SELECT l_orderkey AS product, 'sku-' || l_partkey AS sku, min(l_linenumber) AS pos FROM lineitem WHERE l_orderkey % 50 <> 0 AND NOT (l_linenumber = 1 AND l_orderkey % 9 = 0) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY pos, sku) AS n FROM x), p AS (SELECT DISTINCT l_orderkey AS product FROM lineitem), f AS (SELECT p.product, sku AS first_code FROM p LEFT JOIN o ON o.product = p.product AND n = 1),
c AS (SELECT CASE WHEN p_partkey % 29 = 0 THEN ' ' WHEN p_partkey % 7 = 0 THEN 'SKU-' || p_partkey ELSE 'sku-' || p_partkey END AS code FROM part, range(1, 3) r(i) WHERE p_partkey % 11 <> 0 AND (i = 1 OR p_partkey % 31 = 0)),
d AS (SELECT DISTINCT code FROM c WHERE code <> ' '),
m AS (SELECT f.product, first_code, first_code IS NOT NULL AND first_code IN (SELECT code FROM d) AS matched_first, coalesce((SELECT string_agg(DISTINCT sku, ' | ' ORDER BY sku) FROM o WHERE o.product = f.product AND sku IN (SELECT code FROM d)), '') AS matched_any,
      CASE WHEN first_code IN (SELECT code FROM d) THEN '' ELSE coalesce((SELECT string_agg(code, ' | ' ORDER BY code) FROM d WHERE lower(code) = lower(first_code)), '') END AS candidates FROM f)"""


def _shop(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("product"), "l_linenumber", "l_partkey")
    blank = (F.col("product") % 50 == 0) | ((F.col("l_linenumber") == 1) & (F.col("product") % 9 == 0))
    skus = catalog.in_order(F.when(~blank, F.concat(F.lit("sku-"), "l_partkey")), F.col("l_linenumber"))
    k = F.col("p_partkey")
    code = F.when(k % 29 == 0, " ").otherwise(F.concat(F.when(k % 7 == 0, "SKU-").otherwise("sku-"), k))
    rows = read(spark, sf_dir, "part").where("p_partkey % 11 <> 0").select(F.explode(F.array_repeat(code, F.when(k % 31 == 0, 2).otherwise(1))).alias("code"))
    return lines.groupBy("product").agg(skus.alias("skus")), rows


@query(f"WITH {SHOP} SELECT * FROM m")
def audit_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each shop product's catalog codes: by its first SKU, by any, or but for case."""
    rows = audit.matches(*_shop(spark, sf_dir))
    return rows.withColumns({c: F.array_join(c, " | ") for c in ("matched_any", "candidates")})


@query(
    f"""WITH {SHOP}, s AS (SELECT sku, count(*) AS n FROM o GROUP BY sku), g AS (SELECT first_code, count(*) AS n FROM f WHERE first_code IS NOT NULL GROUP BY first_code)
    SELECT (SELECT count(*) FROM c) AS catalog_rows, (SELECT count(*) FROM d) AS catalog_codes, (SELECT count(*) FROM (SELECT code FROM c WHERE code <> ' ' GROUP BY code HAVING count(*) > 1)) AS catalog_duplicates, (SELECT count(*) FROM c WHERE code = ' ') AS catalog_blank,
      (SELECT count(*) FROM g) AS first_skus, (SELECT count(*) FROM g WHERE n > 1) AS duplicate_first_skus, (SELECT count(*) FROM s) AS variant_skus, (SELECT count(*) FROM s WHERE n > 1) AS shared_skus,
      (SELECT count(*) FROM g WHERE first_code IN (SELECT code FROM d)) AS matched_codes, (SELECT count(*) FROM d WHERE code NOT IN (SELECT first_code FROM g)) AS codes_not_first, (SELECT count(*) FROM d WHERE code NOT IN (SELECT sku FROM s)) AS codes_in_no_variant,
      count(*) AS products, count(*) FILTER (WHERE first_code IS NULL) AS without_sku, count(*) FILTER (WHERE matched_first) AS matched_first, count(*) FILTER (WHERE matched_any <> '') AS matched_any, count(*) FILTER (WHERE matched_any = '') AS unmatched, count(*) FILTER (WHERE candidates <> '') AS case_only FROM m"""
)
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit's counts, in one row."""
    return audit.counts(*_shop(spark, sf_dir))


@query(
    """WITH r AS (SELECT p_size, ['SKIP_UNCHANGED', 'CREATE_FULL', 'STATUS_ONLY', 'CATALOG_ONLY', 'FULL_RECONCILE', 'SKIP_NEW_NONACTIVE'][p_size % 6 + 1] AS a FROM part)
    SELECT count(*) AS processed, count(*) FILTER (WHERE a LIKE 'SKIP%') AS skipped, count(*) FILTER (WHERE a = 'CREATE_FULL') AS created, count(*) FILTER (WHERE a IN ('CATALOG_ONLY', 'FULL_RECONCILE')) AS updated, count(*) FILTER (WHERE a = 'STATUS_ONLY') AS inactivated,
      CAST(sum(CASE WHEN a = 'CREATE_FULL' THEN p_size ELSE 0 END) AS BIGINT) AS new_embeddings, CAST(sum(CASE WHEN a = 'FULL_RECONCILE' THEN 1 ELSE 0 END) AS BIGINT) AS removed FROM r"""
)
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's results by action, with the pictures it embedded and removed."""
    actions = ("SKIP_UNCHANGED", "CREATE_FULL", "STATUS_ONLY", "CATALOG_ONLY", "FULL_RECONCILE", "SKIP_NEW_NONACTIVE")
    rows = read(spark, sf_dir, "part").select(F.get(F.array(*map(F.lit, actions)), F.col("p_size") % 6).alias("action"), "p_size")
    return reconcile.run_statistics(rows.select("action", F.when(F.col("action") == "CREATE_FULL", F.col("p_size")).alias("new_embeddings"), F.when(F.col("action") == "FULL_RECONCILE", 1).alias("removed")))


@query(
    """SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_brand <> 'Brand#13' AND p_size % 2 = 0 AND p_size % 4 <> 0 AND (p_partkey % 10 = 3 OR (p_partkey % 10 = 0 AND p_name LIKE 'cold%'))"""
)
def embedding_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that a query may be compared with: the same embedding model, in use, of the asked group."""
    like = search.compatible(F.col("p_type"), F.when(F.col("p_brand") != "Brand#13", "m"), F.col("p_size") % 2, F.when(F.col("p_size") % 4 == 0, False), ("ECONOMY", "m", 0))
    group = F.get(F.array(F.lit(None), *[F.lit(f" {i} " if i % 2 else f"g{i}") for i in range(1, 10)]), (F.col("p_partkey") % 10).cast("int"))
    return read(spark, sf_dir, "part").where(like & search.in_group(group, F.regexp_extract("p_name", "^[a-z]+", 0), 3, ["cold"])).select("p_partkey")


@query(
    """SELECT event_id, 'daily:' || strftime(timezone(z, timezone('UTC', ts)), '%Y-%m-%d') || ':full' AS dedupe_key FROM (SELECT *, ['Asia/Ho_Chi_Minh', 'Europe/Berlin', 'America/New_York'][event_id % 3 + 1] AS z FROM events)
    WHERE strftime(timezone(z, timezone('UTC', ts)), '%H:%M:%S') >= '06:30:00'"""
)
def daily_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments at which a daily run is due by the clock of its own time zone, with the run's key."""
    zone = F.get(F.array(*map(F.lit, ("Asia/Ho_Chi_Minh", "Europe/Berlin", "America/New_York"))), (F.col("event_id") % 3).cast("int"))
    moment = F.to_utc_timestamp(F.col("ts").cast("timestamp"), "UTC")
    return read(spark, sf_dir, "events").select("event_id", web.daily_key(moment, zone, F.lit("06:30:00"), F.lit("full")).alias("dedupe_key")).where("dedupe_key IS NOT NULL")


@query(
    """WITH o AS (SELECT *, TIMESTAMP '1998-08-02 00:00:00' AS now, o_orderkey % 11 = 0 AS requested, o_orderstatus = 'P' AS running, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate + INTERVAL 400 DAY END AS retry, o_orderkey % 5 <> 0 AS enabled, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS last FROM orders)
    SELECT o_orderkey, strftime(CASE WHEN requested THEN now WHEN running THEN NULL WHEN retry > now THEN retry WHEN enabled THEN coalesce(last + to_hours(o_custkey % 24 + 1), now) END, '%Y-%m-%d %H:%M:%S') AS next_run FROM o"""
)
def next_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each scheduled job runs next."""
    now, at, key = F.expr("TIMESTAMP_NTZ '1998-08-02 00:00:00'"), F.col("o_orderdate"), F.col("o_orderkey")
    retry = F.when(key % 7 == 0, at + F.expr("INTERVAL 400 DAYS"))
    run = web.next_run(now, key % 11 == 0, F.col("o_orderstatus") == "P", retry, key % 5 != 0, F.when(key % 3 != 0, at), (F.col("o_custkey") % 24 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(run, "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@query(
    """WITH n AS (SELECT event_id, user_id % 6 AS u, event_id % 3 AS v FROM events)
    SELECT event_id, CASE WHEN u % 3 = 0 AND v = 0 THEN NULL ELSE greatest(CASE WHEN u % 3 <> 0 THEN u + 0.5 END, CASE WHEN v <> 0 THEN v * 2 END) END::DOUBLE AS seconds, CASE WHEN u = 0 THEN '' WHEN u % 2 = 0 THEN 'day' ELSE 'day,minute' END AS windows FROM n"""
)
def quota_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long errors ask to wait, and for which quotas."""
    u, v = F.col("user_id") % 6, F.col("event_id") % 3
    delay = F.when(u % 3 == 0, "soon").otherwise(F.concat(u, F.lit(".5s")))
    quotas = F.when(u == 0, "[]").when(u % 2 == 0, '[{"quotaId":"RequestsPerDay"}]').otherwise('[{"quotaId":"PerMinute"},{"quotaId":"x-day","quotaValue":"0"}]')
    raw = F.concat(F.lit('[{"violations":'), quotas, F.lit('},{"retryDelay":"'), delay, F.lit('"}]'))
    rows = read(spark, sf_dir, "events").select("event_id", F.from_json(raw, web.QUOTA).alias("d"), F.when(v != 0, (v * 2).cast("string")).otherwise("later").alias("header"))
    return rows.select("event_id", web.retry_after(F.col("d"), F.col("header")).alias("seconds"), F.array_join(web.quota_windows(F.col("d")), ",").alias("windows"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 8 > 5 THEN 'statements' WHEN doc_id % 8 = 0 OR doc_id % 5 = 0 THEN 'citations' WHEN length(text) > 2000 THEN 'length' ELSE 'ok' END AS state FROM documents"""
)
def citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether answers may go out: number of statements, their sources, length."""
    n, bad = (F.col("doc_id") % 8).cast("int"), F.col("doc_id") % 5 == 0
    ids = F.when(n > 0, F.array_repeat(F.array(F.lit(1), F.when(bad, 9).otherwise(3)), n)).otherwise(F.array(F.array().cast("array<int>")))
    return read(spark, sf_dir, "documents").select("doc_id", text.citation_state(ids, F.col("text"), 4, 5, 2000).alias("state"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) THEN 'documents' WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2) THEN 'children' END AS refused FROM part"""
)
def taxonomy_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which groups may be deleted, and what forbids it for the others."""
    uses = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return merge.deletable(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", documents=uses.where("l_quantity > 49"), children=uses.where("l_quantity < 2"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE value END AS n, replace(replace(props, '\\', '\\\\'), '"', '\\"') AS escaped FROM events""")
def cleaned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of text, and text made fit for a quoted search."""
    raw = F.concat(F.lit(" "), F.col("value").cast("decimal(18, 2)").cast("string"), F.when(F.col("event_id") % 4 == 3, " USD").otherwise("\t"))
    return read(spark, sf_dir, "events").select("event_id", text.number(raw).alias("n"), web.escape_search(F.col("props")).alias("escaped"))
