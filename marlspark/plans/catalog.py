"""Catalog queries. Parts are products (p_name: code, p_brand: vendor, p_type: product type), line items
their variants (l_quantity: stock, l_returnflag: color, l_linestatus: size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspark.functions import text, web
from marlspark.operators import catalog, layout, products
from marlspark.plans.base import query, read


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part")


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    parts = _parts(spark, sf_dir).select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("code"))
    return lines.join(parts, "l_partkey")


VARIANTS = "v AS (SELECT l.*, p_name AS code FROM lineitem l JOIN part ON p_partkey = l_partkey)"


@query("SELECT p_name AS code, count(*) AS n, min(p_partkey) AS first, count(*) > 1 AS multi_source, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS members FROM part GROUP BY p_name")
def group_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products grouped by code."""
    members = F.array_join(F.array_sort(F.collect_list("p_partkey")), ",")
    return _parts(spark, sf_dir).groupBy(F.col("p_name").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"), (F.count(F.lit(1)) > 1).alias("multi_source"), members.alias("members"))


@query(
    """WITH f AS (SELECT p_name AS code, p_brand, min(p_partkey) AS pos FROM part WHERE trim(p_brand) <> '' GROUP BY ALL), g AS (SELECT p_name AS code, p_type, min(p_partkey) AS pos FROM part WHERE trim(p_type) <> '' GROUP BY ALL)
    SELECT code, (SELECT string_agg(p_brand, ',' ORDER BY pos) FROM f WHERE f.code = c.code) AS vendors, (SELECT string_agg(p_type, ',' ORDER BY pos) FROM g WHERE g.code = c.code) AS types FROM (SELECT DISTINCT p_name AS code FROM part) c"""
)
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different vendors and types of each group, in order of appearance."""
    listed = lambda c: F.array_join(catalog.in_order(F.col(c), F.col("p_partkey")), ",")
    return _parts(spark, sf_dir).groupBy(F.col("p_name").alias("code")).agg(listed("p_brand").alias("vendors"), listed("p_type").alias("types"))


@query(
    """WITH p AS (SELECT p_partkey, p_partkey // 3 AS code, p_brand, p_type || '/' || p_size // 20 AS url FROM part), n AS (SELECT code, count(DISTINCT p_brand) AS colors FROM p GROUP BY code),
    r AS (SELECT *, row_number() OVER (PARTITION BY code, url ORDER BY p_partkey) AS k FROM p)
    SELECT code, url, p_partkey, CASE WHEN colors = 1 THEN p_brand END AS color FROM r JOIN n USING (code) WHERE k = 1"""
)
def image_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures by url, first one wins; a color only where the group has just one."""
    rows = _parts(spark, sf_dir).select("p_partkey", F.floor(F.col("p_partkey") / 3).alias("code"), "p_brand", F.concat_ws("/", "p_type", F.floor(F.col("p_size") / 20)).alias("url"))
    first = rows.groupBy("code", "url").agg(F.min_by(F.struct("p_partkey", "p_brand"), "p_partkey").alias("x"))
    colors = rows.groupBy("code").agg(F.count_distinct("p_brand").alias("colors"))
    return first.join(colors, "code").select("code", "url", "x.p_partkey", F.when(F.col("colors") == 1, F.col("x.p_brand")).alias("color"))


DATES = f"""{VARIANTS}, s AS (SELECT code, l_partkey, strftime(min(l_shipdate), '%Y-%m-%d') AS created, coalesce(strftime(min(l_shipdate) FILTER (WHERE l_returnflag = 'R'), '%Y-%m-%d'), '') AS published, strftime(max(l_shipdate), '%Y-%m-%d') AS updated FROM v GROUP BY code, l_partkey)"""


def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    rows = _variants(spark, sf_dir).groupBy("code", "l_partkey").agg(F.min("l_shipdate").alias("c"), F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("p"), F.max("l_shipdate").alias("u"))
    return rows.select("code", "l_partkey", day("c").alias("created"), F.coalesce(day("p"), F.lit("")).alias("published"), day("u").alias("updated"))


@query(f"WITH {DATES} SELECT code, min(nullif(created, '')) AS created_at, min(nullif(published, '')) AS published_at, max(nullif(updated, '')) AS updated_at, min(coalesce(nullif(published, ''), nullif(created, ''))) AS new_at FROM s GROUP BY code")
def business_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of each group as strings; new_at is the least of published, or created where that is blank."""
    real = lambda c: F.nullif(F.trim(c), F.lit(""))
    return _dates(spark, sf_dir).groupBy("code").agg(
        F.min(real("created")).alias("created_at"), F.min(real("published")).alias("published_at"), F.max(real("updated")).alias("updated_at"), F.min(F.coalesce(real("published"), real("created"))).alias("new_at")
    )


@query(
    f"""WITH {VARIANTS} SELECT l_partkey, l_returnflag AS color, bool_or(l_quantity > 45) AS available, coalesce(string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) FILTER (WHERE l_quantity > 45), '') AS sizes FROM v GROUP BY ALL"""
)
def availability_by_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a color is to be had, and in which sizes."""
    ok = F.col("l_quantity") > 45
    return _variants(spark, sf_dir).groupBy("l_partkey", F.col("l_returnflag").alias("color")).agg(F.bool_or(ok).alias("available"), F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("l_linestatus")))), ",").alias("sizes"))


@query(
    f"""WITH {VARIANTS} SELECT code, count(DISTINCT l_extendedprice) AS prices, min(l_extendedprice) AS least, max(l_extendedprice) AS most, CAST(sum(greatest(l_quantity - 10, 0)) AS BIGINT) AS stock, count(*) FILTER (WHERE l_quantity > 10) AS available FROM v GROUP BY code"""
)
def price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and stock of each group."""
    return _variants(spark, sf_dir).groupBy("code").agg(
        F.count_distinct("l_extendedprice").alias("prices"),
        F.min("l_extendedprice").alias("least"),
        F.max("l_extendedprice").alias("most"),
        catalog.stock(F.col("l_quantity") - 10).cast("long").alias("stock"),
        F.count_if(F.col("l_quantity") > 10).alias("available"),
    )


@query(
    """SELECT l_partkey, CASE WHEN bool_or(l_quantity > 48) THEN 'in_stock' WHEN count(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) = count(*) THEN 'out_of_stock' ELSE 'unknown' END AS status FROM lineitem GROUP BY l_partkey"""
)
def inventory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock state of each product; returned variants have no known quantity."""
    known = F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(catalog.inventory_status(known, F.col("l_quantity") > 48).alias("status"))


@query(
    """WITH s AS (SELECT o_custkey, CASE o_orderstatus WHEN 'O' THEN 'archived' WHEN 'P' THEN 'Draft' ELSE CASE WHEN o_orderpriority LIKE '1%' THEN 'active ' ELSE 'FOO' END END AS s FROM orders)
    SELECT o_custkey, coalesce(['ACTIVE', 'UNLISTED', 'DRAFT', 'ARCHIVED'][min(CASE upper(trim(s)) WHEN 'ACTIVE' THEN 1 WHEN 'UNLISTED' THEN 2 WHEN 'DRAFT' THEN 3 WHEN 'ARCHIVED' THEN 4 END)], 'INACTIVE') AS status FROM s GROUP BY o_custkey"""
)
def status_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest status of each group."""
    s = F.when(F.col("o_orderstatus") == "O", "archived").when(F.col("o_orderstatus") == "P", "Draft").when(F.col("o_orderpriority").startswith("1"), "active ").otherwise("FOO")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(catalog.status_of(s).alias("status"))


@query("SELECT p_name AS code, count(*) AS n, count(DISTINCT p_brand) AS vendors FROM part GROUP BY p_name HAVING count(*) > 1 AND count(DISTINCT p_brand) > 1")
def duplicate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that different products share."""
    return _parts(spark, sf_dir).groupBy(F.col("p_name").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_brand").alias("vendors")).where("n > 1 AND vendors > 1")


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The shop's parts and the catalog's: some are on one side only, some differ."""
    parts = _parts(spark, sf_dir).select("p_partkey", "p_name", "p_brand", F.col("p_size").cast("string").alias("p_size"), F.when(F.col("p_size") % 7 == 0, "DRAFT").otherwise("ACTIVE").alias("status"))
    remote = parts.where(F.col("p_partkey") % 11 != 0)
    size = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.col("p_size"), F.lit("x"))).otherwise(F.col("p_size"))
    status = F.when(F.col("p_partkey") % 3 == 0, "ACTIVE").otherwise(F.col("status"))
    local = parts.where(F.col("p_partkey") % 13 != 0).withColumns({"p_size": size, "status": status})
    return remote, local


STATES = """p AS (SELECT p_partkey, p_name, p_brand, CAST(p_size AS VARCHAR) AS p_size, CASE WHEN p_size % 7 = 0 THEN 'DRAFT' ELSE 'ACTIVE' END AS status FROM part),
r AS (SELECT * FROM p WHERE p_partkey % 11 <> 0),
l AS (SELECT p_partkey, p_name, p_brand, CASE WHEN p_partkey % 5 = 0 THEN p_size || 'x' ELSE p_size END AS p_size, CASE WHEN p_partkey % 3 = 0 THEN 'ACTIVE' ELSE status END AS status FROM p WHERE p_partkey % 13 <> 0)"""


@query(
    f"""WITH {STATES} SELECT coalesce(r.p_partkey, l.p_partkey) AS p_partkey, CASE WHEN l.p_partkey IS NULL THEN 'CREATE' WHEN r.p_partkey IS NULL THEN 'INACTIVATE' WHEN r.p_size = l.p_size AND r.status = l.status THEN 'UNCHANGED' ELSE 'UPDATE' END AS action
    FROM r FULL JOIN l ON r.p_partkey = l.p_partkey"""
)
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a full sync does to each product, by fingerprints."""
    remote, local = (x.withColumn("digest", catalog.fingerprint("p_name", "p_brand", "p_size", "status")) for x in _states(spark, sf_dir))
    return catalog.sync_plan(remote, local, "p_partkey", "digest")


@query("SELECT p_partkey, sha256('{\"p_brand\":\"' || p_brand || '\",\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || '}') AS digest FROM part")
def fingerprint_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of each product: its fields as JSON, keys in order."""
    return _parts(spark, sf_dir).select("p_partkey", catalog.fingerprint("p_size", "p_name", "p_brand").alias("digest"))


@query(
    f"""WITH {STATES}, j AS (SELECT coalesce(r.p_partkey, l.p_partkey) AS p_partkey, r.p_partkey IS NULL AS gone, l.p_partkey IS NULL AS fresh, r.p_size IS DISTINCT FROM l.p_size AS size_changed, r.status IS DISTINCT FROM l.status AS status_changed, l.status AS before, r.status AS after FROM r FULL JOIN l ON r.p_partkey = l.p_partkey)
    SELECT p_partkey, CASE WHEN fresh THEN 'CREATED' WHEN gone THEN 'INACTIVATED' WHEN NOT size_changed THEN 'STATUS_CHANGED' ELSE 'UPDATED' END AS change_type, CASE WHEN status_changed THEN before END AS status_before, CASE WHEN status_changed THEN after END AS status_after
    FROM j WHERE fresh OR gone OR size_changed OR status_changed"""
)
def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that differ, how, and both sides of their status if that is among it."""
    remote, local = _states(spark, sf_dir)
    rows = catalog.field_changes(local, remote, "p_partkey", ["p_name", "p_brand", "p_size", "status"])
    side = lambda s: F.try_element_at("changes", F.lit("status"))[s]
    return rows.select("p_partkey", "change_type", side("before").alias("status_before"), side("after").alias("status_after"))


@query(
    """WITH e AS (SELECT user_id, event_id, ts, CAST(user_id % 40 AS VARCHAR) AS old_code, CAST((user_id + CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) % 40 AS VARCHAR) AS new_code FROM events),
    w AS (SELECT * FROM e WHERE ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 120 SECOND AND ts <= TIMESTAMP '2024-01-20 00:00:00')
    SELECT code, count(DISTINCT user_id) AS products FROM (SELECT user_id, old_code AS code FROM w UNION ALL SELECT user_id, new_code FROM w) GROUP BY code"""
)
def delta_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that a window of changes touches: each product's old code and its new one."""
    e = read(spark, sf_dir, "events")
    start, end = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'") - F.expr("INTERVAL 120 SECONDS"), F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    window = e.where((F.col("ts") > start) & (F.col("ts") <= end))
    moved = F.when(F.col("event_type") == "signup", 1).otherwise(0)
    codes = F.array_distinct(F.array((F.col("user_id") % 40).cast("string"), ((F.col("user_id") + moved) % 40).cast("string")))
    return window.select("user_id", F.explode(codes).alias("code")).groupBy("code").agg(F.count_distinct("user_id").alias("products"))


@query(
    f"""WITH {STATES} SELECT r.p_partkey, CASE WHEN l.p_partkey IS NULL AND r.status <> 'ACTIVE' THEN 'SKIP_NEW_NONACTIVE' WHEN l.p_partkey IS NULL THEN 'CREATE_FULL'
    WHEN r.p_size = l.p_size AND r.status = l.status AND r.p_partkey % 17 <> 0 THEN 'SKIP_UNCHANGED' WHEN r.p_size = l.p_size AND r.p_partkey % 17 <> 0 THEN 'STATUS_ONLY' WHEN r.p_partkey % 17 <> 0 THEN 'CATALOG_ONLY' ELSE 'FULL_RECONCILE' END AS action
    FROM r LEFT JOIN l ON r.p_partkey = l.p_partkey"""
)
def delta_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a delta sync does to each changed product."""
    remote, local = _states(spark, sf_dir)
    old = local.select("p_partkey", F.col("p_size").alias("old_size"), F.col("status").alias("old_status"), F.lit(True).alias("known"))
    rows = remote.join(old, "p_partkey", "left")
    action = catalog.delta_action(F.col("known").isNotNull(), F.col("status"), F.col("old_status"), F.col("p_size") == F.col("old_size"), F.col("p_partkey") % 17 != 0)
    return rows.select("p_partkey", action.alias("action"))


REMOTE = """a AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber AS ln, l_partkey AS sku, l_returnflag AS color, l_linestatus AS size, l_quantity AS q, l_suppkey FROM lineitem),
e AS (SELECT id, min(id) AS x FROM a WHERE ln <= 3 GROUP BY id), g AS (SELECT id + 7 AS lid, min(id) AS x FROM a WHERE ln IN (4, 5) GROUP BY id + 7),
c AS (SELECT sku, color, size, min(id) AS x FROM a GROUP BY ALL HAVING count(*) = 1),
m AS (SELECT DISTINCT a.id AS local_id, coalesce(e.x, g.x, c.x) AS remote_id, CASE WHEN e.x IS NOT NULL THEN 'external_id' WHEN g.x IS NOT NULL THEN 'legacy_id' WHEN c.x IS NOT NULL THEN 'composite' ELSE 'missing' END AS how
      FROM a LEFT JOIN e ON e.id = a.id LEFT JOIN g ON g.lid = a.id + 7 LEFT JOIN c ON c.sku = a.sku AND c.color = a.color AND c.size = a.size)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    lines = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_linenumber", F.col("l_partkey").alias("sku"), F.col("l_returnflag").alias("color"), F.col("l_linestatus").alias("size"), "l_quantity", "l_suppkey")
    local = lines.select(F.col("id").alias("local_id"), F.col("id").alias("external_id"), (F.col("id") + 7).alias("legacy_id"), "sku", "color", "size")
    remote = lines.select(
        F.col("id").alias("remote_id"),
        F.when(F.col("l_linenumber") <= 3, F.col("id")).alias("external_id"),
        F.when(F.col("l_linenumber").isin(4, 5), F.col("id") + 7).alias("legacy_id"),
        "sku",
        "color",
        "size",
    )
    return lines, local, remote


@query(f"WITH {REMOTE} SELECT local_id, remote_id, how FROM m")
def variant_match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each local variant's remote one, by external id, legacy id or unique properties."""
    _, local, remote = _sides(spark, sf_dir)
    return catalog.match_variants(local, remote).distinct()


@query(
    f"""WITH {REMOTE}, b AS (SELECT id, min(q) AS q FROM a GROUP BY id), n AS (SELECT id, min(CASE WHEN l_suppkey % 5 = 0 THEN q - 3 ELSE q END) AS q FROM a GROUP BY id)
    SELECT local_id, how, CAST(b.q AS BIGINT) AS before, CAST(n.q AS BIGINT) AS after, b.q > 0 AS before_available, n.q > 0 AS after_available FROM m JOIN b ON b.id = local_id JOIN n ON n.id = remote_id WHERE b.q <> n.q"""
)
def inventory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants whose stock differs from the remote side's, with both."""
    lines, local, remote = _sides(spark, sf_dir)
    before = lines.groupBy(F.col("id").alias("local_id")).agg(F.min("l_quantity").cast("long").alias("before"))
    moved = F.when(F.col("l_suppkey") % 5 == 0, F.col("l_quantity") - 3).otherwise(F.col("l_quantity"))
    after = lines.groupBy(F.col("id").alias("remote_id")).agg(F.min(moved).cast("long").alias("after"))
    rows = catalog.match_variants(local, remote).distinct().join(before, "local_id").join(after, "remote_id").where("before <> after")
    return rows.select("local_id", "how", "before", "after", (F.col("before") > 0).alias("before_available"), (F.col("after") > 0).alias("after_available"))


@query(
    """SELECT count(*) AS products, count(DISTINCT p_name) AS codes, count(*) FILTER (WHERE trim(p_name) = '') AS without_code, count(DISTINCT lower(p_name)) AS folded, count(DISTINCT p_brand) AS vendors, count(*) FILTER (WHERE p_size > 25) AS large,
       (SELECT count(*) FROM (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)) AS shared, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS without_variant FROM part"""
)
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the audit report, in one row."""
    parts = _parts(spark, sf_dir)
    shared = parts.groupBy("p_name").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared"))
    bare = parts.join(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").agg(F.count(F.lit(1)).alias("without_variant"))
    return parts.agg(
        F.count(F.lit(1)).alias("products"),
        F.count_distinct("p_name").alias("codes"),
        F.count_if(F.trim("p_name") == "").alias("without_code"),
        F.count_distinct(F.lower("p_name")).alias("folded"),
        F.count_distinct("p_brand").alias("vendors"),
        F.count_if(F.col("p_size") > 25).alias("large"),
    ).select("*", shared.scalar().alias("shared"), bare.scalar().alias("without_variant"))


@query(
    """WITH g AS (SELECT p_name AS code, count(*) AS n FROM part GROUP BY p_name) SELECT code, n FROM g ORDER BY n DESC, code LIMIT 10"""
)
def dry_run_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten codes with the most products."""
    return _parts(spark, sf_dir).groupBy(F.col("p_name").alias("code")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(10)


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'e') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), '#2')")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that hold all terms of a search, accents and case aside."""
    haystack = text.search_form(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return _parts(spark, sf_dir).where(text.contains_all_terms(haystack, text.search_form(F.lit("É  #2")))).select("p_partkey")


@query("SELECT p_partkey, p_name, n AS total, greatest(1, CAST(ceil(n / 20.0) AS BIGINT)) AS total_pages FROM part, (SELECT count(*) AS n FROM part) ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbered page of products with the total."""
    parts = _parts(spark, sf_dir).select("p_partkey", "p_name")
    total = parts.agg(F.count(F.lit(1)).alias("n")).scalar()
    return parts.orderBy("p_name", "p_partkey").offset(40).limit(20).select("p_partkey", "p_name", total.alias("total"), F.greatest(F.lit(1).cast("long"), F.ceil(total / 20)).alias("total_pages"))


@query(f"WITH {DATES}, d AS (SELECT code, min(coalesce(nullif(published, ''), created)) AS new_at FROM s GROUP BY code) SELECT code, new_at FROM d WHERE new_at >= '1992-01-01' AND new_at < '1999-01-01' ORDER BY new_at DESC, code LIMIT 50")
def catalog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest products of a half-open range of dates."""
    dated = business_dates(spark, sf_dir).select("code", "new_at").where((F.col("new_at") >= "1992-01-01") & (F.col("new_at") < "1999-01-01"))
    return dated.orderBy(F.desc("new_at"), "code").limit(50)


@query("SELECT p_partkey, replace(replace(rtrim(to_base64(encode('{\"after\":' || p_partkey || '}')), '='), '+', '-'), '/', '_') AS cursor FROM part WHERE p_partkey > 100 ORDER BY p_partkey LIMIT 25")
def catalog_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a cursor, each row with the cursor that goes on behind it."""
    page = _parts(spark, sf_dir).where(F.col("p_partkey") > 100).orderBy("p_partkey").limit(25)
    cursor = F.base64(F.encode(F.to_json(F.struct(F.col("p_partkey").alias("after"))), "UTF-8"))
    return page.select("p_partkey", F.rtrim(F.translate(cursor, "+/", "-_"), F.lit("=")).alias("cursor"))


@query("SELECT 'vendor' AS field, p_brand AS value, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'type', p_type, count(*) FROM part GROUP BY p_type")
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values to filter by, with their counts, in one pass."""
    pairs = F.explode(F.map_from_arrays(F.array(F.lit("vendor"), F.lit("type")), F.array("p_brand", "p_type"))).alias("field", "value")
    return _parts(spark, sf_dir).select(pairs).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS title, strpos(html, '<footer>') AS cut, length(CASE WHEN strpos(html, '<footer>') > 0 THEN substr(html, 1, strpos(html, '<footer>') - 1) ELSE html END) AS n,
    CASE WHEN url LIKE '%.html' THEN 'text/html' ELSE 'image/jpeg' END AS mime FROM pages"""
)
def public_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field taken out of a description, the description up to the first marker, and the url's media type."""
    at = F.instr("html", "<footer>")
    path = F.regexp_extract("url", r"^[^?#]*", 0)
    mime = F.when(F.col("url").endswith(".html") & path.endswith(".html"), "text/html").otherwise("image/jpeg")
    return read(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"), at.cast("long").alias("cut"), F.length(F.when(at > 0, F.substr("html", F.lit(1), at - 1)).otherwise(F.col("html"))).cast("long").alias("n"), mime.alias("mime")
    )


@query(f"WITH {STATES}, x AS (SELECT r.p_partkey AS k, 'both' AS side FROM r JOIN l USING (p_partkey) UNION ALL SELECT p_partkey, 'shop' FROM r WHERE p_partkey NOT IN (SELECT p_partkey FROM l) UNION ALL SELECT p_partkey, 'catalog' FROM l WHERE p_partkey NOT IN (SELECT p_partkey FROM r)) SELECT side, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM x GROUP BY side")
def code_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes on both sides and on one only."""
    remote, local = (x.select(F.col("p_partkey").alias("k")) for x in _states(spark, sf_dir))
    parts = [("both", remote.intersect(local)), ("shop", remote.exceptAll(local)), ("catalog", local.exceptAll(remote))]
    rows = parts[0][1].withColumn("side", F.lit("both"))
    for name, part in parts[1:]:
        rows = rows.unionAll(part.withColumn("side", F.lit(name)))
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("keys"))


@query(
    """WITH q AS (SELECT p_partkey AS product, ['R', 'a', 'N', 'x'][p_size % 4 + 1] AS c FROM part), k AS (SELECT q.product, min(l_returnflag) AS asked FROM q JOIN lineitem ON l_partkey = product AND lower(l_returnflag) = lower(c) GROUP BY ALL),
    v AS (SELECT q.product, k.asked, l.*, CASE WHEN l_linestatus = 'O' THEN l_quantity - 40 END AS qty, CASE WHEN l_linenumber < 5 THEN l_quantity > 45 END AS av FROM q LEFT JOIN k USING (product) JOIN lineitem l ON l_partkey = q.product WHERE k.asked IS NULL OR l_returnflag = k.asked)
    SELECT product, asked, count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most, CAST(sum(greatest(qty, 0)) FILTER (WHERE qty IS NOT NULL) AS BIGINT) AS stock, count(*) FILTER (WHERE coalesce(av, false) OR coalesce(qty, 0) > 0) AS available,
      CASE WHEN count(*) FILTER (WHERE coalesce(av, false) OR coalesce(qty, 0) > 0) > 0 THEN 'in_stock' WHEN count(qty) > 0 OR count(av) = count(*) THEN 'out_of_stock' ELSE 'unknown' END AS state FROM v GROUP BY product, asked"""
)
def product_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product as a search result, held to the color that its query asks for."""
    asked = _parts(spark, sf_dir).select(F.col("p_partkey").alias("product"), F.concat(F.lit("Giày màu "), F.get(F.array(*map(F.lit, "RaNx")), (F.col("p_size") % 4).cast("int"))).alias("query"))
    lines = read(spark, sf_dir, "lineitem")
    variants = lines.select(
        F.col("l_partkey").alias("product"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
        F.col("l_returnflag").alias("color"),
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity") - 40).alias("quantity"),
        F.when(F.col("l_linenumber") < 5, F.col("l_quantity") > 45).alias("available"),
    )
    return products.results(variants, asked).withColumn("stock", F.col("stock").cast("long"))


@query(
    """SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]+') THEN url END AS safe, CASE WHEN regexp_matches(regexp_extract(url, '^[^?#]*'), '\\.html$') THEN 'text/html' ELSE 'image/jpeg' END AS mime,
    printf('p%04d-%03d-%s.png', page_id % 9999, page_id % 100, substr(sha256(url), 1, 12)) AS asset FROM pages"""
)
def url_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe urls, media types and asset names of pages."""
    url = F.col("url")
    name = web.asset_name((F.col("page_id") % 9999).cast("int"), (F.col("page_id") % 100).cast("int"), F.sha2("url", 256))
    return read(spark, sf_dir, "pages").select("page_id", web.safe_url(url).alias("safe"), web.mime_of(url).alias("mime"), name.alias("asset"))


@query(
    """WITH r AS (SELECT event_id, user_id, CASE WHEN event_type IN ('signup', 'error') THEN 1 WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'click' THEN 3 END AS level, event_type AS title, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    l AS (SELECT *, max(CASE WHEN level = 1 THEN k END) OVER w AS k1, max(CASE WHEN level = 2 THEN k END) OVER w AS k2, max(CASE WHEN level = 3 THEN k END) OVER w AS k3 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY k))
    SELECT l.event_id, concat_ws('/', a.title, CASE WHEN k2 > coalesce(k1, 0) THEN b.title END, CASE WHEN k3 > coalesce(k1, 0) AND k3 > coalesce(k2, 0) THEN c.title END) AS path
    FROM l LEFT JOIN r a ON a.user_id = l.user_id AND a.k = k1 LEFT JOIN r b ON b.user_id = l.user_id AND b.k = k2 LEFT JOIN r c ON c.user_id = l.user_id AND c.k = k3"""
)
def heading_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's path of headings above it, by a stack of levels kept in windows."""
    kind = F.col("event_type")
    level = F.when(kind.isin("signup", "error"), 1).when(kind == "purchase", 2).when(kind == "click", 3)
    rows = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", level.alias("level"), kind.alias("title"))
    return layout.heading_paths(rows, "user_id", ["ts", "event_id"], "level", "title").select("event_id", F.array_join("path", "/").alias("path"))
