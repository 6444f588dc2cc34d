"""Descriptions, ids, vectors, boxes and laid-out pages, over tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.functions import numeric, text, web
from marlspark.operators import catalog, layout, merge, products
from marlspark.plans.base import query, read


@query(
    """SELECT p_partkey, p_name AS public, CASE WHEN p_size % 4 <> 0 THEN p_type END AS material, CASE WHEN p_size % 4 <> 0 THEN p_brand END AS sole, CASE WHEN p_size % 4 = 2 THEN p_size || ' cm' END AS height FROM part"""
)
def description_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public part of descriptions and the specifications in them."""
    height = F.when(F.col("p_size") % 4 == 2, F.concat(F.lit("\n• Chiều cao : "), "p_size", F.lit(" cm"))).otherwise("")
    rest = F.concat(F.lit("\n- Chất liệu: "), "p_type", F.lit(" - Màu viền: đỏ\nđế:\t"), "p_brand", height, F.lit("\n- Mã SP: 9"))
    description = F.concat(F.lit(" "), "p_name", F.when(F.col("p_size") % 4 != 0, rest).otherwise(" \n"))
    rows = read(spark, sf_dir, "part").select("p_partkey", description.alias("d"))
    return rows.select("p_partkey", web.public_description(F.col("d")).alias("public"), *[web.specification(F.col("d"), k).alias(k) for k in web.SPECS])


@query(
    """WITH b AS (SELECT event_id, event_id % 1100 AS y1, user_id * 7 % 1000 AS x1, event_id * 3 % 1100 AS y2, user_id * 31 % 1000 AS x2 FROM events),
    k AS (SELECT *, event_id % 13 <> 0 AND y1 <= 1000 AND y2 <= 1000 AND x1 < x2 AND y1 < y2 AS ok FROM b)
    SELECT event_id, CASE WHEN ok THEN x1 / 1000 END AS x1, CASE WHEN ok THEN y1 / 1000 END AS y1, CASE WHEN ok THEN x2 / 1000 END AS x2, CASE WHEN ok THEN y2 / 1000 END AS y2 FROM k"""
)
def box_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in thousandths as shares; those that aren't boxes are null."""
    e, u = F.col("event_id"), F.col("user_id")
    box = F.array(e % 1100, u * 7 % 1000, e * 3 % 1100, u * 31 % 1000)
    rows = read(spark, sf_dir, "events").select("event_id", web.parse_box(F.when(e % 13 == 0, F.slice(box, 1, 3)).otherwise(box)).alias("b"))
    return rows.select("event_id", *[F.col(f"b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(
    """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN list_slice(embedding, 1, 3) WHEN vec_id % 10 = 1 THEN list_transform(embedding, lambda x: 0) ELSE embedding END::DOUBLE[] AS v, len(embedding) AS n FROM embeddings)
    SELECT vec_id, CASE WHEN len(v) = n AND list_dot_product(v, v) > 0 THEN round(v[1] / sqrt(list_dot_product(v, v)), 6) END AS first, CASE WHEN len(v) = n AND list_dot_product(v, v) > 0 THEN 1.0::DOUBLE END AS norm FROM e"""
)
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at norm 1; those of a wrong size or of norm 0 are null."""
    k, v = F.col("vec_id") % 10, F.col("embedding")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.size(v).alias("n"), F.when(k == 0, F.slice(v, 1, 3)).when(k == 1, F.transform(v, lambda x: x * 0)).otherwise(v).alias("v"))
    unit = rows.select("vec_id", numeric.unit(F.col("v"), F.col("n")).alias("u"))
    return unit.select("vec_id", F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.sqrt(numeric.dot(F.col("u"), F.col("u"))), 6).alias("norm"))


@query(
    """WITH d AS (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS d FROM pages)
    SELECT page_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || ['8', '9', 'a', 'b'][CAST('0x' || substr(d, 17, 1) AS INTEGER) % 4 + 1] || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS id FROM d"""
)
def url_uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based ids of urls."""
    return read(spark, sf_dir, "pages").select("page_id", numeric.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.col("url")).alias("id"))


@query("SELECT p_partkey, p_name || '/{{other}}/' || coalesce(CAST(CASE WHEN p_size % 3 <> 0 THEN p_size END AS VARCHAR), '') || '#' || p_name AS filled FROM part")
def filled_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates with their values put in; unknown places stay."""
    values = {"name": F.col("p_name"), "size": F.when(F.col("p_size") % 3 != 0, F.col("p_size"))}
    return read(spark, sf_dir, "part").select("p_partkey", text.fill_template(F.lit("{{name}}/{{other}}/{{size}}#{{name}}"), values).alias("filled"))


@query("SELECT n_nationkey, n_nationkey % 4 = 1 AS broad FROM nation")
def broad_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a section is a numbered part of a document, by its last heading."""
    last = F.get(F.array(F.lit("Phần một: "), F.lit("PHẦN IV. "), F.lit("Phần IVa "), F.lit("1. Phần II ")), (F.col("n_nationkey") % 4).cast("int"))
    return read(spark, sf_dir, "nation").select("n_nationkey", text.is_broad_part(F.array(F.lit("Phần I"), F.concat(last, "n_name"))).alias("broad"))


@query(
    """WITH c AS (SELECT o_custkey, o_orderkey, 'c' || o_custkey % 7 AS tag FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_custkey, o_orderkey + 1000000 AS o_orderkey FROM orders WHERE o_custkey % 5 = 0)
    SELECT * FROM c WHERE o_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL SELECT n.o_custkey, n.o_orderkey, coalesce(t.tag, 'new') FROM n LEFT JOIN (SELECT DISTINCT o_custkey, tag FROM c) t USING (o_custkey)"""
)
def document_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks (orders) with those of new documents (customers) in place of the old ones, which hand on their tag."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    chunks = orders.where("o_orderkey % 3 <> 0").withColumn("tag", F.concat(F.lit("c"), F.col("o_custkey") % 7))
    new = orders.where("o_custkey % 5 = 0").select("o_custkey", (F.col("o_orderkey") + 1000000).alias("o_orderkey"), F.lit("new").alias("tag"))
    return merge.replace_document(chunks, new, "o_custkey", ["tag"])


@query(
    """WITH i AS (SELECT l_orderkey AS item, l_partkey AS d, l_linenumber AS p, l_quantity AS x, l_quantity + 4 AS x2, l_suppkey % 40 AS y, l_suppkey % 40 + 2 AS y2 FROM lineitem)
    SELECT item, d AS doc_id, p AS page, x AS x1, y AS y1 FROM i WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = d AND p_size % 7 + 1 = p AND (x + x2) / 2 BETWEEN 10 AND 10 + p_size AND (y + y2) / 2 BETWEEN 5 AND 30)"""
)
def items_outside_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of laid-out pages that are in no table."""
    y = F.col("l_suppkey") % 40
    items = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item"), F.col("l_partkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("x1"), (F.col("l_quantity") + 4).alias("x2"), y.alias("y1"), (y + 2).alias("y2")
    )
    tables = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), (F.col("p_size") % 7 + 1).alias("page"), F.lit(10).alias("x1"), F.lit(5).alias("y1"), (F.col("p_size") + 10).alias("x2"), F.lit(30).alias("y2"))
    return layout.outside_tables(items, tables).select("item", "doc_id", "page", "x1", "y1")


@query(
    """WITH i AS (SELECT l_orderkey % 500 AS d, l_partkey % 9 AS g, l_linenumber AS p FROM lineitem) SELECT d AS doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS digests FROM i
    WHERE (d, g) NOT IN (SELECT (d, g) FROM i GROUP BY d, g HAVING count(DISTINCT p) >= 3) GROUP BY d"""
)
def undecorated_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's images less those that recur on three pages or more."""
    images = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("doc_id"), (F.col("l_partkey") % 9).alias("digest"), F.col("l_linenumber").alias("page"))
    return layout.drop_decoration(images).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("digest").alias("digests"))


@query(
    """WITH s AS (SELECT l_suppkey AS d, 10 + l_linenumber * 0.5 AS z, CAST(l_quantity AS INTEGER) % 5 AS w FROM lineitem), t AS (SELECT d, z, sum(w) AS w FROM s GROUP BY ALL HAVING sum(w) > 0)
    SELECT d AS doc_id, CAST(arg_max(z, (w, -z)) AS DOUBLE) AS body_size FROM t GROUP BY d"""
)
def body_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The font size that most of a document's characters have."""
    shown = F.concat(F.lit(" \t"), F.repeat(F.lit("x "), F.col("l_quantity").cast("int") % 5))
    return layout.body_size(read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_linenumber") * 0.5 + 10).cast("double").alias("font_size"), shown.alias("text")))


@query("SELECT l_orderkey AS doc_id, l_linenumber AS line, sum(l_quantity) FILTER (WHERE l_returnflag = 'N') IS NOT NULL AND sum(l_quantity) FILTER (WHERE l_returnflag = 'N') >= sum(l_quantity) * 0.6 AS bold FROM lineitem GROUP BY ALL")
def bold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the better part of a line is bold."""
    spans = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "N").alias("bold"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("text"))
    return layout.bold_lines(spans)


@query(
    """WITH i AS (SELECT p_name AS product, p_partkey AS id, p_brand AS color, CASE WHEN p_size % 5 = 0 THEN 'ftp://x/' ELSE 'http://x/' END || p_partkey AS url FROM part), u AS (SELECT product, list(url ORDER BY id) AS urls, max(id) AS last FROM i GROUP BY product),
    m AS (SELECT u.product, urls, last, i.color FROM u JOIN i ON i.id = last), h AS (SELECT m.product, arg_min(i.url, i.id) AS hit FROM m JOIN i ON i.product = m.product WHERE i.url LIKE 'http:%' AND (i.id = last OR i.color = m.color) GROUP BY m.product)
    SELECT m.product, CAST(last AS DOUBLE) AS similarity, m.color, hit AS matched_url, sha256(array_to_string(CASE WHEN hit IS NULL THEN urls ELSE list_concat([hit], list_filter(urls, lambda x: x <> hit)) END, ',')) AS urls FROM m LEFT JOIN h USING (product) WHERE last % 4 <> 3"""
)
def product_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched products in use, with the matched picture in front."""
    k = F.col("p_partkey")
    url = F.concat(F.when(F.col("p_size") % 5 == 0, "ftp://x/").otherwise("http://x/"), k)
    picture = F.struct("p_partkey", k.cast("string").alias("checksum"), F.col("p_brand").alias("color"), url.alias("url"))
    groups = read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("product")).agg(F.array_sort(F.collect_list(picture)).alias("images"), F.max_by("p_brand", k).alias("color"), F.max(k).alias("last"))
    matches = groups.select("product", F.col("last").cast("string").alias("checksum"), F.concat(F.lower("color"), F.lit(" ")).alias("color"), F.col("last").cast("double").alias("similarity"))
    status = F.get(F.array(F.lit("active"), F.lit(None), F.lit(" "), F.lit("DRAFT")), (F.col("last") % 4).cast("int"))
    rows = products.details(matches, groups.select("product", status.alias("status"), "images", F.transform("images", lambda i: i["url"]).alias("urls")))
    return rows.select("product", "similarity", F.initcap(F.trim("color")).alias("color"), "matched_url", F.sha2(F.array_join("urls", ","), 256).alias("urls"))


@query(
    """WITH n AS (SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 30.0) AS BIGINT)) AS pages FROM part WHERE p_size > 10), r AS (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_name, p_partkey) AS k FROM part WHERE p_size > 10)
    SELECT p_partkey, p_name, total, pages AS page, pages AS total_pages FROM r, n WHERE k > (pages - 1) * 30"""
)
def catalog_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page of products, by a number beyond it."""
    rows = read(spark, sf_dir, "part").where("p_size > 10").select("p_partkey", "p_name")
    return catalog.numbered_page(rows, 10**6, 30, F.col("p_name"), F.col("p_partkey"))


@query("SELECT p_name AS code, max(p_partkey) AS id, arg_max(p_brand, p_partkey) AS vendor, arg_max(p_size, p_partkey) AS size FROM part WHERE p_name <> '' GROUP BY p_name")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalog by code; of rows that share a code the last counts."""
    rows = read(spark, sf_dir, "part").where("p_name <> ''").select(F.col("p_name").alias("code"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("vendor"), F.col("p_size").alias("size"))
    return merge.latest(rows, ["code"], F.desc("id"))


@query(
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%dT%H:%M:%SZ') END AS stamp FROM events"""
)
def zoned_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps out of urls in UTC: with Z, with an offset, with an offset that lost its plus sign; naive ones are refused."""
    end = F.get(F.array(*map(F.lit, ("Z", "+07:00", " 07:00", ""))), (F.col("event_id") % 4).cast("int"))
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), end)
    return read(spark, sf_dir, "events").select("event_id", web.iso_seconds(web.zoned(raw)).alias("stamp"))
