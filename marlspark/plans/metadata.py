"""Metadata queries: taxonomy, jobs, dashboards, keyed writes. Regions and nations stand for document types
and groups, customers for sources, orders for jobs (F done, O pending, P running), dated by o_orderdate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspark.functions import numeric
from marlspark.operators import merge
from marlspark.plans.base import query, read

NOW = "TIMESTAMP '1998-08-02 00:00:00'"


def _now() -> F.Column:
    return F.expr("TIMESTAMP_NTZ '1998-08-02 00:00:00'")


@query("SELECT r_name AS type, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS groups, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def taxonomy_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types with their groups nested in order."""
    groups = read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("g"))
    rows = read(spark, sf_dir, "region").join(groups, "r_regionkey", "left")
    return rows.select(F.col("r_name").alias("type"), F.coalesce(F.array_join(F.col("g.n_name"), ","), F.lit("")).alias("groups"), F.coalesce(F.size("g"), F.lit(0)).cast("long").alias("n"))


@query("SELECT n_name AS grp, r_name AS type FROM nation JOIN region ON n_regionkey = r_regionkey")
def taxonomy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with their type."""
    return read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("grp"), F.col("r_name").alias("type"))


@query(
    """WITH c AS (SELECT n_nationkey, count(*) FILTER (WHERE c_nationkey = n_nationkey OR (c_nationkey IS NULL AND c_mktsegment = n_name)) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey)
    SELECT n_name AS grp, n FROM c JOIN nation USING (n_nationkey)"""
)
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each group; those without a group count by their category's name."""
    groups = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    counted = read(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    by_id = counted.where(F.col("c_nationkey").isNotNull()).select(F.col("c_nationkey").alias("n_nationkey"), "n")
    by_name = counted.where(F.col("c_nationkey").isNull()).join(groups, F.col("c_mktsegment") == F.col("n_name")).select("n_nationkey", "n")
    found = by_id.unionAll(by_name).groupBy("n_nationkey").agg(F.sum("n").alias("n"))
    return groups.join(found, "n_nationkey", "left").select(F.col("n_name").alias("grp"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(
    """SELECT c_custkey, coalesce(a.total, 0) AS total, coalesce(a.done, 0) AS done, l.o_orderkey AS latest, l.o_orderstatus AS status
    FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey) a ON a.o_custkey = c_custkey
    LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1) l ON l.o_custkey = c_custkey"""
)
def dashboard_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source with the counts of its jobs and its latest job."""
    jobs = read(spark, sf_dir, "orders")
    counts = jobs.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    last = jobs.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("l"))
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey"), F.col("c_custkey").alias("o_custkey")).join(counts, "o_custkey", "left").join(last, "o_custkey", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("c_custkey", zero("total"), zero("done"), F.col("l.o_orderkey").alias("latest"), F.col("l.o_orderstatus").alias("status"))


@query(
    f"""SELECT c_custkey, max(o_orderdate) AS last_scan FROM customer LEFT JOIN orders ON o_custkey = c_custkey
    WHERE NOT EXISTS (SELECT 1 FROM orders a WHERE a.o_custkey = c_custkey AND a.o_orderstatus = 'P')
    GROUP BY c_custkey HAVING max(o_orderdate) IS NULL OR max(o_orderdate) + INTERVAL 90 DAY <= {NOW}"""
)
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources without a running job whose last scan is 90 days back, or that never had one."""
    jobs = read(spark, sf_dir, "orders")
    last = jobs.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_scan"))
    running = jobs.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    rows = read(spark, sf_dir, "customer").select("c_custkey").join(running, "c_custkey", "left_anti").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.where(F.col("last_scan").isNull() | (F.col("last_scan") + F.expr("INTERVAL 90 DAYS") <= _now())).select("c_custkey", "last_scan")


@query("SELECT o_custkey, o_orderkey, k = 1 AS keeps FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders WHERE o_orderstatus IN ('O', 'P'))")
def oldest_active_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active jobs, of which each source keeps the oldest."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_custkey", "o_orderkey", (F.row_number().over(order) == 1).alias("keeps"))


@query("SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS changes FROM orders")
def scalar_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with the number of their changes."""
    counted = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("changes"))
    return read(spark, sf_dir, "orders").select("o_orderkey").join(counted, "o_orderkey", "left").select("o_orderkey", F.coalesce("changes", F.lit(0)).cast("long").alias("changes"))


@query(
    """SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100"""
)
def jobs_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of the job history, with the total."""
    jobs = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    page = jobs.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(100).limit(50)
    return page.select("o_orderkey", "o_orderstatus", jobs.agg(F.count(F.lit(1)).alias("n")).scalar().alias("total"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' OR o_orderstatus = 'P' AND o_orderkey % 1024 = 0 ORDER BY o_orderstatus = 'P' DESC, o_orderkey LIMIT 20")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of the queue: running jobs, then the oldest ids."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").where("o_orderstatus = 'O' OR o_orderstatus = 'P' AND o_orderkey % 1024 = 0")
    return rows.orderBy(F.desc(F.col("o_orderstatus") == "P"), "o_orderkey").limit(20)


@query(
    """WITH t AS (SELECT doc_id, source, n_chars FROM documents), s AS (SELECT page_id * 3 + 500 AS doc_id, 'page' AS source, CAST(length(html) AS BIGINT) AS n_chars FROM pages)
    SELECT * FROM t UNION ALL SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = s.doc_id)"""
)
def upsert_do_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the pages of ids that they lack."""
    target = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    source = read(spark, sf_dir, "pages").select((F.col("page_id") * 3 + 500).alias("doc_id"), F.lit("page").alias("source"), F.length("html").cast("long").alias("n_chars"))
    return merge.insert_new(target, source, ["doc_id"])


@query(
    """WITH t AS (SELECT doc_id, source, n_chars FROM documents), s AS (SELECT page_id * 3 + 500 AS doc_id, 'page' AS source, CAST(length(html) AS BIGINT) AS n_chars FROM pages)
    SELECT coalesce(t.doc_id, s.doc_id) AS doc_id, CASE WHEN t.doc_id IS NULL OR s.n_chars > t.n_chars THEN s.source ELSE t.source END AS source,
           CASE WHEN t.doc_id IS NULL OR s.n_chars > t.n_chars THEN s.n_chars ELSE t.n_chars END AS n_chars FROM t FULL JOIN s ON t.doc_id = s.doc_id"""
)
def upsert_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the pages' rows, where those are longer or new."""
    target = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    source = read(spark, sf_dir, "pages").select((F.col("page_id") * 3 + 500).alias("doc_id"), F.lit("page").alias("source"), F.length("html").cast("long").alias("n_chars"))
    return merge.upsert(target, source, ["doc_id"], lambda old, new: new("n_chars") > old("n_chars"))


@query("SELECT doc_id, CASE WHEN source = 'src3' THEN 'public' ELSE lang END AS category, quality IS NOT DISTINCT FROM 0 AS inactive FROM documents LEFT JOIN labels USING (doc_id)")
def payload_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the category of one source changed, and their flag."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("category"))
    patched = merge.patch(rows, F.col("source") == "src3", category=F.lit("public"))
    return patched.join(read(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "category", F.coalesce(F.col("quality") == 0, F.lit(False)).alias("inactive"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL HAVING count(*) > 1")
def invariant_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with more than one open row."""
    return merge.violations(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_linestatus") == "O")


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus WHEN attempts >= 3 THEN 'failed' ELSE 'O' END AS status
    FROM (SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS attempts FROM orders)"""
)
def job_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after a restart: running ones wait again, or fail after three attempts."""
    attempts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("attempts"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(attempts, "o_orderkey", "left")
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).when(F.coalesce("attempts", F.lit(0)) >= 3, "failed").otherwise("O")
    return rows.select("o_orderkey", status.alias("status"))


@query(
    f"""SELECT o_orderkey, strftime(o_orderdate - INTERVAL 5 HOUR, 'daily:%Y-%m-%d') || ':full' AS dedupe_key, o_orderdate + INTERVAL 6 HOUR <= {NOW} AS due,
       date_diff('second', o_orderdate, {NOW}) <= 86400 * 30 AS online, strftime(o_orderdate - INTERVAL 120 SECOND, '%Y-%m-%dT%H:%M:%SZ') AS window_start FROM orders"""
)
def schedule_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each job: the key of its local day, whether the next run is due, the worker online, and its window's start."""
    at = F.col("o_orderdate")
    stamp = at.cast("timestamp")
    local = F.date_format(stamp - F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("daily:"), local, F.lit(":full")).alias("dedupe_key"),
        (at + F.expr("INTERVAL 6 HOURS") <= _now()).alias("due"),
        (F.unix_timestamp(_now().cast("timestamp")) - F.unix_timestamp(stamp) <= 86400 * 30).alias("online"),
        F.date_format(stamp - F.expr("INTERVAL 120 SECONDS"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("window_start"),
    )


@query(
    """WITH d AS (SELECT d.source, count(*) AS n, min(d.doc_id) AS first, count(*) FILTER (WHERE coalesce(quality, 1) = 1) AS active, max(n_chars) AS longest FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source)
    SELECT d.source, n, active, longest, lang AS category FROM d JOIN documents x ON x.doc_id = d.first"""
)
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (here: sources) with the number of chunks and the first chunk's category."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("quality", F.lit(1)) == 1).alias("active"), F.max("n_chars").alias("longest"), F.min_by("lang", "doc_id").alias("category")
    )


@query(
    """SELECT l_orderkey, l_linenumber, greatest(1, CAST(ceil(n / 25.0) AS BIGINT)) AS pages, n FROM (SELECT l_orderkey, l_linenumber, l_suppkey, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)"""
)
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages of 25 the list has that each row is in."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    counts = rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(counts, "l_suppkey").select("l_orderkey", "l_linenumber", F.greatest(F.lit(1).cast("long"), numeric.page_count(F.col("n"), 25)).alias("pages"), "n")
