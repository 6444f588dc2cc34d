"""Image search: nearest pictures, best of each product, decisions. `embeddings` are pictures; a
product is vec_id % 50 and its type the label. The query set is every vector whose id is divisible by 20."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlspark.functions import numeric
from marlspark.operators import image_search, search, vector_best
from marlspark.plans.base import query, read

POINTS = """
v AS (SELECT q.vec_id AS query_id, q.label AS query_label, p.vec_id AS id, p.label, p.vec_id % 50 AS product,
        round(greatest(-1, least(1, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])))), 6) AS similarity
      FROM embeddings p, embeddings q WHERE q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id),
b AS (SELECT query_id, product, id, label, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, product ORDER BY similarity DESC, id) AS n FROM v) WHERE n = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, product) AS rank FROM b)"""


def _scores(spark: SparkSession, sf_dir: str, k: int, by: str | None = None, alike: bool = False, own: int = 0, most: int | None = None) -> DataFrame:
    """What may be among the `k` best pictures of each query, or of each query and value of `by` (of its `most` best values); with `alike` of the query's label only."""
    rows = read(spark, sf_dir, "embeddings")
    dealt = rows.repartition(spark.sparkContext.defaultParallelism, "vec_id")  # few files are few tasks else
    points = dealt.select(F.col("vec_id").cast("long").alias("id"), "embedding", "label", (F.col("vec_id") % 50).alias("product"))
    counts = F.col("vec_id") % own == 0 if own else F.lit(False)
    asked = rows.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("query_label"), counts.alias("own"))
    return vector_best.vector_best(points, asked, k, by, ("label", "query_label") if alike else None, most)


def best_of_each(scores: DataFrame) -> DataFrame:
    """The most similar picture of each product, smallest id on ties."""
    best = scores.groupBy("query_id", "product").agg(F.max_by(F.struct("id", "label", "similarity"), F.struct("similarity", -F.col("id"))).alias("b"))
    return best.select("query_id", "product", "b.id", "b.label", "b.similarity")


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_of_each(_scores(spark, sf_dir, 1, "product"))


def _ranked(spark: SparkSession, sf_dir: str, k: int, own: int = 0) -> DataFrame:
    return search.top_per_query(best_of_each(_scores(spark, sf_dir, 1, "product", own=own, most=k)), k, "similarity", "product")


@query(f"WITH {POINTS} SELECT query_id, product, id, similarity FROM b")
def best_per_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best picture of every product for each query picture."""
    return _best(spark, sf_dir).select("query_id", "product", "id", "similarity")


@query(
    f"""WITH {POINTS}, g AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM v) WHERE r <= 50),
    c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM v WHERE label = query_label) WHERE r <= 50),
    u AS (SELECT query_id, product, id, similarity FROM g UNION ALL SELECT query_id, product, id, similarity FROM c)
    SELECT query_id, product, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, product ORDER BY similarity DESC, id) AS n FROM u) WHERE n = 1"""
)
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 candidates of all types and 50 of the query's own, put together, best of each product."""
    every = search.top_per_query(_scores(spark, sf_dir, 50), 50, "similarity", "id")
    own = search.top_per_query(_scores(spark, sf_dir, 50, alike=True), 50, "similarity", "id")
    return best_of_each(every.unionByName(own)).select("query_id", "product", "id", "similarity")


@query(
    f"""WITH {POINTS.replace("p.vec_id <> q.vec_id", "(p.vec_id <> q.vec_id OR q.vec_id % 60 = 0)")}, t AS (SELECT query_id, max(product) FILTER (WHERE rank = 1) AS product, max(similarity) FILTER (WHERE rank = 1) AS top, max(similarity) FILTER (WHERE rank = 2) AS second FROM k GROUP BY query_id)
    SELECT query_id, product, round(top - coalesce(second, 0), 6) AS margin, top >= 0.88 AND top - coalesce(second, 0) >= 0.08 AS accepted FROM t"""
)
def fast_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the best product is sure at once: similar enough, and by far enough; every third query has its own picture among the points."""
    rows = _ranked(spark, sf_dir, 2, own=60)
    top = rows.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("product"))).alias("product"), F.max("similarity").alias("top"), F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("second"))
    margin = F.col("top") - F.coalesce("second", F.lit(0.0))
    return top.select("query_id", "product", F.round(margin, 6).alias("margin"), ((F.col("top") >= 0.88) & (margin >= 0.08)).alias("accepted"))


# The second opinion of a picture pair is a stand-in for a visual model, worked out from the ids.
DECISION = f"""{POINTS},
d AS (SELECT query_id, product, similarity, rank, CAST((id * 7 + query_id) % 101 AS DOUBLE) / 100 AS visual FROM k WHERE rank <= 8),
e AS (SELECT *, round(similarity * 0.55 + visual * 0.45, 6) AS score FROM d),
f AS (SELECT *, score >= 0.65 AND visual >= 0.5 AS eligible FROM e)"""


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir, 8).withColumn("visual", ((F.col("id") * 7 + F.col("query_id")) % 101).cast("double") / 100)
    scored = rows.withColumn("score", F.round(numeric.weighted(F.col("similarity"), F.col("visual"), 0.55, 0.45), 6))
    return scored.withColumn("eligible", (F.col("score") >= 0.65) & (F.col("visual") >= 0.5))


@query(
    f"""WITH {DECISION} SELECT query_id, product, score, eligible, row_number() OVER (PARTITION BY query_id ORDER BY eligible DESC, CASE WHEN eligible THEN score END DESC NULLS LAST, rank) AS place,
    CASE WHEN NOT eligible THEN 'low' WHEN score >= 0.82 THEN 'high' ELSE 'medium' END AS confidence FROM f"""
)
def weighted_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by both scores: the eligible first, by score, then the others in their old order."""
    order = Window.partitionBy("query_id").orderBy(F.desc("eligible"), F.when(F.col("eligible"), F.col("score")).desc_nulls_last(), "rank")
    confidence = F.when(~F.col("eligible"), "low").when(F.col("score") >= 0.82, "high").otherwise("medium")
    return _decided(spark, sf_dir).select("query_id", "product", "score", "eligible", F.row_number().over(order).alias("place"), confidence.alias("confidence"))


@query(
    f"""WITH {POINTS}, o AS (SELECT query_id, product, rank, 1 AS part FROM k WHERE rank <= 5),
    r AS (SELECT query_id, product, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, product) AS rank, 2 AS part FROM b WHERE label % 2 = query_id / 20 % 2),
    x AS (SELECT query_id, product, min(part * 1000 + rank) AS place FROM (SELECT * FROM o UNION ALL SELECT * FROM r WHERE rank <= 3 UNION ALL SELECT query_id, product, rank, 3 FROM k WHERE rank <= 16) GROUP BY ALL),
    s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS slot FROM x) SELECT query_id, product, slot FROM s WHERE slot <= 8""".replace("query_id / 20", "query_id // 20")
)
def slot_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight slots: five of the first search, three of the refined one, then whatever comes next, each product once."""
    best = _best(spark, sf_dir)
    ranked = search.top_per_query(best, 16, "similarity", "product")
    refined = search.top_per_query(best.where(F.col("label") % 2 == F.floor(F.col("query_id") / 20) % 2), 3, "similarity", "product")
    place = lambda part: (F.lit(part * 1000) + F.col("rank")).alias("place")
    offers = ranked.where("rank <= 5").select("query_id", "product", place(1)).unionAll(refined.select("query_id", "product", place(2))).unionAll(ranked.select("query_id", "product", place(3)))
    first = offers.groupBy("query_id", "product").agg(F.min("place").alias("place"))
    order = Window.partitionBy("query_id").orderBy("place")
    return first.select("query_id", "product", F.row_number().over(order).alias("slot")).where("slot <= 8")


@query(
    f"""WITH {POINTS}, q AS (SELECT *, count(*) FILTER (WHERE similarity >= 0.45) OVER (PARTITION BY query_id) AS good FROM k WHERE rank <= 8)
    SELECT query_id, product, similarity, good = 0 AS low_confidence FROM q WHERE similarity >= 0.45 OR (good = 0 AND rank <= 3)"""
)
def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products over the least score; where there is none, the first three, marked as unsure."""
    good = F.count_if(F.col("similarity") >= 0.45).over(Window.partitionBy("query_id"))
    rows = _ranked(spark, sf_dir, 8).withColumn("good", good)
    return rows.where((F.col("similarity") >= 0.45) | ((F.col("good") == 0) & (F.col("rank") <= 3))).select("query_id", "product", "similarity", (F.col("good") == 0).alias("low_confidence"))


@query(
    """WITH p AS (SELECT p_partkey, p_size / 100.0 AS x1, p_size / 120.0 AS y1, least(1.3, p_size / 100.0 + p_retailprice / 4000) AS x2, p_size / 120.0 + p_retailprice / 5000 AS y2 FROM part),
    c AS (SELECT p_partkey, greatest(0, least(1, x1)) AS l, greatest(0, least(1, y1)) AS t, greatest(0, least(1, x2)) AS r, greatest(0, least(1, y2)) AS b FROM p)
    SELECT p_partkey, CASE WHEN r - l >= 0.03 AND b - t >= 0.03 THEN CAST(round_even(greatest(0, least(1, l - (r - l) * 0.06)) * 640, 0) AS INTEGER) END AS crop_left,
           CASE WHEN r - l >= 0.03 AND b - t >= 0.03 THEN CAST(round_even(greatest(0, least(1, b + (b - t) * 0.06)) * 480, 0) AS INTEGER) END AS crop_bottom FROM c""".replace("p_size / 100.0", "CAST(p_size AS DOUBLE) / 100").replace("p_size / 120.0", "CAST(p_size AS DOUBLE) / 120")
)
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop boxes in pixels: held to the picture, with a margin, too small ones refused."""
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    x1, y1 = size / 100, size / 120
    box = numeric.crop_box(x1, y1, F.least(F.lit(1.3), x1 + price / 4000), y1 + price / 5000, F.lit(640), F.lit(480))
    return read(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", F.col("b.left").alias("crop_left"), F.col("b.bottom").alias("crop_bottom"))


TOP50 = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS n FROM v {0}) WHERE n <= 50"
BEST = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, product) AS rank FROM (SELECT query_id, product, id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id, product ORDER BY similarity DESC, id) AS m FROM {0}) WHERE m = 1)"
SURE = "SELECT query_id FROM {0} GROUP BY query_id HAVING max(similarity) >= 0.88 AND max(similarity) - coalesce(max(similarity) FILTER (WHERE rank = 2), 0) >= 0.08"


@query(
    f"""WITH {POINTS.replace("p.vec_id <> q.vec_id", "(p.vec_id <> q.vec_id OR q.vec_id % 60 = 0)")},
    g1 AS ({TOP50.format("")}), c1 AS ({TOP50.format("WHERE label = query_label")}), kg AS ({BEST.format("g1")}), sg AS ({SURE.format("kg")}),
    u1 AS (SELECT query_id, product, id, similarity FROM g1 UNION ALL SELECT query_id, product, id, similarity FROM c1 WHERE query_id NOT IN (SELECT query_id FROM sg)),
    ku AS ({BEST.format("u1")}), su AS ({SURE.format("ku")}), kc AS ({BEST.format("c1")}),
    o1 AS (SELECT DISTINCT query_id FROM ku WHERE query_id NOT IN (SELECT query_id FROM sg) AND query_id NOT IN (SELECT query_id FROM su)),
    x1 AS (SELECT query_id, product, min(offer) AS offer FROM (SELECT query_id, product, 1000 + rank AS offer FROM kg WHERE rank <= 5 UNION ALL SELECT query_id, product, 2000 + rank FROM kc WHERE rank <= 3 UNION ALL SELECT query_id, product, 3000 + rank FROM ku WHERE rank <= 16) WHERE query_id IN (SELECT query_id FROM o1) GROUP BY ALL),
    s1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY offer) AS slot FROM x1) WHERE slot <= 8),
    j1 AS (SELECT query_id, product, score, score >= 0.65 AND visual >= 0.5 AS eligible FROM (SELECT *, round(similarity * 0.55 + visual * 0.45, 6) AS score FROM (SELECT s1.query_id, s1.product, similarity, CAST((id * 7 + s1.query_id) % 101 AS DOUBLE) / 100 AS visual FROM s1 JOIN ku ON ku.query_id = s1.query_id AND ku.product = s1.product))),
    m1 AS (SELECT ku.query_id, ku.product, ku.similarity, ku.rank, score, coalesce(eligible, false) AS eligible, ku.query_id IN (SELECT query_id FROM o1) AS verified FROM ku LEFT JOIN j1 ON j1.query_id = ku.query_id AND j1.product = ku.product),
    n1 AS (SELECT *, CASE WHEN verified THEN NOT bool_or(eligible) OVER (PARTITION BY query_id) ELSE NOT bool_or(similarity >= 0.25) OVER (PARTITION BY query_id) END AS low_confidence,
             row_number() OVER (PARTITION BY query_id ORDER BY eligible DESC, CASE WHEN eligible THEN score END DESC NULLS LAST, rank) AS spot FROM m1),
    p1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY spot) AS place FROM n1 WHERE CASE WHEN low_confidence THEN spot <= 3 ELSE similarity >= 0.25 END)
    SELECT query_id, CAST(place AS INTEGER) AS place, product, similarity, verified, low_confidence FROM p1 WHERE place <= 8"""
)
def picture_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches by picture from first hits to what is shown; the second opinion is a stand-in from the ids, and every third query has its own picture among the points."""
    n = image_search.CANDIDATES
    visual = lambda rows: ((rows["id"] * 7 + rows["query_id"]) % 101).cast("double") / 100
    return image_search.search_by_picture(_scores(spark, sf_dir, n, own=60), _scores(spark, sf_dir, n, alike=True, own=60), visual, 0.25)
