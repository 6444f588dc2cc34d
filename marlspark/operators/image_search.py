"""A search by picture as one plan, for a batch of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspark.functions import numeric
from marlspark.operators.search import stored, top_per_query

CANDIDATES, RESULTS, UNSURE_RESULTS = 50, 8, 3
#: A first hit that needs no second look, and what a second look asks for.
SURE, LEAD = 0.88, 0.08
VISUAL_SHARE, ELIGIBLE, VISUAL = 0.45, 0.65, 0.5
FIRST_SLOTS, REFINED_SLOTS = 5, 3


def ranked_products(points: DataFrame) -> DataFrame:
    """(query_id, product, id, similarity, rank): each product's most similar picture, least id on ties, ranked by it."""
    best = points.groupBy("query_id", "product").agg(F.max_by(F.struct("id", "similarity"), F.struct("similarity", -F.col("id"))).alias("b")).select("query_id", "product", "b.*")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "product")))


def sure(ranked: DataFrame) -> DataFrame:
    """(query_id) of the queries whose first product is similar enough, and by far enough."""
    top = ranked.where("rank <= 2").groupBy("query_id").agg(F.max("similarity").alias("top"), F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("second"))
    return top.where((F.col("top") >= SURE) & (F.col("top") - F.coalesce("second", F.lit(0.0)) >= LEAD)).select("query_id")


def search_by_picture(scores: DataFrame, refined: DataFrame, visual: Callable[[DataFrame], Column], least: float) -> DataFrame:
    """(query_id, place, product, similarity, verified, low_confidence): what each search shows.

    scores: query_id, product, id, similarity of all pictures; refined: those of the kind that the query's
    picture was seen to be of. Where the first search is sure of itself, it is the result. Else both are put
    together; unless that is sure, eight products (five of the first search, three of the refined, then what
    comes next) get `visual`, a second opinion of (query_id, id) between 0 and 1, and the eligible by both come
    first. Products below `least` don't show; where none is good enough, or none eligible, the first three do,
    marked as unsure.
    """
    every = stored(top_per_query(scores, CANDIDATES, "similarity", "id").select("query_id", "product", "id", "similarity"), "pictures")
    own = stored(top_per_query(refined, CANDIDATES, "similarity", "id").select("query_id", "product", "id", "similarity"), "pictures-refined")
    first = ranked_products(every)
    settled = stored(sure(first), "pictures-sure")
    final = stored(ranked_products(every.unionByName(own.join(settled, "query_id", "left_anti"))), "pictures-ranked")
    open_ = final.select("query_id").distinct().join(settled.unionByName(sure(final)), "query_id", "left_anti")

    place = lambda part, rows, most: rows.where(F.col("rank") <= most).select("query_id", "product", (F.lit(part * 1000) + F.col("rank")).alias("offer"))
    offers = place(1, first, FIRST_SLOTS).unionByName(place(2, ranked_products(own), REFINED_SLOTS)).unionByName(place(3, final, RESULTS + FIRST_SLOTS + REFINED_SLOTS))
    slots = offers.join(open_, "query_id", "left_semi").groupBy("query_id", "product").agg(F.min("offer").alias("offer"))
    looked = slots.withColumn("slot", F.row_number().over(Window.partitionBy("query_id").orderBy("offer"))).where(F.col("slot") <= RESULTS).join(final, ["query_id", "product"])
    scored = looked.withColumn("visual", visual(looked)).withColumn("score", F.round(numeric.weighted(F.col("similarity"), F.col("visual"), 1 - VISUAL_SHARE, VISUAL_SHARE), 6))
    judged = scored.select("query_id", "product", "score", ((F.col("score") >= ELIGIBLE) & (F.col("visual") >= VISUAL)).alias("eligible"))

    met = final.join(judged, ["query_id", "product"], "left").join(open_.withColumn("verified", F.lit(True)), "query_id", "left")
    met = met.withColumn("verified", F.coalesce("verified", F.lit(False))).withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    of_query = Window.partitionBy("query_id")
    order = of_query.orderBy(F.desc("eligible"), F.when(F.col("eligible"), F.col("score")).desc_nulls_last(), "rank")
    good = F.col("similarity") >= least
    low = F.when(F.col("verified"), ~F.bool_or("eligible").over(of_query)).otherwise(~F.bool_or(good).over(of_query))
    placed = met.withColumn("low_confidence", low).withColumn("at", F.row_number().over(order))
    shown = placed.where(F.when(F.col("low_confidence"), F.col("at") <= UNSURE_RESULTS).otherwise(good))
    final_place = F.row_number().over(of_query.orderBy("at"))
    return shown.withColumn("place", final_place).where(F.col("place") <= RESULTS).select("query_id", "place", "product", "similarity", "verified", "low_confidence")
