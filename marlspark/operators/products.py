"""Product results for a query: variants of the asked color, prices, stock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlspark.functions import text, web
from marlspark.operators import catalog


def asked_color(colors: Column, query: Column) -> Column:
    """The first color whose words stand in the query as a whole; null if none does."""
    padded = F.concat(F.lit(" "), text.spaced(query), F.lit(" "))
    hits = F.filter(colors, lambda c: F.contains(padded, F.concat(F.lit(" "), text.spaced(c), F.lit(" "))) & (F.length(text.spaced(c)) > 0))
    return F.get(hits, F.lit(0))


def results(variants: DataFrame, queries: DataFrame) -> DataFrame:
    """One row for each product of `queries` (product, query): color, variants, price range, stock and its state.

    variants: product, position, color, price, quantity, available. Without an asked color all variants count.
    """
    colors = variants.where(F.length(F.trim("color")) > 0).groupBy("product", "color").agg(F.min("position").alias("p"))
    listed = colors.groupBy("product").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "color"))), lambda x: x["color"]).alias("colors"))
    asked = queries.join(listed, "product", "left").select("product", asked_color(F.coalesce("colors", F.array().cast("array<string>")), F.col("query")).alias("asked"))
    chosen = variants.join(asked, "product").where(F.col("asked").isNull() | (text.spaced(F.col("color")) == text.spaced(F.col("asked"))))
    free = F.coalesce("available", F.lit(False)) | (F.coalesce("quantity", F.lit(0)) > 0)
    state = (
        F.when(F.count_if(free) > 0, "in_stock")
        .when((F.count("quantity") > 0) | (F.count("available") == F.count(F.lit(1))), "out_of_stock")
        .otherwise("unknown")
    )
    return chosen.groupBy("product", "asked").agg(
        F.count(F.lit(1)).alias("n"), F.min("price").alias("least"), F.max("price").alias("most"), catalog.stock(F.col("quantity")).alias("stock"), F.count_if(free).alias("available"), state.alias("state")
    )


def details(matches: DataFrame, products: DataFrame) -> DataFrame:
    """Matched products that are in use: product, similarity, color, matched_url, and urls with that one in front, once.

    matches: product, checksum, color, similarity; products, once each: product, status, urls, images (array of
    checksum, color, url). The first picture with the match's checksum or color, case aside, and a safe url is the
    matched one; null if there is none. Products whose status is blank are in use.
    """
    checksum, color = text.clean(F.col("checksum")), text.casefold(text.clean(F.col("color")))
    wanted = lambda i: ((checksum != "") & (i["checksum"] == checksum)) | ((color != "") & (text.casefold(text.clean(i["color"])) == color))
    urls = F.transform(F.filter("images", lambda i: F.coalesce(wanted(i), F.lit(False)) & web.safe_url(i["url"]).isNotNull()), lambda i: web.safe_url(i["url"]))
    used = products.where(F.upper(text.clean(F.col("status"))).isin("", "ACTIVE")).drop("checksum", "color", "similarity")
    rows = matches.join(used, "product").withColumn("matched_url", F.get(urls, F.lit(0)))
    moved = F.when(F.col("matched_url").isNotNull(), F.concat(F.array("matched_url"), F.array_remove("urls", F.col("matched_url")))).otherwise(F.col("urls"))
    return rows.select("product", "similarity", "color", "matched_url", moved.alias("urls"))
