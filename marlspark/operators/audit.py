"""Shop products against catalog codes: matches by first and by any SKU, candidates by case, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspark.functions.text import casefold, clean


def matches(shop: DataFrame, stored: DataFrame) -> DataFrame:
    """Each shop product with `first_code` (null if it has no SKU), whether the catalog has it (`matched_first`), the
    catalog codes among its SKUs (`matched_any`, sorted) and, where the first isn't matched, codes that differ in case
    only (`candidates`, sorted).

    shop: product, once each, and skus, an array without blanks in variant order; stored: code. Blank codes don't match.
    """
    codes = stored.select(clean(F.col("code")).alias("code")).where("code <> ''").distinct()
    folded = codes.groupBy(casefold(F.col("code")).alias("folded")).agg(F.array_sort(F.collect_list("code")).alias("alike"))
    products = shop.select("product", F.get("skus", F.lit(0)).alias("first_code"))
    found = shop.select("product", F.explode("skus").alias("code")).join(codes, "code").groupBy("product").agg(F.array_sort(F.collect_set("code")).alias("any"))
    rows = products.withColumn("folded", casefold(F.col("first_code"))).join(folded, "folded", "left").join(found, "product", "left")
    none = F.array().cast("array<string>")
    exact = F.coalesce(F.array_contains("alike", F.col("first_code")), F.lit(False))
    return rows.select("product", "first_code", exact.alias("matched_first"), F.coalesce("any", none).alias("matched_any"), F.when(exact, none).otherwise(F.coalesce("alike", none)).alias("candidates"))


def code_facts(shop: DataFrame, stored: DataFrame) -> DataFrame:
    """Each code with the number of its catalog rows (`rows`), of products it is the first SKU of (`first`) and of
    different products that have it (`products`). Blank catalog codes are one row with an empty code."""
    of_shop = shop.select("product", F.posexplode("skus").alias("position", "code"))
    product = shop.schema["product"].dataType
    facts = stored.select(clean(F.col("code")).alias("code"), F.lit(1).alias("r"), F.lit(0).alias("f"), F.lit(None).cast(product).alias("product"))
    facts = facts.unionAll(of_shop.select("code", F.lit(0), (F.col("position") == 0).cast("int"), "product"))
    # Once by product first, so that a code of very many products is summed before it is in one place.
    once = facts.groupBy("code", "product").agg(F.sum("r").alias("r"), F.max("f").alias("f"))
    return once.groupBy("code").agg(F.sum("r").alias("rows"), F.sum("f").cast("long").alias("first"), F.count("product").alias("products"))


def counts(shop: DataFrame, stored: DataFrame) -> DataFrame:
    """The audit's counts, in one row."""
    real, rows, first, products = F.col("code") != "", F.col("rows"), F.col("first"), F.col("products")
    by_code = code_facts(shop, stored).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("catalog_rows"),
        F.count_if(real & (rows > 0)).alias("catalog_codes"),
        F.count_if(real & (rows > 1)).alias("catalog_duplicates"),
        F.coalesce(F.sum(F.when(~real, rows)), F.lit(0)).alias("catalog_blank"),
        F.count_if(first > 0).alias("first_skus"),
        F.count_if(first > 1).alias("duplicate_first_skus"),
        F.count_if(products > 0).alias("variant_skus"),
        F.count_if(products > 1).alias("shared_skus"),
        F.count_if(real & (rows > 0) & (first > 0)).alias("matched_codes"),
        F.count_if(real & (rows > 0) & (first == 0)).alias("codes_not_first"),
        F.count_if(real & (rows > 0) & (products == 0)).alias("codes_in_no_variant"),
    )
    some = F.size("matched_any") > 0
    by_product = matches(shop, stored).agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(F.col("first_code").isNull()).alias("without_sku"),
        F.count_if("matched_first").alias("matched_first"),
        F.count_if(some).alias("matched_any"),
        F.count_if(~some).alias("unmatched"),
        F.count_if(F.size("candidates") > 0).alias("case_only"),
    )
    both = by_code.select(F.struct("*").alias("c")).scalar()
    return by_product.select("*", both.alias("c")).select(*by_product.columns, "c.*")
