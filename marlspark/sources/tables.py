"""Tables from JSON feeds and reports to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIANT = (
    "struct<id: string, legacyResourceId: string, sku: string, barcode: string, title: string, price: string, compareAtPrice: string, inventoryQuantity: int, availableForSale: boolean, "
    "selectedOptions: array<struct<name: string, value: string>>>"
)
PRODUCT = (
    "id string, legacyResourceId string, title string, handle string, vendor string, productType string, description string, status string, createdAt string, publishedAt string, updatedAt string, "
    f"onlineStoreUrl string, variants struct<nodes: array<{VARIANT}>>, media struct<nodes: array<struct<id: string, image: struct<id: string, url: string, altText: string, width: int, height: int>>>>"
)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Raw shop products, one JSON object a line; fields that a query doesn't use aren't parsed."""
    return spark.read.schema(PRODUCT).json(path)


def variants(products: DataFrame) -> DataFrame:
    """One row for each variant: options as a map by lower-case name, price as a number (null if it isn't one)."""
    rows = products.select(F.col("id").alias("product_id"), "title", "status", F.posexplode("variants.nodes").alias("position", "v"))
    options = F.map_from_entries(F.array_distinct(F.transform(F.coalesce("v.selectedOptions", F.array()), lambda o: F.struct(F.lower(F.trim(o["name"])).alias("k"), F.trim(o["value"]).alias("v")))))
    return rows.select(
        "product_id", "title", "status", "position", F.col("v.id").alias("external_id"), F.col("v.legacyResourceId").alias("legacy_id"), F.trim("v.sku").alias("sku"), F.expr("try_cast(v.price AS double)").alias("price"),
        F.expr("try_cast(v.compareAtPrice AS double)").alias("compare_at_price"), F.col("v.inventoryQuantity").alias("inventory_quantity"), F.col("v.availableForSale").alias("available"), options.alias("options"),
    )


def product_code(products: DataFrame) -> DataFrame:
    """Products with `product_code`, the first variant's SKU that isn't blank; null if there is none."""
    skus = F.filter(F.transform("variants.nodes", lambda v: F.trim(v["sku"])), lambda s: F.length(s) > 0)
    return products.withColumn("product_code", F.get(skus, F.lit(0)))


def by_sku(products: DataFrame, sku: str) -> DataFrame:
    """Products with a variant of exactly this SKU, case aside."""
    return products.where(F.exists("variants.nodes", lambda v: F.lower(F.trim(v["sku"])) == sku.strip().lower()))


def read_category_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(category, product_type) of a JSON object of lists, each pair once."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("category", "types")).select(F.trim("category").alias("category"), F.explode("types").alias("product_type")).distinct()


def write_report(rows: DataFrame, path: str, kind: str = "json") -> None:
    """A report as JSON lines, or as CSV with a header; CSV files begin with a byte order mark, for spreadsheets."""
    if kind == "csv":
        marked = rows.toDF(*[f"\ufeff{c}" if i == 0 else c for i, c in enumerate(rows.columns)])
        marked.write.mode("overwrite").option("header", "true").option("encoding", "UTF-8").csv(path)
        return
    rows.write.mode("overwrite").json(path)


def require_dimension(rows: DataFrame, column: str, dimension: int) -> DataFrame:
    """Rows, failing at run time where a vector hasn't the dimension."""
    ok = F.assert_true(F.size(column) == dimension, f"{column} must have {dimension} values")
    return rows.where(ok.isNull())
