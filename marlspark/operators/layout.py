"""Lines, images and tables of laid-out pages, as tables: (doc_id, page, y, x, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6
#: Titles in a path are cut to so many characters.
HEADING_CHARS = 500
#: An image on so many pages is decoration; a line is bold from this share on.
DECORATION_PAGES, BOLD_SHARE = 3, 0.6


def visible(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(text, r"\s", ""))


def body_size(spans: DataFrame) -> DataFrame:
    """(doc_id, body_size): the font size, to one decimal, that most visible characters have."""
    weight = spans.select("doc_id", F.bround("font_size", 1).alias("size"), visible(F.col("text")).alias("w")).groupBy("doc_id", "size").agg(F.sum("w").alias("w")).where("w > 0")
    return weight.groupBy("doc_id").agg(F.max_by("size", F.struct("w", -F.col("size"))).alias("body_size"))


def bold_lines(spans: DataFrame) -> DataFrame:
    """(doc_id, line, bold): whether the better part of a line's visible characters is bold."""
    w = visible(F.col("text"))
    sums = spans.groupBy("doc_id", "line").agg(F.sum(w).alias("total"), F.sum(F.when(F.col("bold"), w).otherwise(0)).alias("strong"))
    return sums.select("doc_id", "line", ((F.col("total") > 0) & (F.col("strong") >= F.col("total") * BOLD_SHARE)).alias("bold"))


def drop_decoration(images: DataFrame, pages: int = DECORATION_PAGES) -> DataFrame:
    """Images whose content isn't on several pages of their document."""
    repeated = images.groupBy("doc_id", "digest").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= pages)
    return images.join(repeated, ["doc_id", "digest"], "left_anti")


def outside_tables(items: DataFrame, tables: DataFrame) -> DataFrame:
    """Items (x1, y1, x2, y2) whose centre is in no table rectangle of their page."""
    cx, cy = (F.col("i.x1") + F.col("i.x2")) / 2, (F.col("i.y1") + F.col("i.y2")) / 2
    same = (F.col("i.doc_id") == F.col("t.doc_id")) & (F.col("i.page") == F.col("t.page"))
    inside = cx.between(F.col("t.x1"), F.col("t.x2")) & cy.between(F.col("t.y1"), F.col("t.y2"))
    return items.alias("i").join(tables.alias("t"), same & inside, "left_anti")


def heading_paths(rows: DataFrame, key: str, order: list[str], level: str, title: str, levels: int = LEVELS, chars: int = HEADING_CHARS) -> DataFrame:
    """`rows` with `path`: the headings that each row stands under, itself included if it is one.

    The last heading of a level counts while no heading of a higher level came after it. level: 1 to
    `levels`, null or 0 for body rows. Titles are cut to `chars` characters.
    """
    window = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = rows.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    last = [F.last(F.when(F.col(level) == k, F.struct("_at", F.col(title).alias("title"))), ignorenulls=True).over(window).alias(f"_l{k}") for k in range(1, levels + 1)]
    seen = numbered.select("*", *last)
    entries = []
    for k in range(1, levels + 1):
        higher = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_l{j}._at") < F.col(f"_l{k}._at"), F.lit(True)) for j in range(1, k)], F.lit(True))
        entries.append(F.when(higher, F.substring(F.col(f"_l{k}.title"), 1, chars)))
    return seen.select(*rows.columns, F.filter(F.array(*entries), lambda x: x.isNotNull()).alias("path"))


def attach_images(headings: DataFrame, images: DataFrame) -> DataFrame:
    """Images with the path of the latest heading above them: headings (doc_id, page, y, level, title), images (doc_id, page, y, x, image_id)."""
    none = lambda kind: F.lit(None).cast(kind)
    lines = headings.select("doc_id", "page", "y", F.lit(-1.0).alias("x"), "level", "title", none("long").alias("image_id"))
    pictures = images.select("doc_id", "page", "y", "x", none("int").alias("level"), none("string").alias("title"), "image_id")
    return heading_paths(lines.unionByName(pictures), "doc_id", ["page", "y", "x"], "level", "title").where(F.col("image_id").isNotNull()).select("doc_id", "image_id", "path")
