"""Chunks of laid-out documents: text, ruled tables and images in reading order.

Lines inside tables are the tables' own. A heading or a table ends the text before it. A table's rows come in
chunks of whole rows, under the header that they have or, where a table goes on from the page before, the
one it had there: the next page, the same left and right bounds, and no text in between. A section of
images alone gets a line that says so; page numbers at the foot are dropped.

Defined results: a document without text, tables or images gives no chunk; a section of more than `size`
characters is cut into windows; a row longer than `size` is a chunk by itself.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlspark.operators.chunking import OVERLAP, SIZE, cut_windows
from marlspark.operators.layout import LEVELS, heading_paths, outside_tables
from marlspark.operators.pdf_headings import FOOT, page_headings
from marlspark.operators.search import stored

#: Bounds of a table that goes on may differ by so much, in points.
ALIGNED = 4.0
#: What stands before a table's rows, and for images alone.
TABLE_PREFIX, TABLE_SUFFIX, HEADER_PREFIX = "Bảng, trang PDF ", ". Các ô cùng dòng thuộc cùng một bản ghi.", "\nTiêu đề nhóm cột: "
IMAGES, IMAGES_OF, IMAGES_END = "Hình ảnh hoặc sơ đồ minh họa trong PDF, trang ", '. Nội dung hình thuộc mục "', '".'


def carried_headers(tables: DataFrame, texts: DataFrame) -> DataFrame:
    """`tables` with `heading`: each row's header, its own or that of the table it goes on from.

    tables: as `ruled_tables` gives them; texts: doc_id, page, y of the lines that part tables.
    """
    key = ["doc_id", "page", "table"]
    one = tables.groupBy(*key).agg(*[F.first(c).alias(c) for c in ("x1", "y1", "x2")])
    events = one.select("doc_id", "page", F.col("y1").alias("y"), F.lit(1).alias("is_table"), "table", "x1", "x2")
    both = events.unionByName(texts.select("doc_id", "page", "y", F.lit(0).alias("is_table")), allowMissingColumns=True)
    order = Window.partitionBy("doc_id").orderBy("page", "y", F.desc("is_table"), "table")
    seen = both.withColumn("texts", F.sum(1 - F.col("is_table")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("is_table = 1")
    before = lambda c: F.lag(c).over(order)
    goes_on = (before("texts") == F.col("texts")) & (F.col("page") == before("page") + 1) & (F.abs(F.col("x1") - before("x1")) < ALIGNED) & (F.abs(F.col("x2") - before("x2")) < ALIGNED)
    starts = seen.withColumn("starts", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    chained = starts.select(*key, F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("chain"))
    running = Window.partitionBy("doc_id", "chain").orderBy("page", "table", "row").rowsBetween(Window.unboundedPreceding, 0)
    return tables.join(chained, key).withColumn("heading", F.coalesce(F.last(F.nullif("header", F.lit("")), ignorenulls=True).over(running), F.lit(""))).drop("chain")


def _packed(lines: Column, room: Column) -> Column:
    """Lines put together by line feeds while they fit; a longer line stays whole."""

    @F.pandas_udf("array<string>")
    def run(rows: pd.Series, rooms: pd.Series) -> pd.Series:
        def pack(given: list[str], room: int) -> list[str]:
            out: list[str] = []
            for line in given:
                if out and len(out[-1]) + 1 + len(line) <= room:
                    out[-1] += "\n" + line
                else:
                    out.append(line)
            return out

        return pd.Series([pack(list(a), int(b)) for a, b in zip(rows, rooms, strict=True)], dtype=object)

    return run(lines, room)


def _windows(text: Column, size: int, overlap: int) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: cut_windows(x, size, overlap))

    return run(text)


def assembled(spans: DataFrame, tables: DataFrame, images: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, heading, section_path, content) of each document.

    spans: as `page_headings` takes them; tables: as `ruled_tables` gives them; images: doc_id, page, x, y.
    """
    tables = stored(tables, "page-tables")
    boxes = tables.select("doc_id", "page", "x1", "y1", "x2", "y2").distinct()
    free = outside_tables(spans, boxes)
    lines = page_headings(free.select(*spans.columns))
    heights = spans.groupBy("doc_id", "page").agg(F.max("page_height").alias("height"))
    foot = F.col("text").rlike(r"(?U)^\s*\p{Nd}+\s*$") & (F.col("y") >= F.col("height") * FOOT)
    told = stored(lines.join(heights, ["doc_id", "page"]).withColumn("foot", foot), "page-lines")
    headed = stored(carried_headers(tables, told.where(~F.col("foot") & (F.trim("text") != ""))), "page-rows")

    none = lambda kind: F.lit(None).cast(kind)
    text = told.where(~F.col("foot") | (F.col("level") > 0)).select("doc_id", "page", "y", F.lit(0).alias("kind"), F.col("position").cast("double").alias("x"), F.least("level", F.lit(LEVELS)).alias("level"), "text", none("int").alias("table"))
    pictures = images.select("doc_id", "page", F.col("y").cast("double").alias("y"), F.lit(1).alias("kind"), F.col("x").cast("double").alias("x"), F.lit(0).alias("level"), none("string").alias("text"), none("int").alias("table"))
    grids = headed.groupBy("doc_id", "page", "table").agg(F.first("y1").alias("y"), F.first("x1").alias("x")).select("doc_id", "page", "y", F.lit(2).alias("kind"), "x", F.lit(0).alias("level"), none("string").alias("text"), "table")
    pathed = heading_paths(text.unionByName(pictures).unionByName(grids), "doc_id", ["page", "y", "x", "kind"], "level", "text")
    order = Window.partitionBy("doc_id").orderBy("page", "y", "x", "kind")
    cut = (F.col("level") > 0) | (F.col("kind") == 2)
    parts = stored(pathed.withColumn("part", F.count_if(cut).over(order)).withColumn("at", F.row_number().over(order)), "page-parts")

    body = parts.where((F.col("level") == 0) & (F.col("kind") != 2)).groupBy("doc_id", "part").agg(
        F.first("path").alias("path"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == 0, F.struct("at", "text")))).alias("lines"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == 1, F.col("page")))).alias("pages"),
    )
    joined = F.btrim(F.array_join(F.transform("lines", lambda x: x["text"]), "\n"), F.lit(" \t\n\r"))
    named = F.concat(F.lit(IMAGES), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit(IMAGES_OF), F.rtrim(F.element_at("path", -1), F.lit(":")), F.lit(IMAGES_END))
    whole = F.when(joined != "", joined).when((F.size("pages") > 0) & (F.size("path") > 0), named)
    sections = body.withColumn("content", whole).where("content IS NOT NULL").select("doc_id", "part", F.lit(0).alias("table_part"), "path", F.posexplode(_windows(F.col("content"), size, overlap)).alias("piece", "content"))

    prefix = F.concat(F.lit(TABLE_PREFIX), F.col("page").cast("string"), F.lit(TABLE_SUFFIX), F.when(F.col("heading") != "", F.concat(F.lit(HEADER_PREFIX), "heading")).otherwise(""))
    within = Window.partitionBy("doc_id", "page", "table").orderBy("row")
    runs = headed.withColumn("prefix", prefix).withColumn("new", F.coalesce((F.lag("prefix").over(within) != F.col("prefix")).cast("int"), F.lit(0)))
    runs = runs.withColumn("table_part", F.sum("new").over(within.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    listed = runs.groupBy("doc_id", "page", "table", "table_part", "prefix").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("lines"))
    packed = listed.select("doc_id", "page", "table", "table_part", "prefix", F.posexplode(_packed(F.col("lines"), F.lit(size) - F.length("prefix") - 1)).alias("piece", "packed"))
    where = parts.where("kind = 2").select("doc_id", "page", "table", "part", "path")
    rows = packed.join(where, ["doc_id", "page", "table"]).select("doc_id", "part", "table_part", "path", "piece", F.concat("prefix", F.lit("\n"), "packed").alias("content"), F.lit(0).alias("late"))
    # What follows a table up to the next cut has the table's number too, and comes behind it.
    every = rows.unionByName(sections.withColumn("late", F.lit(1)).select(*rows.columns))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "late", "table_part", "piece")) - 1
    return every.select("doc_id", index.alias("chunk_index"), F.get("path", F.size("path") - 1).alias("heading"), F.col("path").alias("section_path"), "content")
