"""Folders, schemas, cursor pages, ruled tables, section trees: cases that the given tables don't show."""

import json
import time

import pytest
from pyspark.sql import functions as F

from marlspark.functions import schema
from marlspark.operators import assembly, chunking, folders, pages, rows, ruled, search
from marlspark.plans.structures import DRAFT


def test_levels_with_cycles_and_depth(spark):
    listed = [("r", None), ("a", "r"), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("s", "s"), ("q", "t"), ("t", "q")]
    items = spark.createDataFrame([(i, p, i.upper()) for i, p in listed], "id string, parent string, name string")
    roots = spark.createDataFrame([("r",), ("q",), ("none",)], "id string")
    got = {(r.root, r.id): (r.depth, "/".join(r.path)) for r in folders.levels(items, roots).collect()}
    assert got == {("r", "r"): (0, ""), ("r", "a"): (1, "A"), ("r", "b"): (2, "A/B"), ("r", "c"): (3, "A/B/C"), ("q", "q"): (0, ""), ("q", "t"): (1, "T"), ("none", "none"): (0, "")}
    with pytest.raises(ValueError):
        folders.levels(items, roots, max_depth=2)


def test_schema_paths(spark):
    cases = [
        ('{"sufficient": true, "statements": []}', None), (None, "$"), ("[]", "$"), ('{"sufficient": 1, "statements": []}', "$.sufficient"), ('{"statements": []}', "$.sufficient"), ('{"sufficient": null, "statements": []}', "$.sufficient"),
        ('{"sufficient": true, "statements": {}}', "$.statements"), ('{"sufficient": true, "statements": [{"text": "a", "ids": [1, 2.0]}]}', None), ('{"sufficient": true, "statements": [{"text": "a", "ids": [0]}]}', "$.statements[0].ids[0]"),
        ('{"sufficient": true, "statements": [{"text": "a", "ids": [1]}, {"text": 5, "ids": [1]}]}', "$.statements[1].text"), ('{"sufficient": true, "statements": [], "b": 1, "a": 2}', "$.a"),
    ]
    given = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = [r.path for r in given.select("i", schema.first_failure(F.col("t"), DRAFT).alias("path")).orderBy("i").collect()]
    assert got == [want for _, want in cases]
    simple = schema.simplify(DRAFT)
    assert "maxItems" in json.dumps(DRAFT) and not any(k in json.dumps(simple) for k in schema.LENGTHS)
    assert schema.spark_type(DRAFT) == "struct<`sufficient`: boolean, `statements`: array<struct<`text`: string, `ids`: array<bigint>>>>"
    good = given.where("i = 8").select(F.from_json("t", schema.spark_type(simple)).alias("x")).first()["x"]
    assert good["sufficient"] is True and good["statements"][0]["ids"][0] == 0


def test_pages_cost_the_parts_they_need(spark):
    thousand = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("m")).where("k % 3 <> 1").repartition(5)
    stored = pages.KeyedPages(thousand, "k", 50)
    keys = [k for k in range(1000) if k % 3 != 1]
    page, cursor = stored.page(20)
    assert [r.k for r in page] == keys[:20] and pages.decode_cursor(cursor) == keys[20] and len(stored.read) == 1
    page, after = stored.page(20, pages.encode_cursor(900))
    assert [r.k for r in page] == [k for k in keys if k >= 900][:20] and len(stored.read) <= 2 and after is not None
    seen, cursor = [], None
    while not seen or cursor:
        page, cursor = stored.page(30, cursor, F.col("m") < 4, F.col("k") % 5 == 0)
        seen += [r.k for r in page]
    assert seen == [k for k in keys if k % 7 < 4 and k % 5 == 0]
    assert pages.decode_cursor(pages.encode_cursor({"offset": "ä", "exclude_point_id": "ä"})) == {"offset": "ä", "exclude_point_id": "ä"} and pages.encode_cursor(None) is None
    assert pages.KeyedPages(thousand.limit(0), "k").page(5) == ([], None)


SPAN = "doc_id int, page int, x1 double, y1 double, x2 double, y2 double, text string, bold boolean"


def test_merged_cells_broken_lines_and_headers(spark):
    """A 3 by 4 grid drawn in pieces: a header over two columns, a cell over two rows, an empty row, and another table beside it."""
    h = [(y, x1, x2) for y in (0, 20, 60, 80) for x1, x2 in ((0, 48), (47, 152))] + [(40, 50, 100), (40.9, 99, 150)]
    v = [(x, 0, 80) for x in (0, 150)] + [(50, 0, 41), (50.6, 40, 80), (100, 20, 80)]
    segments = [(1, 1, x1, y, x2, y) for y, x1, x2 in h] + [(1, 1, x, y1, x, y2) for x, y1, y2 in v]
    segments += [(1, 1, 300.0, y, 400.0, y) for y in (0.0, 20.0)] + [(1, 1, x, 0.0, x, 20.0) for x in (300.0, 350.0, 400.0)]
    segments += [(2, 1, 0.0, 0.0, 100.0, 0.0), (2, 1, 0.0, 20.0, 100.0, 20.0), (2, 1, 0.0, 0.0, 0.0, 20.0), (2, 1, 100.0, 0.0, 100.0, 20.0)]  # one column
    words = [(10, 5, "A", True), (60, 5, "B", True), (110, 6, "C", True), (10, 35, "left  over", False), (10, 45, "two", False), (60, 25, "x", True), (60, 45, "y", False), (120, 45, "z", False), (310, 5, "p", False), (360, 5, "q", False), (900, 900, "out", False)]
    spans = [(1, 1, float(x), float(y), x + 8.0, y + 8.0, t, b) for x, y, t, b in words] + [(2, 1, 5.0, 5.0, 9.0, 9.0, "alone", True)]
    lines = spark.createDataFrame([(d, p, *map(float, r)) for d, p, *r in segments], "doc_id int, page int, x1 double, y1 double, x2 double, y2 double")
    got = [(r.table, r.row, r.line, r.header) for r in ruled.ruled_tables(lines, spark.createDataFrame(spans, SPAN)).orderBy("doc_id", "table", "row").collect()]
    assert got == [
        (0, 1, "Dòng 1: Cột 1: A | Cột 2–3: B C", "A | B C"),
        (0, 2, "Dòng 2: Cột 1: left over two | Cột 2: x", "A | B C"),
        (0, 3, "Dòng 3: Cột 1: left over two | Cột 2: y | Cột 3: z", "A | B C"),
        (1, 1, "Dòng 1: Cột 1: p | Cột 2: q", ""),
    ]
    assert ruled.ruled_tables(lines.limit(0), spark.createDataFrame(spans, SPAN)).count() == 0


def test_section_intervals(spark):
    paths = [("d", ["a"]), ("d", ["a", "b"]), ("d", ["a", "b", "c"]), ("d", ["a", "x"]), ("d", ["b", "q"]), ("e", ["a", "b"]), (None, ["a"]), ("d", [])]
    chunks = spark.createDataFrame([(i, d, p) for i, (d, p) in enumerate(paths * 2)], "chunk_id long, document_id string, path array<string>")
    tree = {(r.document_id, "/".join(r.scope)): (r.start, r.end) for r in search.section_tree(chunks).collect()}
    assert tree == {("d", "a"): (0, 4), ("d", "a/b"): (1, 3), ("d", "a/b/c"): (2, 3), ("d", "a/x"): (3, 4), ("d", "b"): (4, 6), ("d", "b/q"): (5, 6), ("e", "a"): (0, 2), ("e", "a/b"): (1, 2)}
    first = search.first_chunks(chunks, search.section_tree(chunks), 3).where("document_id = 'd' AND start = 0")
    assert [r.chunk_id for r in first.orderBy("chunk_id").collect()] == [0, 1, 2]
    scopes = spark.createDataFrame([(1, "d", ["a"], 1), (1, "e", ["a"], 2), (2, "d", ["b"], 1), (2, "d", ["a", "b"], 2), (2, "d", ["a", "x"], 3), (2, "e", ["a"], 4)], "query_id long, document_id string, scope array<string>, rank int")
    got = [(r.query_id, r.chunk_id, r.scope_rank, r.limited) for r in search.expand_selected(chunks, scopes, 3, 5).orderBy("query_id", "position").collect()]
    assert got == [(1, c, 1, True) for c in (0, 1, 2, 3, 8)] + [(2, 4, 1, True), (2, 12, 1, True), (2, 1, 2, True), (2, 2, 2, True), (2, 9, 2, True)]


def test_outline_of_many_lines(spark):
    text = "\n".join("" if i % 2 else ("1.1 Title here" if i % 1000 == 0 else "a body line") for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.perf_counter()
    assert chunking.heading_rows(docs).count() == 100
    assert time.perf_counter() - began < 60


def test_lookup_by_a_code_that_must_be_unique(spark):
    points = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, None)], "id int, code string")
    assert {tuple(r) for r in rows.one_of_each(points, "code").collect()} == {(1, "a"), (2, "b")}
    with pytest.raises(Exception, match="several rows of b"):
        rows.one_of_each(points.unionAll(points.where("id = 2")), "code").collect()


LINE = "doc_id int, page int, line int, span int, text string, size double, bold boolean, x1 double, y1 double, x2 double, y2 double, page_height double"
TABLE = "doc_id int, page int, table int, x1 double, y1 double, x2 double, y2 double, row int, line string, header string"


def test_assembly_of_pages(spark):
    """Rows are packed whole, headers carried over a page's end only where nothing stands between, footers dropped."""
    text = lambda doc, page, line, said, y, bold=False: (doc, page, line, 0, said, 10.0, bold, 20.0, y, 90.0, y + 8, 1000.0)
    lines = [
        text(1, 1, 1, "1. First:", 10.0, True), text(1, 1, 2, "body one", 30.0), text(1, 1, 3, "in the table", 105.0), text(1, 1, 4, "12", 950.0), text(1, 2, 1, "after", 300.0), text(1, 2, 2, "2. Second:", 400.0, True),
        text(1, 3, 1, "between", 20.0), text(2, 1, 1, "only a line", 10.0),
    ]
    row = lambda page, n, said, header, y=100.0, x2=200.0: (1, page, 0, 10.0, y, x2, y + 50, n, f"Dòng {n}: {said}", header)
    tables = [row(1, 1, "a | b", "a | b"), row(1, 2, "x" * 30, "a | b"), row(1, 3, "y" * 200, "a | b"), row(2, 1, "goes on", "", 50.0, 202.0), row(2, 2, "c | d", "c | d", 50.0, 202.0), row(3, 1, "anew", "", 60.0)]
    images = spark.createDataFrame([(1, 2, 5.0, 500.0), (1, 2, 6.0, 600.0)], "doc_id int, page int, x double, y double")
    got = assembly.assembled(spark.createDataFrame(lines, LINE), spark.createDataFrame(tables, TABLE), images, size=220, overlap=20)
    rows_of = [(r.chunk_index, "/".join(r.section_path), r.content) for r in got.where("doc_id = 1").orderBy("chunk_index").collect()]
    head = lambda page, columns: f"Bảng, trang PDF {page}. Các ô cùng dòng thuộc cùng một bản ghi." + (f"\nTiêu đề nhóm cột: {columns}" if columns else "")
    assert rows_of == [
        (0, "1. First:", "body one"),
        (1, "1. First:", f"{head(1, 'a | b')}\nDòng 1: a | b\nDòng 2: {'x' * 30}"),
        (2, "1. First:", f"{head(1, 'a | b')}\nDòng 3: {'y' * 200}"),
        (3, "1. First:", f"{head(2, 'a | b')}\nDòng 1: goes on"),
        (4, "1. First:", f"{head(2, 'c | d')}\nDòng 2: c | d"),
        (5, "1. First:", "after"),
        (6, "2. Second:", "between"),
        (7, "2. Second:", f"{head(3, '')}\nDòng 1: anew"),
    ]
    assert [tuple(r) for r in got.where("doc_id = 2").collect()] == [(2, 0, None, [], "only a line")]
