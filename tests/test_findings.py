"""Queries on small tables of their own, worked out by hand."""

import datetime
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from marlspark.operators import chunking, pages, ruled, search, search_index, vector_best, vector_cells
from marlspark.plans import images, metadata, registry, requests, retrieval, text


def held(spark, folder, **tables):
    """The folder, with the given tables (rows, schema) written to it."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_any_running_job_keeps_a_source_from_being_due(spark, tmp_path):
    old = datetime.datetime(1995, 1, 1)
    jobs = [(1, 7, "P", old), (2, 8, "P", old), (3, 7, "F", old)]
    at = held(spark, tmp_path, orders=(jobs, "o_custkey long, o_orderkey long, o_orderstatus string, o_orderdate timestamp"), customer=([(k,) for k in (1, 2, 3, 4)], "c_custkey long"))
    assert sorted(r.c_custkey for r in metadata.due_sources(spark, at).collect()) == [3, 4]


def test_products_of_one_code_share_their_payload(spark, tmp_path):
    lines = [(1, "A", 50.0), (2, "A", 1.0), (2, "B", 47.0), (3, "A", 49.0)]
    at = held(spark, tmp_path, lineitem=(lines, "l_partkey long, l_returnflag string, l_quantity double"), part=([(1, "x"), (2, "x"), (3, "y")], "p_partkey long, p_name string"))
    got = {r.code: r.payload for r in requests.availability_payload(spark, at).collect()}
    assert got == {"x": '{"A":{"available":true},"B":{"available":false}}', "y": '{"A":{"available":false}}'}


def test_a_line_that_looks_like_a_heading_has_its_window(spark, tmp_path):
    texts = [(1, "20.118.157.107 and what follows"), (2, "# Title"), (3, "A. plain line\nand more"), (4, " \n ")]
    at = held(spark, tmp_path, documents=(texts, "doc_id long, text string"))
    assert sorted(tuple(r) for r in text.fixed_cover(spark, at).collect()) == [(k, True, True, True, True) for k in (1, 2, 3)]


def test_scopes_end_at_the_last_numbered_heading_as_in_the_sql(spark, tmp_path):
    """A document's ninth word may be a number, so that its third heading looks numbered too."""
    duckdb = pytest.importorskip("duckdb")
    words = "apple pear plum fig lemon lime melon grape"
    texts = [(1, f"{words} 118 157 107 Betz"), (3, f"{words} quince 12 13 14"), (4, f"{words} 20 21 22 23"), (5, "apple 7"), (7, f"{words} 1 2 3 4")]
    questions = [(0, "apple"), (1, "Chi tiet apple"), (2, "what is lime and 118 157 107")]
    at = held(spark, tmp_path, documents=([(k, t, "en", f"s{k}") for k, t in texts], "doc_id long, text string, lang string, source string"), benchmark=(questions, "item_id long, text string"))
    got = sorted(tuple(r) for r in retrieval.section_scopes(spark, at).select("query_id", "document_id", "scope", "rank").collect())
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.oracle_sql()["section_scopes"]).fetchall())
    assert (0, "s1", "1. apple pear plum fig/1.2 lemon lime melon grape/118 157 107 Betz", 1) in [(q, d, x, 1) for q, d, x, _ in got]


def test_bm25_scores_documents_where_they_lie(spark):
    """Blocks, ties and repeated words as by brute force, and no shuffle of postings or of scores by document."""
    draw = random.Random(3)
    docs = [(i, " ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 12))) if i % 9 else None) for i in range(150)]
    asked = [(q, " ".join(draw.sample("abcdefghxyz", 3))) for q in range(12)] + [(12, "x y"), (13, None)]
    got = search.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, query string"), 4)
    assert "hashpartitioning(doc_id" not in (plan := got._jdf.queryExecution().toString()) and "hashpartitioning(term" not in plan
    words = {d: (t or "").split() for d, t in docs}
    mean = sum(map(len, words.values())) / len(docs)
    df = {w: sum(w in x for x in words.values()) for w in "abcdefgh"}
    want = set()
    for q, t in asked:
        scores = {}
        for d, x in words.items():
            both = set((t or "").split()) & set(x)
            parts = [math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * x.count(w) * 2.5 / (x.count(w) + 1.5 * (0.25 + 0.75 * len(x) / mean)) for w in both]
            if parts:
                scores[d] = round(sum(parts), 6)
        want |= {(q, d, n) for n, d in enumerate(sorted(scores, key=lambda d: (-scores[d], d))[:4], 1)}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got.collect()} == want


def test_best_vectors_leave_a_task_alone(spark):
    """As by brute force with ties, groups, kinds and own pictures; one task hands on no more than the best."""
    draw = random.Random(5)
    rows = [(i, [draw.choice([-0.5, 0.0, 0.5]) for _ in range(4)] if i % 17 else None, i % 3 if i % 5 else None, i % 7) for i in range(300)]
    points = spark.createDataFrame(rows, "id long, embedding array<float>, label int, product int").coalesce(1)
    asked = points.where("id % 20 = 0").selectExpr("id AS query_id", "embedding AS vector", "label AS query_label", "id % 60 = 0 AS own")
    for k, by, same in ((1, "product", None), (5, None, None), (5, None, ("label", "query_label"))):
        got = [(r.query_id, r["product"] if by else None, -r.similarity, r.id) for r in vector_best.vector_best(points, asked, k, by, same).collect()]
        want = []
        for q, vector, label, _ in rows[::20]:
            groups = {}
            for i, other, kind, product in rows:
                if vector and other and (i != q or q % 60 == 0) and (not same or label is not None and label == kind):
                    groups.setdefault(product if by else None, []).append((-max(-1.0, min(1.0, sum(a * b for a, b in zip(vector, other, strict=True)))), i))
            want += [(q, g, *x) for g, found in groups.items() for x in sorted(found)[:k]]
        assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("spread, scale", [(1.0, 1.0), (1e-3, 1.0), (1.0, 1e20)])
def test_only_the_best_groups_leave_a_task(spark, spread, scale):
    """As by brute force, for similarities that 32 bits can't tell apart and for lengths that they can't hold."""
    draw = random.Random(7)
    units = [[x / 8 ** 0.5 + spread * draw.uniform(-1, 1) for x in [1.0] * 8] for _ in range(400)]
    rows = [(i, [scale * x / sum(y * y for y in v) ** 0.5 for x in v], i % 23) for i, v in enumerate(units)]
    points = spark.createDataFrame(rows, "id long, embedding array<float>, product int").coalesce(1)
    asked = points.where("id % 20 = 0").selectExpr("id AS query_id", "embedding AS vector", "false AS own")
    rows = points.collect()
    got = {(r.query_id, r["product"], r.id, round(r.similarity, 6)) for r in vector_best.vector_best(points, asked, 1, "product", most=3).collect()}
    want = set()
    for q in rows[::20]:
        best = {}
        for r in rows:
            if r.id != q.id:
                x = round(max(-1.0, min(1.0, sum(a * b for a, b in zip(q.embedding, r.embedding, strict=True)))), 6)
                best[r["product"]] = min(best.get(r["product"], (2, 0)), (-x, r.id))
        third = sorted(best.values())[2][0]
        want |= {(q.id, g, i, -x) for g, (x, i) in best.items() if x <= third}
    assert got == want


def test_pictures_of_one_file_are_compared_in_many_tasks(spark, tmp_path, monkeypatch):
    """Eight products of each query leave a task; the result is that of the SQL."""
    duckdb = pytest.importorskip("duckdb")
    draw, told, plain = random.Random(9), [], vector_best.vector_best
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    at = held(spark, tmp_path, embeddings=([(i, unit([draw.gauss(0, 1) for _ in range(16)]), i % 10) for i in range(1200)], "vec_id long, embedding array<float>, label int"))
    monkeypatch.setattr(vector_best, "vector_best", lambda *a, **b: told.append(plain(*a, **b)) or told[-1])
    got = sorted(tuple(r) for r in images.weighted_rerank(spark, at).collect())
    left = told[0].groupBy(F.spark_partition_id().alias("task"), "query_id").count().collect()
    assert len({r.task for r in left}) > 1 and max(r["count"] for r in left) <= 8
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{at}/embeddings.parquet/*.parquet'")
    assert got == sorted(con.execute(registry.oracle_sql()["weighted_rerank"]).fetchall())


def test_filtered_vectors_of_one_file_are_compared_in_many_tasks(spark, tmp_path, monkeypatch):
    """No more than 20 points of a query leave a task; the result is that of the SQL, for odd vectors, ids and labels too."""
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(vector_best, "QUERY_BATCH", 30)
    draw, told, plain = random.Random(13), [], vector_best.vector_best
    drawn = lambda: [draw.choice([-1, 0, 1, 2, 3]) / 16 for _ in range(8)]  # noqa: E731 (products of halves of a millionth)
    odd = {110: None, 130: [math.nan] * 8, 170: [math.inf, -math.inf] + [0.0] * 6}
    vectors = [(i, next((v for n, v in odd.items() if i % n == 0), drawn()), draw.randrange(3)) for i in range(1500)]
    vectors = [(None, [0.1875] * 8, x) if i % 50 == 7 else (i, v, None if i % 23 == 0 else x) for i, v, x in vectors] + [(i, drawn(), 1) for i in range(0, 200, 5)]
    states = [(i, draw.choice([0, 1, 1, None])) for i in range(0, 1500, 2)] + [(i, 1) for i in range(0, 1500, 12)] + [(None, 0)]
    at = held(spark, tmp_path, embeddings=(vectors, "vec_id long, embedding array<float>, label int"), labels=(states, "doc_id long, quality int"))
    monkeypatch.setattr(vector_best, "vector_best", lambda *a, **b: told.append(plain(*a, **b)) or told[-1])
    got = [(r.query_id, r["rank"], r.id, f"{r.similarity:.6f}") for r in retrieval.vector_filtered(spark, at).collect()]
    left = told[0].groupBy(F.spark_partition_id().alias("task"), "query_id").count().collect()
    assert len({r.task for r in left}) == 3 * 4 and max(r["count"] for r in left if r.query_id >= 200) <= 20  # three blocks in four tasks each; ids below are there twice
    con = duckdb.connect()
    for name in ("embeddings", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{at}/{name}.parquet/*.parquet'")
    want = con.execute(f"SELECT query_id, rank, id, similarity FROM ({registry.oracle_sql()['vector_filtered']})").fetchall()
    assert any(r[2] is None for r in want) and any(r[3] == 1 for r in want) and any(r[3] < 0.3 for r in want)
    assert sorted(got) == sorted((q, n, i, f"{x:.6f}") for q, n, i, x in want)


def test_a_walk_is_what_cursors_give(spark):
    """Page by page and at once, over parts without a match and a last page that is full."""
    rows = spark.range(1000).select((F.col("id") * 3).alias("k"), (F.col("id") % 10).alias("x"))
    where, wanted = (F.col("k") < 300) | (F.col("k") > 900), F.col("x") < 5
    stored = pages.KeyedPages(rows, "k", 40)
    for limit in (50, 400):
        told, cursor, number = [], None, 0
        while number == 0 or cursor is not None:
            number += 1
            found, cursor = stored.page(limit, cursor, where, wanted)
            told += [(r["k"], number) for r in found]
        assert sorted((r["k"], r["page"]) for r in stored.walk(limit, where, wanted).collect()) == told


def test_few_texts_are_cut_at_once(spark):
    """A task that gets many long texts in one batch embeds few of them at a time."""

    def embed(texts):
        assert len(texts) <= 40 * chunking.CUT_ROWS
        return chunking.hashing_embedder(texts)

    docs = spark.range(400).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("One sentence that is rather short. "), 40 * 2).alias("text"))
    docs = docs.withColumn("text", F.substring("text", 1, 1400))
    assert chunking.adaptive_stats(docs, embed).count() == 400


def test_an_index_hands_on_the_best_of_a_task_only(spark):
    """No row for each query and document is shuffled, and what is left out isn't among the best; levels, ties and lengths as by scoring everything."""
    draw = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(draw.choice("abcdefgh") for _ in range(draw.choice([0, 3, 9, 40]))), "es" if i % 3 else "de") for i in range(300)], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(q, " ".join(draw.sample("abcdefghxyz", 3))) for q in range(12)] + [(12, "x y"), (13, None)], "query_id long, query string")
    index = search_index.SearchIndex(spark, range_docs=16)
    index.rebuild(lambda: docs.where("doc_id < 290"))
    changed = docs.where("doc_id >= 290").unionByName(docs.where("doc_id < 10").withColumn("text", F.lit("a a b")))
    assert index.apply(changed) == 2
    now = docs.where("doc_id >= 10").unionByName(changed.where("doc_id < 10"))
    for keep in (None, F.col("lang") == "es"):
        got = index.snapshot().search(asked, 4, keep).hits
        assert not re.search(r"hashpartitioning\([^)]*doc_id", got._jdf.queryExecution().toString())
        assert {tuple(r) for r in got.select("query_id", "doc_id", "score", "rank").collect()} == {tuple(r) for r in search.bm25(now, asked, 4, keep).select("query_id", "doc_id", "score", "rank").collect()}


def test_pages_follow_each_other_in_a_task(spark):
    """No call for each page, and a word of a long table is looked up among its lines, not among all cells."""
    n, wide = 1200, 4
    level = [(d, 1, 0.0, y * 10.0, wide * 50.0, y * 10.0) for d, m in ((1, n), (2, 2)) for y in range(m + 1)]
    upright = [(d, 1, x * 50.0, 0.0, x * 50.0, m * 10.0) for d, m in ((1, n), (2, 2)) for x in range(wide + 1)]
    lines = spark.createDataFrame(level + upright, "doc_id long, page int, x1 double, y1 double, x2 double, y2 double")
    words = [(d, 1, x * 50.0 + 5, y * 10.0 + 2, x * 50.0 + 20, y * 10.0 + 8, f"{d}.{y}.{x}", y == 0) for d, m in ((1, n), (2, 2)) for y in range(m) for x in range(wide)]
    spans = spark.createDataFrame([*words, (3, 1, 1.0, 1.0, 2.0, 2.0, "no table", False), (1, 1, None, 1.0, 2.0, 2.0, "nowhere", False)], "doc_id long, page int, x1 double, y1 double, x2 double, y2 double, text string, bold boolean")
    found = ruled.ruled_tables(lines, spans)
    assert "CoGroups" not in found._jdf.queryExecution().toString()
    got = {(r.doc_id, r.row): (r.line, r.header) for r in found.collect()}
    row = lambda d, y: [f"{d}.{y}.{x}" for x in range(wide)]
    assert got == {(d, y + 1): (f"Dòng {y + 1}: " + " | ".join(f"Cột {x + 1}: {w}" for x, w in enumerate(row(d, y))), " | ".join(row(d, 0))) for d, m in ((1, n), (2, 2)) for y in range(m)}


def test_visits_are_written_down_few_at_a_time(spark, monkeypatch):
    """Many queries in one batch that visit all rings: numbers only, and no more rows at once than stated; the result is that of all pairs."""
    monkeypatch.setattr(vector_cells, "VISIT_ROWS", 500)
    draw = random.Random(11)
    rows = [(i, [draw.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    rows = [(i, [x / math.sqrt(sum(y * y for y in v)) for x in v]) for i, v in rows]
    points = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = points.selectExpr("id AS query_id", "embedding AS vector", "CAST(NULL AS double) AS threshold").coalesce(1)
    cells = vector_cells.Cells.build(points, 4, 4, 16, 20)
    visits, sizes = cells._visits(asked, 4, 16, True, 10_000, -2.0), []
    assert visits.columns == ["query_id", "cell", "ring", "slot"]
    with monkeypatch.context() as patch:
        patch.setattr(type(asked), "mapInArrow", lambda frame, run, schema: sizes.extend(b.num_rows for b in run(iter(frame.toArrow().combine_chunks().to_batches()))))
        cells._visits(asked, 4, 16, True, 10_000, -2.0)
    assert sum(sizes) == visits.count() and max(sizes) <= 500 < sum(sizes)
    got = {(r.query_id, r.id) for r in cells.search(asked, 3, rings=16, first_points=30)[0].collect()}
    assert got == {(q, i) for q, v in rows for _, i in sorted((-round(max(-1.0, min(1.0, sum(a * b for a, b in zip(v, w, strict=True)))), 6), i) for i, w in rows)[:3]}


def test_a_word_is_hashed_once(monkeypatch):
    """However many windows hold it; the vectors are those of hashing every word of every text."""
    texts, crc, asked = ["Ein Satz.\n\nZwei\nWörter", "Zwei\nWörter\n\nΟΔΟΣ\n\n\nzwei", "", "\n\n", "zwei ein, ein"], zlib.crc32, []
    monkeypatch.setattr(zlib, "crc32", lambda x: asked.append(x) or crc(x))
    got = chunking.hashing_embedder(texts)
    assert len(asked) == len(set(asked)) == 5
    for text, row in zip(texts, got.tolist(), strict=True):
        want = [0.0] * 64
        for word in re.findall(r"\w+", text.lower()):
            want[crc(word.encode()) % 64] += 1 if crc(word.encode()) & 0x10000 else -1
        norm = math.sqrt(sum(x * x for x in want)) or 1
        assert row == pytest.approx([x / norm for x in want], abs=1e-15)
    assert chunking.hashing_embedder([]).shape == (0, 64)
    assert chunking.cut_pieces("  short ", 10) == ["short"] and chunking.cut_pieces(" \n ", 10) == []
