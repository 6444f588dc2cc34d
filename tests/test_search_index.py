"""The stored index against scoring everything."""

import random

import pytest
from pyspark.sql import functions as F

from marlspark.operators import search
from marlspark.operators.search_index import SearchIndex
from marlspark.sources.manifest import Manifests, Revision


def texts(n, seed=1):
    deal = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(deal.choices(words, weights, k=deal.randrange(1, 40)))) for i in range(n)] + [(n, None), (n + 1, "")]


def hits(found):
    return sorted(map(tuple, found.select("query_id", "doc_id", "score", "rank").collect()))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "w0 w250 w3"), (2, "w7"), (3, "nothing known"), (4, "w1 w2 w299 w120 w64 w5")], "query_id long, query string")


def test_changes_levels_and_one_version_throughout(spark, queries):
    docs = spark.createDataFrame(texts(400), "doc_id long, text string")
    index = SearchIndex(spark, range_docs=8)
    assert index.snapshot().search(queries, 5).hits.count() == 0
    index.rebuild(lambda: docs)
    before = index.snapshot()
    first = hits(search.bm25(docs, queries, 5))
    assert hits(before.search(queries, 5).hits) == first

    changed = spark.createDataFrame([(3, "w7 w7 w7"), (4, "w0 w250 w3"), (900, "w299 w1"), (901, None)], "doc_id long, text string")
    gone = spark.createDataFrame([(r[1],) for r in first if r[0] == 2][:2] + [(77777,)], "doc_id long")
    assert index.apply(changed) == 2
    assert index.apply(changed.limit(0), gone) == 2  # folded into the small level before it
    ids = [r.doc_id for r in changed.collect()] + [r.doc_id for r in gone.collect()]
    now = docs.where(~F.col("doc_id").isin(ids)).unionByName(changed)
    now = now.join(gone, "doc_id", "left_anti")
    after = hits(search.bm25(now, queries, 5))
    assert hits(index.snapshot().search(queries, 5).hits) == after != first
    assert hits(before.search(queries, 5).hits) == first
    assert index.snapshot().documents().count() == now.count()

    more = spark.createDataFrame([(2000 + i, t) for i, t in texts(200, 9)], "doc_id long, text string")
    assert index.apply(more) == 1  # as large as a quarter of all: one level again
    assert hits(index.snapshot().search(queries, 5).hits) == hits(search.bm25(now.unionByName(more), queries, 5))


def test_most_blocks_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"common{i % 3} filler{i % 50} " + ("rare rare " if i in (17, 400, 801) else "") + "x " * (i % 7)) for i in range(3000)], "doc_id long, text string")
    index = SearchIndex(spark, range_docs=16)
    index.rebuild(lambda: docs)
    asked = spark.createDataFrame([(1, "rare common1"), (2, "rare filler7")], "query_id long, query string")
    found = index.snapshot().search(asked, 2)
    assert hits(found.hits) == hits(search.bm25(docs, asked, 2))
    for row in found.touched.collect():
        assert row["read"] < row["blocks"] / 5, row


def test_a_change_during_the_build(spark, tmp_path, queries):
    revision = Revision(spark, f"{tmp_path}/revision")
    docs, calls = spark.createDataFrame(texts(30), "doc_id long, text string"), []

    def load():
        calls.append(revision.now())
        if len(calls) == 1:
            revision.bump()  # someone writes after the revision was read
            return docs.limit(3)
        return docs

    index = SearchIndex(spark, f"{tmp_path}/index")
    assert index.rebuild(load, revision) == 1 and calls == [0, 1]
    assert index.snapshot().revision == 1 and index.snapshot().content["docs"] == 32
    assert hits(index.snapshot().search(queries, 5).hits) == hits(search.bm25(docs, queries, 5))

    def restless():
        revision.bump()
        return docs

    with pytest.raises(RuntimeError):
        index.rebuild(restless, revision)
    assert index.snapshot().revision == 1


def test_a_number_is_published_once(spark, tmp_path):
    kept = Manifests(spark, str(tmp_path))
    assert kept.latest() is None
    assert kept.publish(1, {"a": "ä"}) and not kept.publish(1, {"a": 2})
    assert kept.latest() == (1, {"a": "ä"})
