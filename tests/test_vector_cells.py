"""Exact search through cells against all pairs."""

import numpy as np
import pytest

from marlspark.operators import vector_cells
from marlspark.operators.vector_cells import Cells


def table(spark, rows, names):
    return spark.createDataFrame(rows, names)


def by_hand(points, queries, k, least=-2.0):
    out = []
    for q, v in queries:
        if v is None or len(v) != len(queries[0][1]):
            continue
        scores = [(-round(float(np.clip(np.dot(v, p), -1, 1)), 6), i) for i, p in points if p is not None and len(p) == len(v)]
        out += [(q, i, -s, n) for n, (s, i) in enumerate(sorted(s for s in scores if -s[0] >= least)[:k], 1)]
    return sorted(out)


def vectors(n, dims=6, groups=8, noise=0.08, seed=4):
    deal = np.random.default_rng(seed)
    middle = deal.normal(size=(groups, dims))
    found = middle[deal.integers(groups, size=n)] + noise * deal.normal(size=(n, dims))
    return (found / np.linalg.norm(found, axis=1, keepdims=True)).tolist()


def rows(df):
    return sorted((r["query_id"], r["id"], r["similarity"], r["rank"]) for r in df.collect())


@pytest.fixture(scope="module")
def clustered():
    points = list(enumerate(vectors(1500))) + [(9000 + i, v) for i, v in enumerate(vectors(3) * 40)]
    return points, [(i, v) for i, v in points if i % 20 == 0]


def test_equals_all_pairs_and_compares_few(spark, clustered):
    points, queries = clustered
    p, q = table(spark, points, "id long, embedding array<double>"), table(spark, queries, "query_id long, vector array<double>")
    cells = Cells.build(p, 6, cells=16, part_points=50)
    hits, compared = cells.search(q, 5, first_points=60, part_queries=20)
    assert rows(hits) == by_hand(points, queries, 5)
    mean = np.mean([r["compared"] for r in compared.collect()])
    assert mean < len(points) / 3
    assert "CartesianProduct" not in hits._jdf.queryExecution().toString() and "NestedLoop" not in hits._jdf.queryExecution().toString()
    assert rows(cells.search(q, 400, 0.9, first_points=60)[0]) == by_hand(points, queries, 400, 0.9)


def test_nulls_other_lengths_and_vectors_without_structure(spark):
    points = list(enumerate(vectors(200, groups=200))) + [(500, None), (501, [1.0, 0.0])]
    queries = [(1, points[1][1]), (2, None), (3, points[7][1]), (4, [0.0, 1.0])]
    p, q = table(spark, points, "id long, embedding array<double>"), table(spark, queries, "query_id long, vector array<double>")
    assert rows(vector_cells.nearest(p, q, 7, dimension=6)) == by_hand(points, queries, 7)


def test_empty_sides(spark, clustered):
    points, queries = clustered
    p, q = table(spark, points[:5], "id long, embedding array<double>"), table(spark, queries[:2], "query_id long, vector array<double>")
    assert vector_cells.nearest(p.limit(0), q, 3).count() == 0
    assert vector_cells.nearest(p, q.limit(0), 3).count() == 0
