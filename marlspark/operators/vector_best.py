"""The best points of each query, or of each query and group, over all pairs of points and queries.

Each task multiplies its points with a block of queries, part by part, and keeps the best of each group only; what
leaves it is at most `k` rows for each query and group, or one for each of a query's `most` best groups, whatever the
number of points. The block, of at most QUERY_BATCH query vectors, is sent to every task; more blocks read the points
again. All pairs that count are compared, so the time grows with points times queries; a task's memory with the
block times the groups.

Defined results: similarity is the product of unit vectors, held to [-1, 1] and rounded to 6 digits, halves away from
zero, ties by id, null last; vectors that are null or of another length than the queries' are no points, and such queries
find nothing. With `odd` they do, as `greatest` and `least` have it in SQL: a product that is no number counts as 1. Pairs are
looked through in 32 bits, held against the least less the error these can have; what may reach it is worked out in 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlspark.operators.search import QUERY_BATCH

#: Points and queries that are multiplied at once (of fewer points more queries); pairs that a task holds before it goes through them.
POINT_ROWS, QUERY_ROWS, HELD = 1_024, 250, 2_000_000
#: Similarities are whole millionths; BITS hold 0 to 2 * MILLION. Unrounded ones are held against the least less MARGIN.
MILLION, BITS, MARGIN = 1_000_000, 21, 1e-6
#: Where null ids come in.
LAST = 2**63 - 1


def vector_best(points: DataFrame, queries: DataFrame, k: int, by: str | None = None, same: tuple[str, str] | None = None, most: int | None = None, odd: bool = False) -> DataFrame:
    """(the queries' columns, the points' columns, similarity): of each task the `k` best points of each query, or of each query and value of `by`.

    points: id (long), embedding and more; queries: query_id (long), vector, own (whether the point of that id
    counts) and more. With `same`, a column of the points and one of the queries, only pairs that agree in it count, and are multiplied.
    The best of all tasks are among the rows. With `most` (and a `k` of 1) only the points of a query's `most` most
    similar groups in the task and of those that tie with the last: who has as many groups ahead in one task has them
    ahead in all, so the `most` best groups of all tasks and their best points are among the rows.
    """
    if most and (k != 1 or not by):
        raise ValueError("most is for the best point of each group")
    blocks = -(-queries.count() // QUERY_BATCH) or 1
    found = None
    for i in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        part = _best_of_block(points, block, k, by, same, most, odd)
        found = part if found is None else found.unionAll(part)
    return found


def _matrix(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of `dimension` numbers (cut or filled up with zeros; nulls in them are no numbers), and their lengths, -1 for null."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if (length == dimension).all():
        return flat.reshape(-1, dimension), length
    matrix, there = np.zeros((len(length), dimension)), np.arange(dimension) < length[:, None]
    start = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    matrix[there] = flat[(start[:, None] + np.arange(dimension))[there]]
    return matrix, length


def _millionths(scores: np.ndarray) -> np.ndarray:
    """Rounded as SQL does, halves away from zero."""
    scores = scores * MILLION
    whole = np.trunc(scores)
    return (whole + np.where(np.abs(scores - whole) >= 0.5, np.sign(scores), 0)).astype(np.int64)


def _best_of_block(points: DataFrame, queries: DataFrame, k: int, by: str | None, same: tuple[str, str] | None, most: int | None, odd: bool) -> DataFrame:
    sound = lambda v: F.col(v).isNotNull() & ~F.exists(v, lambda x: x.isNull())
    asked = (queries if odd else queries.where(sound("vector"))).orderBy("query_id").toArrow().combine_chunks()  # QUERY_BATCH at most
    dimension = max(1, pc.max(pc.list_value_length(asked["vector"])).as_py() or 0)
    if not odd:
        asked = asked.filter(pc.equal(pc.list_value_length(asked["vector"]), dimension))
    codes, bounds = {}, None
    if same:  # those of a kind follow each other; those of none are left out
        codes = {x: i for i, x in enumerate(asked[same[1]].drop_null().unique().to_pylist())}
        kinds = np.array([codes.get(x, -1) for x in asked[same[1]].to_pylist()], dtype=np.int64)
        order = np.argsort(kinds, kind="stable")[np.count_nonzero(kinds < 0) :]
        asked, bounds = asked.take(pa.array(order)), np.searchsorted(kinds[order], np.arange(len(codes) + 1))
    rest = asked.drop_columns(["vector", "own"]).combine_chunks()
    vectors, lengths = _matrix(pa.concat_arrays([pa.array([], asked["vector"].type), *asked["vector"].chunks]), dimension)
    ids, own = (asked[c].to_numpy() for c in ("query_id", "own"))
    told = [c for c in rest.column_names if c != "query_id"]
    kept = [c for c in points.columns if c != "embedding"]
    good = (points if odd else points.where((F.size("embedding") == dimension) & sound("embedding"))).withColumn("embedding", F.col("embedding").cast("array<double>"))
    of = lambda df, names: (f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    schema = ", ".join([*of(queries, ["query_id"]), *of(points, kept), "similarity double", *of(queries, told)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[object, int] = {}  # the values of `by` that were met
        least = np.full((len(ids), 1), -2 * MILLION)  # what a point of the query and group has to reach
        floor = np.full(len(ids), -2 * MILLION)  # with `most`: what a point of the query has to reach, whatever its group
        best = None  # query, group, similarity and the point's columns of the rows kept so far
        held: list[tuple] = []

        def nth_of(key: np.ndarray) -> np.ndarray:
            """The place of each row among the following ones of its key, from 0."""
            starts = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
            return np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))

        def settle() -> None:
            """Keep the best of what is held."""
            nonlocal best, held
            rows = [*([best] if best else []), *held]
            q, g, score = (np.concatenate([r[x] for r in rows]) for x in range(3))
            columns = [pa.concat_arrays([r[3][x] for r in rows]) for x in range(len(kept))]
            pair = q * least.shape[1] + g
            number = pc.fill_null(columns[kept.index("id")], LAST).to_numpy()
            order = np.lexsort((number, (pair << BITS) + MILLION - score))
            nth = nth_of(pair[order])
            full = order[nth == k - 1]
            least[q[full], g[full]] = score[full]
            order = order[nth < k]
            if most:
                order = order[np.lexsort((-score[order], q[order]))]
                last = order[nth_of(q[order]) == most - 1]
                floor[q[last]] = score[last]
                order = order[score[order] >= floor[q[order]]]
            best, held = (q[order], g[order], score[order], [c.take(pa.array(order)) for c in columns]), []

        def may(limit: np.ndarray, error: float) -> np.ndarray:
            """What an unrounded similarity has to reach; those under -1 count as -1."""
            return np.where(limit <= -MILLION, -np.inf, limit / MILLION - MARGIN - error)

        waiting, size = 0, POINT_ROWS // 16
        short, longest = vectors.astype(np.float32), np.linalg.norm(vectors, axis=1).max(initial=0.0)
        product = {x: np.empty(QUERY_ROWS * POINT_ROWS, x) for x in (np.float32, np.float64)}
        for whole in batches:
            start = 0
            while len(ids) and start < whole.num_rows:
                batch = whole.slice(start, size)
                start += batch.num_rows
                matrix, length = _matrix(batch.column("embedding"), dimension)
                there, named = pc.fill_null(batch.column("id"), LAST).to_numpy(), batch.column("id").is_valid().to_numpy(zero_copy_only=False)
                column = np.array([groups.setdefault(x, len(groups)) for x in batch.column(by).to_pylist()]) if by else np.zeros(len(there), dtype=int)
                if len(groups) > least.shape[1]:
                    least = np.concatenate([least, np.full((len(ids), max(len(groups), 2 * least.shape[1]) - least.shape[1]), -2 * MILLION)], axis=1)
                met = [(0, len(ids), np.arange(len(there)))]  # queries from, to, and the points that they meet
                if same:
                    kind = np.array([codes.get(x, -1) for x in batch.column(same[0]).to_pylist()])
                    order = np.argsort(kind, kind="stable")
                    cuts = np.flatnonzero(np.diff(kind[order], prepend=-2))
                    met = [(bounds[kind[x[0]]], bounds[kind[x[0]] + 1], x) for x in np.split(order, cuts[1:]) if kind[x[0]] >= 0]
                for first, last, rows in met:
                    right, far = matrix[rows], np.linalg.norm(matrix[rows], axis=1).max()
                    error = (dimension + 2) * 2.0**-23 * longest * far
                    unlike = odd and bool((length[rows] != dimension).any() or (lengths[first:last] != dimension).any())
                    fits = not unlike and error < 1e-3 and longest < 1e9 and far < 1e9  # not so for numbers that 32 bits can't hold
                    width, left, right = (np.float32, short, right.astype(np.float32)) if fits else (np.float64, vectors, right)
                    step = QUERY_ROWS * POINT_ROWS // len(rows)
                    for a in range(first, last, step):
                        part = slice(a, min(a + step, last))
                        with np.errstate(invalid="ignore", over="ignore"):
                            scores = np.matmul(left[part], right.T, out=product[width][: (part.stop - a) * len(rows)].reshape(part.stop - a, len(rows)))
                        if unlike:
                            scores[(lengths[part, None] != length[rows]) | (length[rows] < 0)] = np.nan
                        limit = may(floor[part, None] if most else least[part][:, column[rows]] if by else least[part], error if fits else 0.0).astype(width)
                        q, p = np.divmod(np.flatnonzero(~(scores < limit) if odd and not fits else scores >= limit), len(rows))
                        q, p = q + a, rows[p]
                        counts = named[p] & (ids[q] != there[p]) | own[q]
                        q, p = q[counts], p[counts]
                        exact = np.einsum("ij,ij->i", vectors[q], matrix[p])
                        if odd:
                            exact = np.where(np.isnan(exact) | (lengths[q] != length[p]) | (length[p] < 0), 1.0, exact)
                        score = _millionths(np.clip(exact, -1.0, 1.0))
                        reached = score >= least[q, column[p]]
                        q, p, score = q[reached], p[reached], score[reached]
                        if len(q):
                            held.append((q, column[p], score, [batch.column(c).take(pa.array(p)) for c in kept]))
                            waiting += len(q)
                        if waiting >= HELD:
                            settle()
                            waiting = 0
                if held and (best is None or waiting >= HELD // 8):
                    settle()
                    waiting = 0
                if best:
                    size = min(2 * size, POINT_ROWS)
        if held:
            settle()
        if best:
            q, _, score, columns = best
            query = rest.take(pa.array(q)).combine_chunks()
            of_query = {c: query[c].chunk(0) for c in query.column_names}
            yield pa.RecordBatch.from_arrays([of_query["query_id"], *columns, pa.array(score / MILLION), *(of_query[c] for c in told)], ["query_id", *kept, "similarity", *told])

    return good.select(*kept, "embedding").mapInArrow(run, schema)
