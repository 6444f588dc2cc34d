"""Exact nearest vectors through cells with angle bounds.

Every point belongs to the cell of its nearest centre and, by its angle to that centre, to a ring of the
cell; rings of many points are dealt to parts of about PART_POINTS. By the triangle inequality of angles a
point can't be nearer to a query than the gap between the query's angle to the centre and the ring. A query
visits rings in the order of this gap: first so many that they hold FIRST_POINTS, which gives the
similarity of its k-th neighbour; then those of the others whose gap allows as much. A part meets all its
queries at once, in blocks, as a product of two matrices, and gives k rows a query at most. Nothing is
cut: on vectors without structure all rings are visited. Visits are written down as numbers, few queries at a
time; the vectors join them when they meet a part.

The centres are fitted on a bounded sample (SAMPLE_POINTS); they only decide how much is visited. The list
of rings has at most CELLS * RINGS rows, whatever the data's size, and goes to every task.

Defined results: similarity is the product of unit vectors, held to [-1, 1] and rounded to 6 digits, ties
by id; vectors that are null or of another length than the queries' are no points; a query without a vector
finds nothing; empty sides give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspark.operators.search import stored, top_per_query

CELLS, RINGS = 128, 64
SAMPLE_POINTS = 10_000
PART_POINTS, PART_QUERIES = 4_000, 2_000
FIRST_POINTS = 2_000
#: Queries whose products with a part a task holds at once, and visits that it writes down at once.
MEET_QUERIES, VISIT_ROWS = 256, 50_000
#: Similarities are rounded to 6 digits, so gaps are held against the threshold less this.
MARGIN = 2e-6


def fit_centres(sample: np.ndarray, cells: int, turns: int = 8) -> np.ndarray:
    """Unit vectors in the middle of groups of the sample, which starts them at even steps."""
    if not len(sample):
        return np.zeros((1, sample.shape[1] if sample.ndim == 2 else 1))
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)]
    for _ in range(turns):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _angle(dots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(dots, -1.0, 1.0))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


@dataclass
class Cells:
    """Points (id, embedding, cell, ring, slot) in a table, and what queries need to know of the rings."""

    points: DataFrame
    centres: np.ndarray
    #: cell, ring, points in it, slots it is dealt to; one row for each ring that has points.
    rings: np.ndarray

    @classmethod
    def build(cls, points: DataFrame, dimension: int, cells: int = CELLS, rings: int = RINGS, part_points: int = PART_POINTS) -> Cells:
        spark = points.sparkSession
        good = points.where((F.size("embedding") == dimension) & ~F.exists("embedding", lambda x: x.isNull())).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        drawn = good.orderBy(F.xxhash64("id")).limit(SAMPLE_POINTS).select("embedding").toPandas()  # SAMPLE_POINTS vectors at most
        centres = fit_centres(np.array(drawn["embedding"].tolist(), dtype=np.float64).reshape(-1, dimension), cells)
        shared = spark.sparkContext.broadcast(centres)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dots = _matrix(batch.column("embedding"), dimension) @ shared.value.T
                cell = dots.argmax(axis=1)
                ring = np.minimum((_angle(dots[np.arange(len(cell)), cell]) * (rings / np.pi)).astype(np.int64), rings - 1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("embedding"), pa.array(cell.astype(np.int32)), pa.array(ring.astype(np.int32))], ["id", "embedding", "cell", "ring"])

        placed = stored(good.mapInArrow(place, "id long, embedding array<double>, cell int, ring int"), "cell-points")
        counts = placed.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("n")).withColumn("slots", F.ceil(F.col("n") / part_points).cast("int"))
        told = np.array([tuple(r) for r in counts.orderBy("cell", "ring").collect()], dtype=np.int64).reshape(-1, 4)  # CELLS * RINGS rows at most
        dealt = placed.join(F.broadcast(counts.select("cell", "ring", "slots")), ["cell", "ring"])
        return cls(dealt.select("id", "embedding", "cell", "ring", F.pmod(F.xxhash64("id"), F.col("slots")).cast("int").alias("slot")), centres, told)

    def _visits(self, queries: DataFrame, dimension: int, rings: int, first: bool, first_points: int, least: float) -> DataFrame:
        """(query_id, cell, ring, slot) of the rings that a query visits first, or of the others that may hold a neighbour.

        queries: query_id, vector, threshold (null: none). Those of the first visit are worked out alike in both.
        """
        centres, told = queries.sparkSession.sparkContext.broadcast(self.centres), queries.sparkSession.sparkContext.broadcast(self.rings)

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ring_of, width = told.value, np.pi / rings
            low, high = ring_of[:, 1] * width, (ring_of[:, 1] + 1) * width
            step = max(1, VISIT_ROWS // max(1, int(ring_of[:, 3].sum()))) if len(ring_of) else 0
            for batch in (whole.slice(start, step) for whole in batches for start in range(0, whole.num_rows, step or whole.num_rows)):
                if not len(ring_of):
                    return
                angle = _angle(_matrix(batch.column("vector"), dimension) @ centres.value.T)
                thresholds = batch.column("threshold").to_pylist()
                out = []
                for i, threshold in enumerate(thresholds):
                    at = angle[i, ring_of[:, 0]]
                    gap = np.maximum(0, np.maximum(low - at, at - high))
                    order = np.argsort(gap, kind="stable")
                    before = np.concatenate([[0], np.cumsum(ring_of[order, 2])[:-1]])
                    early = before < first_points
                    reach = np.cos(gap[order]) + MARGIN >= (least if threshold is None else max(least, threshold))
                    chosen = order[(early if first else ~early) & reach]
                    slots = ring_of[chosen, 3]
                    rows = np.repeat(chosen, slots)
                    out.append((np.full(len(rows), i), ring_of[rows, 0], ring_of[rows, 1], np.arange(len(rows)) - np.repeat(np.cumsum(slots) - slots, slots)))
                row, cell, ring, slot = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, dtype=int),) * 4
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row)), *(pa.array(c.astype(np.int32)) for c in (cell, ring, slot))], ["query_id", "cell", "ring", "slot"])

        kind = queries.schema["query_id"].dataType.simpleString()
        return queries.select("query_id", "vector", "threshold").mapInArrow(visit, f"query_id {kind}, cell int, ring int, slot int")

    def _met(self, visits: DataFrame, queries: DataFrame, dimension: int, k: int, least: float, part_queries: int) -> DataFrame:
        """(query_id, id, similarity) of the k best in each part, and how many points were compared."""
        key = ["cell", "ring", "slot"]
        counts = visits.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / part_queries).cast("int").alias("blocks"))
        asked = visits.join(counts, key).join(queries.select("query_id", "vector"), "query_id").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).drop("blocks")
        there = self.points.join(counts, key).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

        def meet(points: pa.Table, queries: pa.Table) -> pa.Table:
            rows = []
            if points.num_rows and queries.num_rows:
                a, b = (_matrix(t.column(c).combine_chunks(), dimension) for t, c in ((points, "embedding"), (queries, "vector")))
                ids = points.column("id").to_numpy()
                by_id = np.argsort(ids, kind="stable")
                for start in range(0, len(b), MEET_QUERIES):
                    scores = np.round(np.clip(b[start : start + MEET_QUERIES] @ a.T, -1.0, 1.0), 6)
                    for i in range(len(scores)):
                        best = by_id[np.argsort(-scores[i, by_id], kind="stable")[:k]]
                        rows.append((np.full(len(best), start + i), ids[best], scores[i, best]))
            row, found, score = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))
            keep = score >= least
            return pa.table({"query_id": queries.column("query_id").take(pa.array(row[keep])), "id": pa.array(found[keep], pa.int64()), "similarity": pa.array(score[keep], pa.float64())})

        kind = visits.schema["query_id"].dataType.simpleString()
        grouped = there.groupBy(*key, "block").cogroup(asked.groupBy(*key, "block"))
        return grouped.applyInArrow(meet, f"query_id {kind}, id long, similarity double")

    def search(self, queries: DataFrame, k: int, least: float | None = None, rings: int = RINGS, first_points: int = FIRST_POINTS, part_queries: int = PART_QUERIES) -> tuple[DataFrame, DataFrame]:
        """(query_id, id, similarity, rank) of the k nearest, of at least `least`; and (query_id, compared), the points each query met."""
        dimension, floor = self.centres.shape[1], -2.0 if least is None else least
        asked = queries.where((F.size("vector") == dimension) & ~F.exists("vector", lambda x: x.isNull())).select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        none = asked.withColumn("threshold", F.lit(None).cast("double"))
        first = stored(self._visits(none, dimension, rings, True, first_points, floor), "cell-first")
        early = stored(top_per_query(self._met(first, asked, dimension, k, floor, part_queries), k, "similarity", "id").drop("rank"), "cell-early")
        full = early.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("threshold")).where(F.col("n") == k).drop("n")
        second = stored(self._visits(asked.join(full, "query_id", "left"), dimension, rings, False, first_points, floor), "cell-second")
        hits = top_per_query(early.unionByName(self._met(second, asked, dimension, k, floor, part_queries)), k, "similarity", "id")
        sizes = pd.DataFrame(self.rings, columns=["cell", "ring", "n", "slots"])
        spark: SparkSession = queries.sparkSession
        visited = first.unionByName(second).groupBy("query_id", "cell", "ring").agg(F.lit(1).alias("one")) if len(sizes) else None
        if visited is None:
            return hits, asked.select("query_id", F.lit(0).cast("long").alias("compared"))
        counts = F.broadcast(spark.createDataFrame(sizes)[["cell", "ring", "n"]])
        compared = visited.join(counts, ["cell", "ring"]).groupBy("query_id").agg(F.sum("n").alias("compared"))
        return hits, compared


def nearest(points: DataFrame, queries: DataFrame, k: int, least: float | None = None, dimension: int | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest points (id, embedding) of each query (query_id, vector)."""
    if dimension is None:
        row = queries.where("vector IS NOT NULL").select(F.size("vector").alias("n")).first()
        dimension = row["n"] if row else 1
    return Cells.build(points, dimension).search(queries, k, least)[0]
