"""Ruled tables of laid-out pages, from line segments and spans of text.

Segments (doc_id, page, x1, y1, x2, y2) that lie on one line, nearly, and touch are joined by intervals.
Joined lines that touch across belong together; such a group is a table, its lines a grid. Two neighbouring
cells of the grid are one where no line parts them, so a merged cell is what missing edges connect. Spans
(doc_id, page, x1, y1, x2, y2, text, bold) belong to the cell that holds their centre.

Defined results: a segment that is neither level nor upright is no line; a grid of fewer than two columns or
one row, or without text, is no table; words of a cell are joined by one space in reading order; a row
without text has no number; a cell that covers several rows is in each of them, one that covers columns
names the first and last; a row of two cells at least, all bold and of this row only, is a header for itself
and the rows below it until the next.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlspark.operators.layout import BOLD_SHARE

#: Lines this near to each other, in points, are one; so far may two that touch be apart.
NEAR, TOUCH = 1.5, 2.0
PAGE = ["doc_id", "page"]
#: Rows that a task hands on at once.
ROWS = 10_000


def joined_lines(segments: DataFrame) -> DataFrame:
    """(doc_id, page, level, at, a, b): level and upright lines with their place across and their extent; near-collinear segments that touch are one."""
    flat, steep = F.abs(F.col("y2") - F.col("y1")) <= NEAR, F.abs(F.col("x2") - F.col("x1")) <= NEAR
    level = segments.where(flat & ~steep).select(*PAGE, F.lit(True).alias("level"), ((F.col("y1") + F.col("y2")) / 2).alias("at"), F.least("x1", "x2").alias("a"), F.greatest("x1", "x2").alias("b"))
    upright = segments.where(steep & ~flat).select(*PAGE, F.lit(False).alias("level"), ((F.col("x1") + F.col("x2")) / 2).alias("at"), F.least("y1", "y2").alias("a"), F.greatest("y1", "y2").alias("b"))
    rows = level.unionAll(upright)
    kind = [*PAGE, "level"]
    order = Window.partitionBy(*kind).orderBy("at")
    far = F.coalesce(F.col("at") - F.lag("at").over(order) > NEAR, F.lit(False)).cast("int")
    tracked = rows.withColumn("far", far).withColumn("track", F.sum("far").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*kind, "track").orderBy("a", "b")
    reach = F.max("b").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = tracked.withColumn("apart", F.coalesce(F.col("a") - reach > TOUCH, F.lit(False)).cast("int"))
    pieces = apart.withColumn("piece", F.sum("apart").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    placed = pieces.withColumn("at", F.avg("at").over(Window.partitionBy(*kind, "track")))
    return placed.groupBy(*kind, "track", "piece").agg(F.first("at").alias("at"), F.min("a").alias("a"), F.max("b").alias("b")).drop("track", "piece")


def _parted(lines: np.ndarray, places: list[float], steps: list[float]) -> np.ndarray:
    """Whether a line at the i-th place reaches from the j-th step to the next; lines: level, at, a, b."""
    ends = np.array(steps)
    reaches = (lines[:, 2, None] <= ends[None, :-1] + TOUCH) & (lines[:, 3, None] >= ends[None, 1:] - TOUCH)
    found = np.zeros((len(places), len(steps) - 1), dtype=bool)
    np.logical_or.at(found, np.searchsorted(places, lines[:, 1]), reaches)
    return found


def _cells(lines: np.ndarray) -> Iterator[tuple[tuple[float, ...], list[tuple[int, int, int, int]], list[float], list[float]]]:
    """(bounds, cells, xs, ys) of each table of a page; lines: level, at, a, b; cells: first and last column and row of each."""
    h, v = lines[lines[:, 0] == 1], lines[lines[:, 0] == 0]
    meets = (h[:, None, 1] >= v[None, :, 2] - TOUCH) & (h[:, None, 1] <= v[None, :, 3] + TOUCH) & (v[None, :, 1] >= h[:, None, 2] - TOUCH) & (v[None, :, 1] <= h[:, None, 3] + TOUCH)
    group = np.arange(len(h))
    while True:  # the least number among lines that meet, until nothing changes
        other = np.where(meets, group[:, None], len(h)).min(axis=0, initial=len(h))
        again = np.minimum(group, np.where(meets, other[None, :], len(h)).min(axis=1, initial=len(h)))
        if (again == group).all():
            break
        group = again
    for g in np.unique(group):
        mine, across = h[group == g], v[other == g]
        xs, ys = sorted(set(across[:, 1].tolist())), sorted(set(mine[:, 1].tolist()))
        if len(xs) < 3 or len(ys) < 2:
            continue
        label = {(i, j): (i, j) for j in range(len(ys) - 1) for i in range(len(xs) - 1)}

        def root(cell: tuple[int, int], label: dict = label) -> tuple[int, int]:
            while label[cell] != cell:
                cell = label[cell]
            return cell

        beside, below = _parted(across, xs, ys), _parted(mine, ys, xs)
        right, down = (np.zeros((len(ys) - 1, len(xs) - 1), dtype=bool) for _ in range(2))  # cells that are one with the next
        right[:, :-1], down[:-1, :] = ~beside[1:-1].T, ~below[1:-1]
        for j, i in np.argwhere(right | down).tolist():
            if right[j, i]:
                label[root((i + 1, j))] = root((i, j))
            if down[j, i]:
                label[root((i, j + 1))] = root((i, j))
        members: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for cell in label:
            members.setdefault(root(cell), []).append(cell)
        cells = [(min(i for i, _ in m), max(i for i, _ in m), min(j for _, j in m), max(j for _, j in m)) for m in members.values()]
        yield (xs[0], ys[0], xs[-1], ys[-1]), cells, xs, ys


SCHEMA = "table int, x1 double, y1 double, x2 double, y2 double, row int, line string, header string"


def _page_tables(given: np.ndarray, words: list[tuple]) -> list[tuple]:
    """Rows as in SCHEMA; given: level, at, a, b; words: x1, y1, x2, y2, text, bold."""
    found = []
    centres = [((w[0] + w[2]) / 2, (w[1] + w[3]) / 2, w) for w in sorted(words, key=lambda w: (w[1], w[0]))]
    tables = sorted(_cells(given), key=lambda t: (t[0][1], t[0][0]))
    for number, (bounds, cells, xs, ys) in enumerate(tables):
        said: dict[tuple, list] = {c: [] for c in cells}
        holds: dict[tuple[int, int], list[tuple]] = {}
        for c in cells:
            for j in range(c[2], c[3] + 1):
                for i in range(c[0], c[1] + 1):
                    holds.setdefault((i, j), []).append(c)
        for x, y, w in centres:
            for c in holds.get((bisect_right(xs, x) - 1, bisect_right(ys, y) - 1), ()):
                said[c].append(w)
        value = {c: " ".join(" ".join(w[4] or "" for w in ws).split()) for c, ws in said.items()}
        seen = lambda c, only: sum(len("".join((w[4] or "").split())) for w in said[c] if w[5] or not only)
        if not any(value.values()):
            continue
        rows: list[list[tuple]] = [[] for _ in ys[1:]]
        for c in sorted(value):
            if value[c]:
                for j in range(c[2], c[3] + 1):
                    rows[j].append(c)
        header, n = "", 0
        for row in rows:
            if not row:
                continue
            n += 1
            parts = [f"Cột {c[0] + 1}: {value[c]}" if c[0] == c[1] else f"Cột {c[0] + 1}–{c[1] + 1}: {value[c]}" for c in row]
            if len(row) >= 2 and all(c[2] == c[3] and seen(c, True) >= BOLD_SHARE * seen(c, False) for c in row):
                header = " | ".join(value[c] for c in row)
            found.append((number, *bounds, n, f"Dòng {n}: " + " | ".join(parts), header))
    return found


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple], list[tuple]]]:
    """(page, its lines, its words) of rows in order of their page."""
    page, lines, words = None, [], []
    for batch in batches:
        for doc_id, number, level, a, b, c, d, text, bold in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if page != (doc_id, number):
                if lines and words:
                    yield page, lines, words
                page, lines, words = (doc_id, number), [], []
            if level is not None:
                lines.append((level, a, b, c))
            elif None not in (a, b, c, d):  # without a centre it is in no cell
                words.append((a, b, c, d, text, bold))
    if lines and words:
        yield page, lines, words


def ruled_tables(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, page, table, x1, y1, x2, y2, row, line, header): the rows of the tables of each page.

    Lines and words go by page to a task, which takes one page after the other.
    """
    names = [*PAGE, *(c.split()[0] for c in SCHEMA.split(", "))]
    kinds = [f"{k} {segments.schema[k].dataType.simpleString()}" for k in PAGE]
    types = [pa.int32(), *[pa.float64()] * 4, pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        every = [*(first.schema.field(k).type for k in PAGE), *types]
        rows: list[tuple] = []
        for page, lines, words in _pages(chain([first], batches)):
            rows += [(*page, *r) for r in _page_tables(np.array(lines, dtype=float), words)]
            if len(rows) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), every, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), every, strict=True)], names)

    none = lambda kind: F.lit(None).cast(kind)
    four = lambda *columns: [F.col(c).cast("double").alias(k) if c else none("double").alias(k) for c, k in zip(columns, "abcd", strict=True)]
    lines = joined_lines(segments).select(*PAGE, "level", *four("at", "a", "b", None), none("string").alias("text"), none("boolean").alias("bold"))
    words = spans.select(*[F.col(k).cast(segments.schema[k].dataType) for k in PAGE], none("boolean").alias("level"), *four("x1", "y1", "x2", "y2"), "text", "bold")
    return lines.unionAll(words).repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(run, ", ".join([*kinds, SCHEMA]))
